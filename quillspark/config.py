"""Thresholds, as frozen literals that plans fold into constants."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Every threshold that more than one operator reads."""

    signature_zone: float = 0.80
    confidence_divisor: float = 2.5
    handwriting_majority: float = 0.50
    line_confidence: float = 0.40
    region_line_confidence: float = 0.15
    handwritten_gate: float = 0.45
    typed_retry_confidence: float = 0.60
    signature_gate: float = 0.90
    crop_padding: int = 12
    remove_score: float = 0.50
    flag_score: float = 0.30
    structure_score: float = 50.0
    region_overlap: float = 0.30
    cell_overlap: float = 0.50
    garbage_overlap: float = 0.50
    region_repeat: float = 0.50
    default_width: float = 612.0
    default_height: float = 792.0


DEFAULT = Config()
