"""Page classification: features from measured components and lines, an additive score, and a class."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F



def tiers(value: Column, *steps: tuple[float, float]) -> Column:
    """The weight of the first threshold exceeded, else 0."""
    out = F.lit(0.0)
    for threshold, weight in reversed(steps):
        out = F.when(value > threshold, F.lit(weight)).otherwise(out)
    return out


def tiers_below(value: Column, *steps: tuple[float, float]) -> Column:
    """The weight of the first threshold undercut, else 0."""
    out = F.lit(0.0)
    for threshold, weight in reversed(steps):
        out = F.when(value < threshold, F.lit(weight)).otherwise(out)
    return out


def typed_score(stroke: Column, line: Column, angle: Column, edge: Column, form: Column, uniformity: Column, has_signature: Column, has_fax_header: Column) -> Column:
    """How much a page looks typed, 0 to 1; terms are added in a fixed order."""
    off_form = form < 0.3
    angle_term = (
        F.when(angle < 400, F.lit(0.10)).when(angle < 800, F.lit(0.05)).when((angle > 1500) & off_form, F.lit(-0.15)).when((angle > 1200) & off_form, F.lit(-0.08)).otherwise(F.lit(0.0))
    )
    edge_term = F.when((edge > 0.02) & (edge < 0.15), F.lit(0.08)).when(edge < 0.02, F.lit(0.04)).otherwise(F.lit(0.0))
    ruled = (line >= 0.95) & (form < 0.25) & (angle > 300) & (angle < 700)
    flag = lambda c, w: F.when(c, F.lit(w)).otherwise(F.lit(0.0))
    terms = (
        tiers_below(stroke, (0.3, 0.20), (0.5, 0.10)),
        tiers(line, (0.7, 0.12), (0.5, 0.06)),
        angle_term,
        edge_term,
        tiers(form, (0.5, 0.30), (0.2, 0.20), (0.1, 0.12)),
        tiers(uniformity, (0.7, 0.12), (0.4, 0.06)),
        flag(has_fax_header, 0.20),
        flag(has_signature & (form > 0.2), 0.10),
        flag(ruled, -0.12),
    )
    total = reduce(lambda a, t: a + t, terms, F.lit(0.0))
    sparse = (edge < 0.02) & (form > 0.15) & ~ruled & (total < 0.65)
    return F.greatest(F.lit(0.0), F.least(F.when(sparse, F.lit(0.65)).otherwise(total), F.lit(1.0)))


def page_class(score: Column) -> Column:
    """struct<document_type, confidence>; a page that couldn't be scored is mixed, at 0.3."""
    made = lambda name, conf: F.struct(F.lit(name).alias("document_type"), conf.alias("confidence"))
    return (
        F.when(score.isNull(), made("mixed", F.lit(0.3)))
        .when(score >= 0.65, made("typed", F.least(score, F.lit(0.95))))
        .when(score <= 0.45, made("handwritten", F.least(1.0 - score, F.lit(0.95))))
        .otherwise(made("mixed", F.lit(0.5)))
    )


def is_signature(ink_ratio: Column, area: Column, width: Column, pixels: Column, height: Column, region_width: Column) -> Column:
    """Aggregate over a region's components (area, width): ink within bounds and a handful of large enough parts."""
    parts = F.count_if((area > 50) & (area < pixels * 0.3) & (width > 20))
    ink = F.max(ink_ratio)
    return (F.max(height) >= 20) & (F.max(region_width) >= 50) & (ink >= 0.003) & (ink <= 0.15) & (parts >= 1) & (parts <= 15)


def measured_flags(m: Column) -> dict[str, Column]:
    """has_signature, has_fax_header, form, edge and stroke of a page from `image.measures`; the body alone counts where there is a signature."""
    parts = F.filter(m["foot_parts"], lambda p: (p["area"] > 50) & (p["area"] < m["foot_pixels"] * 0.3) & (p["width"] > 20))
    signed = (m["foot_height"] >= 20) & (m["width"] >= 50) & m["foot_ink"].between(0.003, 0.15) & F.size(parts).between(1, 15)
    region = F.when(signed, m["body"]).otherwise(m["page"])
    usable = (region["strokes"] >= 100) & (region["stroke_mean"] >= 0.1)
    return {
        "has_signature": signed,
        "has_fax_header": is_fax_header(m["head_lines"], m["head_ink"], m["head_height"], m["width"]),
        "form": form_structure(m["horizontal"], m["vertical"], m["pixels"]),
        "edge": region["edges"],
        "stroke": F.when(usable, F.least(F.try_divide(region["stroke_deviation"], region["stroke_mean"]) / 0.5, F.lit(1.0))).otherwise(F.lit(0.5)),
    }


def signature_zone(has_signature: Column) -> Column:
    """Box of the zone in shares of the page, null of none."""
    return F.when(has_signature, F.array(*[F.lit(v) for v in (0.0, 0.8, 1.0, 1.0)]))


def is_fax_header(longest_line: Column, ink_ratio: Column, height: Column, width: Column) -> Column:
    return (height >= 30) & (width >= 100) & (longest_line > width * 0.1) & (ink_ratio > 0.02) & (ink_ratio < 0.25)


def stroke_variance(width: Column) -> Column:
    """Aggregate over stroke widths: their coefficient of variation over 0.5, 1 at most; 0.5 of too few or too thin."""
    usable = (F.count(width) >= 100) & (F.avg(width) >= 0.1)
    return F.when(usable, F.least(F.try_divide(F.stddev_pop(width), F.avg(width)) / 0.5, F.lit(1.0))).otherwise(F.lit(0.5))


def line_regularity(angle: Column) -> Column:
    """Aggregate over line angles (degrees, null of vertical lines): the share that is level; 0.5 of fewer than five."""
    level = F.avg(((F.abs(angle) < 5) | (F.abs(angle) > 175)).cast("double"))
    return F.when(F.count(F.lit(1)) < 5, F.lit(0.5)).otherwise(F.coalesce(level, F.lit(0.5)))


def angle_variance(angle: Column) -> Column:
    """Aggregate over ellipse angles: population variance; 1000 of none."""
    return F.coalesce(F.var_pop(angle), F.lit(1000.0))


def character_uniformity(height: Column) -> Column:
    """Aggregate over character heights: 1 - variation / 0.4, within 0 and 1; 0.5 of fewer than ten."""
    cv = F.try_divide(F.stddev_pop(height), F.avg(height))
    return F.when(F.count(height) < 10, F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - cv / 0.4)))


def form_structure(horizontal: Column, vertical: Column, pixels: Column) -> Column:
    return F.least(F.try_divide(horizontal + vertical, pixels) / 0.01, F.lit(1.0))


def skew(angle: Column) -> Column:
    """Aggregate over line angles: the median of those within 30 degrees if there are five, else 0."""
    usable = F.when((angle > -30) & (angle < 30), angle)
    return F.when(F.count(usable) >= 5, F.percentile(usable, F.lit(0.5))).otherwise(F.lit(0.0))


def line_skew(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Aggregate over detected lines: the skew to correct, in degrees; 0 of fewer than ten lines, of fewer than five usable ones, or outside 0.5 to 15."""
    angle = F.when(F.abs(x2 - x1) > 10, F.degrees(F.atan2(y2 - y1, x2 - x1)))
    found = F.when(F.count(x1) >= 10, skew(angle)).otherwise(F.lit(0.0))
    return F.when(needs_rotation(found), found).otherwise(F.lit(0.0))


def needs_rotation(angle: Column) -> Column:
    return F.abs(angle).between(0.5, 15.0)
