"""The scalar functions as SQL functions of a session, without Python in their plans."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quillspark.functions import text as tx

_QUOTE = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _chain(rules: tuple[tuple[str, str], ...]) -> str:
    out = "c"
    for pattern, to in rules:
        out = f"regexp_replace({out}, {_QUOTE(pattern)}, {_QUOTE(to)})"
    return out


FUNCTIONS = {
    "qs_strip": ("c STRING", "STRING", f"regexp_replace(c, {_QUOTE('(?U)^' + chr(92) + 's+|' + chr(92) + 's+$')}, '')"),
    "qs_underscores": ("c STRING", "STRING", _chain(tx.UNDERSCORE_RULES)),
    "qs_punctuation": ("c STRING", "STRING", f"regexp_replace({_chain(tx.PUNCTUATION_RULES)}, {_QUOTE('(?U)^' + chr(92) + 's+|' + chr(92) + 's+$')}, '')"),
    "qs_markup": ("c STRING", "STRING", "regexp_replace(c, '<[^>]+>', '')"),
    "qs_signature": ("c STRING", "STRING", f"regexp_replace(c, {_QUOTE(tx.SIGNATURE_LABEL)}, '$1 (signature)')"),
    "qs_overlap": (
        "ax1 DOUBLE, ay1 DOUBLE, ax2 DOUBLE, ay2 DOUBLE, bx1 DOUBLE, by1 DOUBLE, bx2 DOUBLE, by2 DOUBLE",
        "DOUBLE",
        "CASE WHEN least(ax2, bx2) > greatest(ax1, bx1) AND least(ay2, by2) > greatest(ay1, by1) AND (ax2 - ax1) * (ay2 - ay1) > 0 AND (bx2 - bx1) * (by2 - by1) > 0 THEN (least(ax2, bx2) - greatest(ax1, bx1)) * (least(ay2, by2) - greatest(ay1, by1)) / least((ax2 - ax1) * (ay2 - ay1), (bx2 - bx1) * (by2 - by1)) ELSE 0D END",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions as temporary SQL functions; Catalyst inlines them."""
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
