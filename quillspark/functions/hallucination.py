"""The hallucination score: seven signals, added in a fixed order so that thresholds compare equal sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.functions.geometry import Box

NUMERIC_CELL = "(?U)^[\\d.,]+%?$"
VALID = (
    "^[a-zA-Z0-9]\\)$",
    "^[&*@#]+[.,:;]?$",
    "(?U)^\\.\\d+$",
    "^[A-Z]{2,}$",
    "^[A-Z][a-z]+$",
    "(?U)^[A-Z][a-z]*\\.?\\s*$",
    "(?i)^[A-Za-z]{2,}$",
    "(?i)^[A-Z]+[!?.,:;]?$",
    "(?U)^\\d{1,2}[/\\-.]\\d{1,2}[/\\-.]\\d{2,4}$",
    "(?U)^\\d+[.,]?\\d*$",
    "(?U)^[$\u00a3\u20ac]\\d+[.,]?\\d*$",
    "(?U)^\\(\\d{3}\\)\\s*\\d{3}[-\\s]?\\d{4}$",
    "(?i)^[\\w.%+-]+@[a-z0-9.-]+\\.[a-z]{2,}$",
    "(?i)^https?://",
    "(?i)^www\\.",
)


def _signals(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]))


def _sum(*terms: Column) -> Column:
    """Left to right, from 0.0."""
    return reduce(lambda a, t: a + t, terms, F.lit(0.0))


def _pattern_flags(content: Column, s: Column, solid: Column) -> dict[str, Column]:
    """The suspicious patterns, from the content, the same stripped, and without blanks."""
    same = (solid != "") & (F.replace(solid, F.substring(solid, 1, 1), F.lit("")) == "") & (F.length(content) > 2)
    digits = (F.length(s) <= 3) & tx.is_digits(s)
    return {
        "all_same_char": same,
        "isolated_digits": digits,
        "short_numbers": (F.length(s) <= 4) & ~digits & s.rlike("(?U)^[\\d\\s]+$"),
        "only_punctuation": solid.rlike("^[.,;:!?\\-_']*$"),
        "unusual_chars": content.rlike("[^\\x{00}-\\x{7F}\\x{C0}-\\x{24F}\\x{1E00}-\\x{1EFF}]"),
        "isolated_year": s.rlike("(?U)^(19|20)\\d{2}s?$"),
        "latex_command": s.rlike("^\\\\[a-zA-Z]{2,}$"),
    }


def _pattern_score(flags: dict[str, Column]) -> tuple[Column, Column]:
    add = lambda name, v: F.when(flags[name], F.lit(v)).otherwise(F.lit(0.0))
    score = _sum(add("all_same_char", 0.8), add("isolated_digits", 0.30) + add("short_numbers", 0.35), add("only_punctuation", 0.6), add("unusual_chars", 0.3), add("isolated_year", 0.25), add("latex_command", 0.5))
    return F.least(score, F.lit(1.0)), _signals(*((c, name) for name, c in flags.items()))


def character_patterns(content: Column) -> tuple[Column, Column]:
    """(score, names) of suspicious character patterns; only_punctuation holds of blank text too."""
    return _pattern_score(_pattern_flags(content, tx.strip(content), F.replace(content, F.lit(" "), F.lit(""))))


def is_valid_text(content: Column) -> Column:
    """Whether text looks like words, numbers, dates or the usual short forms."""
    return _is_valid(tx.strip(content))


def _is_valid(s: Column) -> Column:
    single = s.rlike("^[\\p{L}\\p{N}#.,;:!?()\\[\\]{}\"']$")
    ratio = F.try_divide(F.length(F.regexp_replace(s, "[^\\p{L}\\p{N}]", "")), F.length(s))
    # Most texts are of several words, which needs no pattern.
    known = reduce(lambda a, p: a | s.rlike(p), VALID, s.contains(" ") & (F.length(s) > 5))
    return F.when(s == "", False).when(F.length(s) == 1, single).otherwise(known | (ratio > 0.7))


def has_repetition(content: Column) -> Column:
    """Whether a word of two letters or more repeats at once, or three words or more are all the same."""
    return _repeats(tx.words(F.lower(content)))


def _repeats(w: Column) -> Column:
    # Pairs with the word before: where a filter on the score takes the words' split in, looking a word up by place would split again for each.
    pairs = F.zip_with(w, F.concat(F.array(F.lit(None).cast("string")), w), lambda x, before: F.coalesce((x == before) & (F.length(x) > 1), F.lit(False)))
    twice = F.exists(pairs, lambda b: b)
    return (F.size(w) >= 2) & (twice | ((F.size(F.array_distinct(w)) == 1) & (F.size(w) > 2)))


def score(content: Column, confidence: Column, b: Box, width: Column) -> tuple[Column, Column]:
    """(score, names of the signals).  A missing confidence counts as 1."""
    c = F.coalesce(content, F.lit(""))
    s = tx.strip(c)
    flags = _pattern_flags(c, s, F.replace(c, F.lit(" "), F.lit("")))
    return _score(s, flags, _is_valid(s), has_repetition(c), confidence, b, width)


def scored(df: DataFrame, content: Column, confidence: Column, b: Box, width: Column) -> DataFrame:
    """df with `_score`, `_signals`, `_pattern`, `_patterns`, `_valid` and `_repeats`.

    Each pattern is matched once, as a column of its own, and both score and names follow from these.
    """
    parts = {"_c": F.coalesce(content, F.lit(""))}
    df = df.withColumns(parts)
    df = df.withColumns({"_s": tx.strip(F.col("_c")), "_solid": F.replace("_c", F.lit(" "), F.lit("")), "_words": tx.words(F.lower("_c"))})
    flags = _pattern_flags(F.col("_c"), F.col("_s"), F.col("_solid"))
    df = df.withColumns({f"_f_{k}": v for k, v in flags.items()} | {"_valid": _is_valid(F.col("_s")), "_repeats": _repeats(F.col("_words"))})
    known = {k: F.col(f"_f_{k}") for k in flags}
    total, signals = _score(F.col("_s"), known, F.col("_valid"), F.col("_repeats"), confidence, b, width)
    pattern, names = _pattern_score(known)
    df = df.withColumns({"_score": total, "_signals": signals, "_pattern": pattern, "_patterns": names})
    return df.drop("_c", "_s", "_solid", "_words", *[f"_f_{k}" for k in flags])


def _score(s: Column, flags: dict[str, Column], valid: Column, repeats: Column, confidence: Column, b: Box, width: Column) -> tuple[Column, Column]:
    conf = F.coalesce(confidence, F.lit(1.0))
    size = F.length(s)
    pattern, pattern_names = _pattern_score(flags)
    w, h = b[2] - b[0], b[3] - b[1]
    has = F.coalesce((w + h).isNotNull(), F.lit(False))
    tiny = has & ((w < 20) | (h < 10)) & (size > 2)
    tall = has & ~tiny & (w > 0) & (F.try_divide(h, w) > 5)
    invalid = ~valid
    left = (b[0] < width * 0.03) & (b[2] < width * 0.10)
    right = (b[0] > width * (1 - 0.10)) & (b[2] > width * (1 - 0.03))
    edge = has & (width > 0) & (left | right) & ~tx.is_digits(s)
    tall, edge = F.coalesce(tall, F.lit(False)), F.coalesce(edge, F.lit(False))
    total = _sum(
        F.when(conf < 0.50, F.lit(0.15)).when(conf < 0.70, F.lit(0.10)).when(conf < 0.85, F.lit(0.05)).otherwise(F.lit(0.0)),
        F.when(size <= 2, F.lit(0.10)).when(size <= 4, F.lit(0.06)).otherwise(F.lit(0.0)),
        pattern * F.lit(0.25),
        F.when(tiny, F.lit(0.15)).when(tall, F.lit(0.10)).otherwise(F.lit(0.0)),
        F.when(invalid, F.lit(0.15)).otherwise(F.lit(0.0)),
        F.when(repeats, F.lit(0.10)).otherwise(F.lit(0.0)),
        F.when(edge, F.when(size <= 4, F.lit(0.25)).otherwise(F.lit(0.10))).otherwise(F.lit(0.0)),
    )
    names = F.concat(
        _signals((conf < 0.50, "very_low_confidence"), ((conf >= 0.50) & (conf < 0.70), "low_confidence"), (size <= 2, "very_short"), ((size > 2) & (size <= 4), "short")),
        pattern_names,
        _signals((tiny, "tiny_bbox"), (tall, "abnormal_aspect"), (invalid, "not_valid_text"), (repeats, "repetition"), (edge & (size <= 4), "margin_fragment_short"), (edge & (size > 4), "margin_position")),
    )
    return F.least(total, F.lit(1.0)), names
