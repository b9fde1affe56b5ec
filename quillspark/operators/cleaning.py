"""Text repairs by element, and the page-level decisions they depend on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.config import DEFAULT, Config
from quillspark.functions import text as tx
from quillspark.operators.regions import is_text
from quillspark.schema import page_window


def _has_text() -> Column:
    return is_text() & F.coalesce(F.col("content") != "", F.lit(False))


def _set(df: DataFrame, when: Column, value: Column) -> DataFrame:
    return df.withColumn("content", F.when(when, value).otherwise(F.col("content")))


def sanitize(df: DataFrame) -> DataFrame:
    """Coerce raw string fields (raw_type, raw_content, raw_box array, raw_confidence) to the element's types.

    A missing type is unknown; a box needs four numbers; a confidence is held to [0, 1], 0 where it is no number, and
    stays null where it is missing.  An explicit null counts as missing.
    """
    corners = F.transform(F.slice("raw_box", 1, 4), lambda v: v.try_cast("double"))
    good = (F.size("raw_box") >= 4) & ~F.exists(corners, lambda v: v.isNull())
    boxes = {c: F.when(good, F.get(corners, F.lit(i))) for i, c in enumerate(("x1", "y1", "x2", "y2"))}
    conf = F.coalesce(F.col("raw_confidence").try_cast("double"), F.lit(0.0))
    # NaN is the largest double here, so it becomes 1.
    bounded = F.when(F.col("raw_confidence").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)))
    return df.withColumns({"type": F.coalesce("raw_type", F.lit("unknown")), "content": F.col("raw_content"), **boxes, "confidence": bounded}).drop("raw_type", "raw_content", "raw_box", "raw_confidence")


def normalize_underscore_fields(df: DataFrame) -> DataFrame:
    return _set(df, _has_text(), tx.strip(tx.normalize_underscores(F.col("content"))))


def clean_text(df: DataFrame) -> DataFrame:
    """Text is never missing afterwards."""
    return _set(df, is_text(), tx.clean(F.coalesce("content", F.lit(""))))


def classification_override(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """A page most of whose text the handwriting recognizer read becomes handwritten; needs `document_type`."""
    counted = is_text() & F.coalesce(tx.strip(F.col("content")) != "", F.lit(False))
    share = F.avg(F.when(counted, (F.coalesce(F.col("source_model"), F.lit("")) == "trocr").cast("double"))).over(page_window())
    original = F.coalesce("document_type", F.lit("typed"))
    df = df.withColumn("_share", share).withColumn("_over", F.coalesce((F.col("_share") >= config.handwriting_majority) & (original != "handwritten"), F.lit(False)))
    override = F.when(F.col("_over"), F.struct(original.alias("original"), F.lit("trocr_majority").alias("reason"), F.round("_share", 2).alias("trocr_ratio")))
    return df.withColumn("classification_override", override).withColumn("document_type", F.when(F.col("_over"), "handwritten").otherwise(original)).drop("_share", "_over")


def strip_trailing_periods(df: DataFrame) -> DataFrame:
    """Only what the handwriting recognizer read, and not on handwritten pages."""
    when = _has_text() & (F.col("source_model") == "trocr") & (F.coalesce("document_type", F.lit("typed")) != "handwritten")
    return _set(df, F.coalesce(when, F.lit(False)), tx.trailing_period(F.col("content")))


def repair_decimal_dashes(df: DataFrame) -> DataFrame:
    """On pages with a decimal number; adds `decimal_dash_repaired`."""
    gate = F.max(_has_text() & F.col("content").rlike(tx.DECIMAL_NUMBER)).over(page_window())
    fixed, repaired = tx.decimal_dash(F.col("content"))
    df = df.withColumn("_gate", F.coalesce(gate, F.lit(False)) & _has_text())
    df = df.withColumn("decimal_dash_repaired", F.when(F.col("_gate") & repaired, True))
    return _set(df, F.col("_gate"), fixed).drop("_gate")


def repair_parentheses(df: DataFrame) -> DataFrame:
    return _set(df, _has_text(), tx.dropped_parenthesis(F.col("content")))


def replace_signature_text(df: DataFrame) -> DataFrame:
    return _set(df, _has_text(), tx.signature_text(F.col("content")))


def remove_duplicate_words(df: DataFrame) -> DataFrame:
    """Only what the handwriting recognizer read; adds `duplicate_words_removed`."""
    when = F.coalesce(_has_text() & (F.col("source_model") == "trocr"), F.lit(False))
    text, removed = tx.repeated_words(F.col("content"))
    df = df.withColumn("duplicate_words_removed", F.when(when, removed))
    return _set(df, when, text)
