"""Operators that relate elements of a page by where they lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.config import DEFAULT, Config
from quillspark.functions import geometry as g
from quillspark.functions import text as tx
from quillspark.schema import BOX, PAGE, page_window

GARBAGE_DATE = "^\\d{1,2}[-/]\\p{Alpha}{3,9}[-/]\\d{2,4}$|^\\d{1,2}[-/]\\d{1,2}[-/]\\d{2,4}$"


def boxes_on_page(which: Column) -> Column:
    """The boxes of a page's elements that meet a condition, as an array on each of its rows.

    Pages are small, and the window shares its exchange with every other page-scoped step, where a join would compute what is above it twice.
    """
    return F.collect_list(F.when(which & F.col("x1").isNotNull(), F.struct(*g.box()))).over(page_window())


def corners(b: Column) -> list[Column]:
    return [b[c] for c in BOX]


def is_text() -> Column:
    return F.coalesce(F.col("type") == "text", F.lit(False))


def filter_empty_regions(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Tables and layout regions stay only if some text on the page lies over them, by a share of the smaller box."""
    region = F.coalesce(F.col("type").isin("table", "layout_region"), F.lit(False))
    over = F.exists("_texts", lambda t: g.overlap_of_smaller(g.box(), corners(t)) >= config.region_overlap)
    return df.withColumn("_texts", boxes_on_page(is_text())).where(~region | over).drop("_texts")


def deduplicate_layout(df: DataFrame) -> DataFrame:
    """The first layout region of each box, rounded to hundredths; missing boxes are equal too."""
    key = [F.round(c, 2) for c in BOX]
    first = F.row_number().over(Window.partitionBy(*PAGE, "type", *key).orderBy("elem_idx"))
    return df.withColumn("_n", first).where((F.col("type") != "layout_region") | F.col("type").isNull() | (F.col("_n") == 1)).drop("_n")


def filter_signature_garbage(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Single words over a signature go, unless they are dates."""
    content = tx.strip(F.coalesce("content", F.lit("")))
    suspect = is_text() & (F.size(tx.words(content)) == 1) & ~F.regexp_replace(content, "[.,]+$", "").rlike(GARBAGE_DATE)
    over = F.exists("_marks", lambda m: g.overlap_of_smaller(g.box(), corners(m)) > config.garbage_overlap)
    marked = df.withColumn("_marks", boxes_on_page(F.coalesce(F.lower("type") == "signature", F.lit(False))))
    return marked.where(~(suspect & over)).drop("_marks")


def filter_rotated_margin(df: DataFrame, image_width: Column | None = None) -> DataFrame:
    """Narrow text at the right edge goes, but for digits of some length."""
    width, _ = g.page_size(g.box(), image_width, None, page_window())
    content = tx.strip(F.coalesce("content", F.lit("")))
    edge = is_text() & (F.col("x1") > F.col("_w") * 0.92) & (F.col("x2") - F.col("x1") < F.col("_w") * 0.04)
    gone = edge & ~(tx.is_digits(content) & (F.length(content) >= 3))
    return df.withColumn("_w", width).where(~F.coalesce(gone, F.lit(False))).drop("_w")


def filter_large_detections(df: DataFrame, width: Column, height: Column, labels: tuple[str, ...] | None = None) -> DataFrame:
    """Detections that cover too much of the page go; with labels, all others go too."""
    kept = ~g.too_large(g.box(), width, height, F.col("type"))
    return df.where(kept & F.lower("type").isin(*labels) if labels else kept)
