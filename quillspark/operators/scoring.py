"""Hallucination scoring of a page's texts, with the exemptions that protect tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.config import DEFAULT, Config
from quillspark.functions import geometry as g
from quillspark.functions import hallucination as h
from quillspark.functions import text as tx
from quillspark.operators.regions import is_text
from quillspark.schema import PAGE, page_window


def islands(df: DataFrame, keys: list, position: Column, tolerance: Column, name: str) -> DataFrame:
    """Number runs of positions whose neighbours are at most tolerance apart, within keys: gaps and islands."""
    order = Window.partitionBy(*keys).orderBy(position, "elem_idx")
    gap = position - F.lag(position).over(order)
    df = df.withColumn("_gap", F.when(gap > tolerance, 1).otherwise(0))
    return df.withColumn(name, F.sum("_gap").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_gap")


def numeric_columns(df: DataFrame, image_width: Column | None = None) -> DataFrame:
    """Add `in_numeric_column`: short numbers lined up with two or more others, by centre."""
    width, _ = g.page_size(g.box(), image_width, None, page_window())
    content = tx.strip(F.coalesce("content", F.lit("")))
    candidate = is_text() & (F.length(content) <= 4) & content.rlike(h.NUMERIC_CELL) & F.col("x1").isNotNull()
    df = df.withColumns({"_w": width, "_cand": F.coalesce(candidate, F.lit(False)), "_xc": (F.col("x1") + F.col("x2")) / 2})
    tolerance = F.col("_w") * 0.03
    df = islands(df, [*PAGE, "_cand"], F.col("_xc"), tolerance, "_island")
    run = Window.partitionBy(*PAGE, "_cand", "_island")
    reach = F.struct((F.min("_xc").over(run) - tolerance).alias("a"), (F.max("_xc").over(run) + tolerance).alias("b"))
    df = df.withColumn("_reach", F.when(F.col("_cand") & (F.count("*").over(run) >= 3), reach))
    # A run's reach may take in a neighbour of another run.
    df = df.withColumn("_reaches", F.collect_set("_reach").over(page_window()))
    inside = F.exists("_reaches", lambda r: (F.col("_xc") >= r["a"]) & (F.col("_xc") <= r["b"]))
    return df.withColumn("in_numeric_column", F.col("_cand") & inside).drop("_w", "_cand", "_xc", "_island", "_reach", "_reaches")


def score_hallucinations(df: DataFrame, image_width: Column | None = None) -> DataFrame:
    """Add `exempt`, `raw_score` and `raw_signals`; every window has the page as its leading partition."""
    df = numeric_columns(df, image_width)
    width, _ = g.page_size(g.box(), image_width, None, page_window())
    table = F.when((F.col("type") == "table") & F.col("x1").isNotNull(), F.struct(*g.box()))
    df = df.withColumn("_w", width).withColumn("_tables", F.collect_list(table).over(page_window()))
    in_table = F.exists("_tables", lambda t: g.intersects(g.box(), [t[c] for c in ("x1", "y1", "x2", "y2")]))
    df = df.withColumn("exempt", ~is_text() | in_table | F.col("in_numeric_column"))
    # What is exempt needs no score.
    df = h.scored(df, F.when(~F.col("exempt"), F.col("content")), F.col("confidence"), g.box(), F.col("_w"))
    df = df.withColumns({"raw_score": F.when(~F.col("exempt"), F.col("_score")), "raw_signals": F.when(~F.col("exempt"), F.col("_signals"))})
    return df.drop("_w", "_tables", "in_numeric_column", "_score", "_signals", "_pattern", "_patterns", "_valid", "_repeats")


def process_hallucinations(df: DataFrame, image_width: Column | None = None, config: Config = DEFAULT) -> DataFrame:
    """Likely hallucinations go; doubtful ones are flagged."""
    df = score_hallucinations(df, image_width)
    # A filter isn't moved below a window, where it would match every pattern again each time the score names it.
    df = df.withColumn("raw_score", F.max("raw_score").over(page_window().orderBy("elem_idx").rowsBetween(0, 0)))
    df = df.where(F.col("exempt") | (F.col("raw_score") < config.remove_score))
    flag = ~F.col("exempt") & (F.col("raw_score") > config.flag_score)
    return df.withColumns(
        {
            "hallucination_flag": F.when(flag, True),
            "hallucination_score": F.when(flag, F.round("raw_score", 3)),
            "hallucination_signals": F.when(flag, F.col("raw_signals")),
        }
    ).drop("exempt", "raw_score", "raw_signals")
