"""Table structure: validation by alignment, and cells with their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.config import DEFAULT, Config
from quillspark.functions import geometry as g
from quillspark.functions import text as tx
from quillspark.operators.regions import is_text
from quillspark.operators.scoring import islands
from quillspark.schema import BOX, KEY, PAGE, page_window

COLUMN_TOLERANCE, ROW_TOLERANCE, REFERENCE_WIDTH = 40.0, 15.0, 1000.0


def percent(share: Column, digits: int = 0) -> Column:
    value = F.round(share * 100, digits)
    return F.concat(value.cast(f"decimal(12,{digits})").cast("string"), F.lit("%"))


def structure_score(density: Column, columns: Column, rows: Column, coverage: Column, confidence: Column) -> tuple[Column, Column]:
    """(score of 100, signals)."""
    score = (
        F.when(columns >= 3, F.lit(40.0)).when(columns == 2, F.lit(25.0)).otherwise(F.lit(0.0))
        + F.when(rows >= 3, F.lit(25.0)).when(rows == 2, F.lit(15.0)).otherwise(F.lit(0.0))
        + F.when(coverage >= 0.3, F.lit(20.0)).when(coverage >= 0.15, F.lit(10.0)).otherwise(F.lit(0.0))
        + F.when(density.between(0.03, 0.80), F.lit(10.0)).otherwise(F.lit(0.0))
        + F.when(confidence >= 0.95, F.lit(5.0)).otherwise(F.lit(0.0))
    )
    signals = F.array_compact(
        F.array(
            F.when(columns >= 2, F.concat(F.lit("columns:"), columns.cast("string"))).otherwise(F.lit("single_column")),
            F.when(rows >= 2, F.concat(F.lit("rows:"), rows.cast("string"))).otherwise(F.lit("few_rows")),
            F.concat(F.when(coverage >= 0.15, F.lit("grid_coverage:")).otherwise(F.lit("sparse_grid:")), percent(coverage)),
            F.concat(F.when(density.between(0.03, 0.80), F.lit("density_ok:")).otherwise(F.lit("density_bad:")), percent(density, 1)),
            F.when(confidence >= 0.95, F.lit("high_confidence")),
        )
    )
    return score, signals


def _nearest(centres: Column, at: Column, reach: Column) -> Column:
    """Index of the nearest centre within reach; the first of equals; null if there is none."""
    close = F.filter(centres, lambda c: F.abs(at - c["centre"]) < reach)
    return F.array_min(F.transform(close, lambda c: F.struct(F.abs(at - c["centre"]).alias("d"), c["idx"].alias("i"))))["i"]


def grid_coverage(points: Column, columns: Column, rows: Column, column_reach: Column, row_reach: Column) -> Column:
    """Share of the grid's cells that hold a point; 0 of grids with fewer than two columns or rows."""
    cells = F.transform(points, lambda p: F.struct(_nearest(columns, p["x"], column_reach).alias("c"), _nearest(rows, p["y"], row_reach).alias("r")))
    occupied = F.size(F.array_distinct(F.filter(cells, lambda c: c["c"].isNotNull() & c["r"].isNotNull())))
    return F.when((F.size(columns) < 2) | (F.size(rows) < 2), F.lit(0.0)).otherwise(occupied / (F.size(columns) * F.size(rows)))


def table_measures(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One row a table over some text: keys, density, num_columns, num_rows, grid_coverage, structure_score, structure_signals."""
    width, _ = g.page_size(g.box(), None, None, page_window())
    sized = df.withColumn("_scale", width / REFERENCE_WIDTH)
    tables = sized.where((F.col("type") == "table") & F.col("x1").isNotNull())
    tables = tables.select(*PAGE, F.col("elem_idx").alias("t_idx"), F.coalesce("confidence", F.lit(0.5)).alias("t_confidence"), "_scale", *[F.col(c).alias(f"t_{c}") for c in BOX])
    texts = df.where(is_text() & F.col("x1").isNotNull()).select(*KEY, *BOX)
    pairs = tables.join(texts, list(PAGE)).where(g.overlap_of_smaller(g.box("t_"), g.box()) >= config.region_overlap)
    keys = [*PAGE, "t_idx"]
    pairs = islands(pairs, keys, F.col("x1"), F.col("_scale") * COLUMN_TOLERANCE, "_c")
    pairs = islands(pairs, keys, F.col("y1"), F.col("_scale") * ROW_TOLERANCE, "_r")
    centre = lambda c, k: F.avg(c).over(Window.partitionBy(*keys, k))
    pairs = pairs.withColumn("_cx", centre("x1", "_c")).withColumn("_cy", centre("y1", "_r"))
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    found = pairs.groupBy(*keys).agg(
        F.first("t_confidence").alias("t_confidence"),
        F.first("_scale").alias("_scale"),
        F.first(g.area(g.box("t_"))).alias("_area"),
        F.sum(F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))).alias("_covered"),
        F.array_sort(F.collect_set(F.struct(F.col("_c").alias("idx"), F.col("_cx").alias("centre")))).alias("_columns"),
        F.array_sort(F.collect_set(F.struct(F.col("_r").alias("idx"), F.col("_cy").alias("centre")))).alias("_rows"),
        F.collect_list(F.struct(((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))).alias("_points"),
    )
    density = F.when(F.col("_area") > 0, F.least(F.col("_covered") / F.col("_area"), F.lit(1.0))).otherwise(F.lit(0.0))
    coverage = grid_coverage(F.col("_points"), F.col("_columns"), F.col("_rows"), 2 * COLUMN_TOLERANCE * F.col("_scale"), 2 * ROW_TOLERANCE * F.col("_scale"))
    found = found.withColumns({"density": density, "num_columns": F.size("_columns"), "num_rows": F.size("_rows"), "grid_coverage": coverage})
    score, signals = structure_score(F.col("density"), F.col("num_columns"), F.col("num_rows"), F.col("grid_coverage"), F.col("t_confidence"))
    return found.select(*PAGE, F.col("t_idx").alias("elem_idx"), "density", "num_columns", "num_rows", "grid_coverage", F.round(score, 1).alias("structure_score"), signals.alias("structure_signals"))


def filter_invalid_tables(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Tables whose text isn't aligned go; the others carry their score and signals."""
    measured = table_measures(df, config).select(*KEY, "structure_score", "structure_signals")
    table = F.coalesce(F.col("type") == "table", F.lit(False))
    good = F.coalesce(F.col("structure_score") >= config.structure_score, F.lit(False))
    return df.join(measured, list(KEY), "left").where(~table | good)


def ranges(lines: Column, low: str, high: str, outer_low: Column, outer_high: Column) -> Column:
    """array<struct<a,b>>: rows or columns grown to the middle of the gaps between them, at the ends by half the upper median, within the table."""
    ordered = F.transform(F.array_sort(F.transform(lines, lambda r, i: F.struct(r[low].alias("a"), i.alias("i"), r[high].alias("b")))), lambda r: F.struct(r["a"].alias("a"), r["b"].alias("b")))
    sizes = F.sort_array(F.transform(lines, lambda r: r[high] - r[low]))
    half = F.get(sizes, F.floor(F.size(lines) / 2).cast("int")) / 2

    def grown(r: Column, i: Column) -> Column:
        a = F.when(i == 0, F.greatest(r["a"] - half, outer_low)).otherwise((F.get(ordered, i - 1)["b"] + r["a"]) / 2)
        b = F.when(i == F.size(ordered) - 1, F.least(r["b"] + half, outer_high)).otherwise((r["b"] + F.get(ordered, i + 1)["a"]) / 2)
        return F.struct(a.alias("a"), b.alias("b"))

    return F.transform(ordered, grown)


def _first_holding(lines: Column, at: Column) -> Column:
    """Index of the first closed range, rounded to hundredths, that holds a position."""
    return F.array_min(F.transform(lines, lambda r, i: F.when((F.round(r["a"], 2) <= at) & (at <= F.round(r["b"], 2)), i)))


def _structured(df: DataFrame) -> DataFrame:
    """Tables with rows and columns, and their ranges."""
    t = df.where((F.col("type") == "table") & F.col("structure").isNotNull() & F.col("x1").isNotNull())
    t = t.where((F.size("structure.rows") > 0) & (F.size("structure.columns") > 0))
    return t.select(
        *PAGE,
        F.col("elem_idx").alias("t_idx"),
        *[F.col(c).alias(f"t_{c}") for c in BOX],
        ranges(F.col("structure.rows"), "y1", "y2", F.col("y1"), F.col("y2")).alias("_rows"),
        ranges(F.col("structure.columns"), "x1", "x2", F.col("x1"), F.col("x2")).alias("_columns"),
        F.col("structure.headers").alias("_headers"),
    )


def placed_words(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(page, t_idx, elem_idx, word_idx, word, row, col): the words of texts over a table, each in the first cell that holds its centre."""
    texts = df.where(is_text() & F.col("x1").isNotNull() & (F.col("content") != "")).select(*KEY, "content", *BOX)
    pairs = _structured(df).drop("_headers").join(texts, list(PAGE)).where(g.overlap_of_smaller(g.box("t_"), g.box()) >= config.cell_overlap)
    pairs = pairs.withColumn("_cy", (F.col("y1") + F.col("y2")) / 2)
    boxes = g.word_boxes(g.box(), tx.words(F.col("content")))
    words = pairs.select(*PAGE, "t_idx", "elem_idx", "_rows", "_columns", "_cy", F.posexplode(boxes).alias("word_idx", "w"))
    row, col = _first_holding(F.col("_rows"), F.col("_cy")), _first_holding(F.col("_columns"), (F.col("w.x1") + F.col("w.x2")) / 2)
    return words.select(*PAGE, "t_idx", "elem_idx", "word_idx", F.col("w.word").alias("word"), row.alias("row"), col.alias("col")).where("row is not null and col is not null")


def table_cells(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(page, t_idx, row, col, x1, y1, x2, y2, is_header, content): the grid of every structured table."""
    return _filled_cells(df, config).drop("_taken")


def _filled_cells(df: DataFrame, config: Config) -> DataFrame:
    """The cells, with the texts that gave a word to each."""
    t = _structured(df)
    grid = t.select(*PAGE, "t_idx", "_columns", "_headers", F.posexplode("_rows").alias("row", "r"))
    grid = grid.select(*PAGE, "t_idx", "_headers", "row", "r", F.posexplode("_columns").alias("col", "c"))
    header = F.exists(F.coalesce("_headers", F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")), lambda h: (h["x1"] < F.col("c.b")) & (h["x2"] > F.col("c.a")) & (h["y1"] < F.col("r.b")) & (h["y2"] > F.col("r.a")))
    grid = grid.select(*PAGE, "t_idx", "row", "col", *[F.round(v, 2).alias(k) for k, v in (("x1", "c.a"), ("y1", "r.a"), ("x2", "c.b"), ("y2", "r.b"))], header.alias("is_header"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("elem_idx", "word_idx", "word"))), lambda w: w["word"]), " ")
    filled = placed_words(df, config).groupBy(*PAGE, "t_idx", "row", "col").agg(joined.alias("content"), F.collect_set("elem_idx").alias("_taken"))
    return grid.join(filled, [*PAGE, "t_idx", "row", "col"], "left").withColumn("content", F.coalesce("content", F.lit("")))


def absorb_tables(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Texts that gave a word to a cell go, their table moves to the first of them, and elements are numbered anew.

    Words of such a text that no cell holds are lost with it; two tables may take the same text.
    """
    cell = F.struct("row", "col", F.array(*BOX).alias("bbox"), "content", "is_header")
    taken = F.array_distinct(F.flatten(F.collect_list("_taken"))).alias("_taken")
    cells = _filled_cells(df, config).groupBy(*PAGE, F.col("t_idx").alias("elem_idx")).agg(F.array_sort(F.collect_list(cell)).alias("cells"), (F.max("row") + 1).alias("num_rows"), (F.max("col") + 1).alias("num_columns"), taken)
    out = df.join(cells, list(KEY), "left").withColumn("_to", F.array_min("_taken"))
    out = out.withColumn("_gone", F.flatten(F.collect_list("_taken").over(page_window())))
    out = out.where(~F.coalesce(F.array_contains("_gone", F.col("elem_idx")) & is_text(), F.lit(False)))
    order = Window.partitionBy(*PAGE).orderBy(F.coalesce("_to", "elem_idx"), F.when(F.col("_to").isNotNull(), 0).otherwise(1), "elem_idx")
    return out.withColumn("elem_idx", (F.row_number().over(order) - 1).cast("long")).drop("_taken", "_to", "_gone", "structure")
