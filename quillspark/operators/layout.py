"""Reading order and region lists: ordered folds over a page's boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.config import DEFAULT, Config
from quillspark.functions import geometry as g
from quillspark.schema import PAGE


def cluster_rows(df: DataFrame, threshold: float | None = None) -> DataFrame:
    """Add `row_id` and `reading_idx`: an element joins the row whose first element is near enough in y; rows run left to right.

    The threshold is 1.2 % of the lowest edge, 8 pixels at least.
    """
    item = F.struct("y1", "elem_idx")
    pages = df.groupBy(*PAGE).agg(F.array_sort(F.collect_list(item)).alias("_items"), F.max("y2").alias("_low"))
    near = F.lit(float(threshold)) if threshold is not None else F.greatest(F.lit(8.0), F.coalesce("_low", F.lit(0.0)) * 0.012)

    def step(acc: Column, e: Column) -> Column:
        same = (acc["row"] >= 0) & (F.abs(e["y1"] - acc["anchor"]) < near)
        row = F.when(same, acc["row"]).otherwise(acc["row"] + 1)
        done = F.concat(acc["done"], F.array(F.struct(e["elem_idx"].alias("elem_idx"), row.alias("row_id"))))
        return F.struct(row.alias("row"), F.when(same, acc["anchor"]).otherwise(e["y1"]).alias("anchor"), done.alias("done"))

    start = F.struct(F.lit(-1).alias("row"), F.lit(0.0).alias("anchor"), F.array().cast("array<struct<elem_idx:bigint,row_id:int>>").alias("done"))
    rows = pages.select(*PAGE, F.explode(F.aggregate("_items", start, step, lambda a: a["done"])).alias("r")).select(*PAGE, "r.elem_idx", "r.row_id")
    order = Window.partitionBy(*PAGE).orderBy("row_id", "x1", "y1", "elem_idx")
    return df.join(rows, [*PAGE, "elem_idx"]).withColumn("reading_idx", (F.row_number().over(order) - 1).cast("long"))


def handwritten_regions(detections: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(page, region_idx, type, box) from labelled detections (page, det_idx, label, box).

    Signatures come first and all stay; a handwriting box goes if one kept before covers more than half of it.
    """
    item = F.struct("det_idx", *g.box())
    mark = F.lower("label").contains("signature")
    pages = detections.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.when(mark, item))).alias("_s"), F.array_sort(F.collect_list(F.when(~mark, item))).alias("_h"))
    corners = lambda b: [b[c] for c in ("x1", "y1", "x2", "y2")]
    none = F.filter("_h", lambda b: F.lit(False))
    kept = F.aggregate("_h", none, lambda acc, b: F.when(F.exists(acc, lambda k: g.overlap_of(corners(b), corners(k), corners(b)) > config.region_repeat), acc).otherwise(F.concat(acc, F.array(b))))
    typed = lambda bs, name: F.transform(bs, lambda b: F.struct(F.lit(name).alias("type"), *[b[c].alias(c) for c in ("x1", "y1", "x2", "y2")]))
    every = F.concat(typed(F.col("_s"), "signature"), typed(kept, "handwriting"))
    return pages.select(*PAGE, F.posexplode(every).alias("region_idx", "r")).select(*PAGE, "region_idx", "r.*")


def append_order(*parts: DataFrame) -> DataFrame:
    """One element relation of several, each one's rows after those of the one before: `elem_idx` over the page."""
    out = None
    for rank, part in enumerate(parts):
        part = part.withColumn("_rank", F.lit(rank))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    order = Window.partitionBy(*PAGE).orderBy("_rank", "elem_idx")
    return out.withColumn("elem_idx", (F.row_number().over(order) - 1).cast("long")).drop("_rank")
