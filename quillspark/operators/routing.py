"""Which recognizer's reading of a line is taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.config import DEFAULT, Config
from quillspark.functions import geometry as g
from quillspark.functions import text as tx
from quillspark.schema import PAGE


def calibrated_confidence(log_prob: Column, config: Config = DEFAULT) -> Column:
    """A sequence's mean log probability as a confidence."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 + log_prob / config.confidence_divisor))


def line_regions(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Add `region_type`: the type of the first region that a line touches, null of none.

    A page's regions are few; they travel as one array on the page's row.
    """
    packed = regions.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("region_idx", "type", "x1", "y1", "x2", "y2"))).alias("_regions"))
    hit = F.filter("_regions", lambda r: g.intersects(g.box(), [r[c] for c in ("x1", "y1", "x2", "y2")]))
    return lines.join(packed, list(PAGE), "left").withColumn("region_type", F.get(hit, F.lit(0))["type"]).drop("_regions")


def route_lines(lines: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Text elements from lines with region_type, hw_text, hw_conf, document_type, document_confidence, has_signature and page_height.

    Lines below their gate go before any recognizer's text is looked at.
    """
    gate = F.when(F.col("region_type").isNotNull(), config.region_line_confidence).otherwise(config.line_confidence)
    kept = lines.where(F.col("confidence") >= gate)
    doc, sure = F.col("document_type"), F.col("document_confidence")
    route = (
        F.when(F.col("region_type").isNotNull(), "ensemble")
        .when((doc == "handwritten") & (sure >= config.handwritten_gate), "handwriting")
        .when((doc == "mixed") | (sure < config.handwritten_gate), "ensemble")
        .when((doc == "typed") & (F.col("confidence") < config.typed_retry_confidence) & (tx.strip(F.col("text")) != ""), "handwriting")
        .otherwise("print")
    )
    readable = F.coalesce(tx.strip(F.col("hw_text")) != "", F.lit(False))
    better = readable & (F.col("hw_conf") > F.col("confidence"))
    strict = better & (F.col("hw_conf") >= config.signature_gate)
    take = F.when(F.col("route") == "handwriting", readable & (F.col("hw_conf") >= config.region_line_confidence)).when(F.col("route") == "ensemble", F.when(F.col("region_type") == "signature", strict).otherwise(better)).otherwise(False)
    spaced = tx.punctuation_spacing(F.col("hw_text"))
    chosen = F.when(F.col("route") == "ensemble", tx.transfer_case(F.col("text"), spaced)).otherwise(spaced)
    zone = F.col("has_signature") & (F.when(F.col("page_height") > 0, F.col("y1") / F.col("page_height")).otherwise(F.lit(0.0)) >= config.signature_zone)
    out = kept.withColumn("route", route).withColumn("_take", F.coalesce(take, F.lit(False)))
    return out.withColumns(
        {
            "type": F.lit("text"),
            "content": F.when(F.col("_take"), chosen).otherwise(F.col("text")),
            "source_model": F.when(F.col("_take"), "trocr").otherwise("surya"),
            "in_signature_region": F.when(zone, True),
            "transcription_uncertain": F.when(zone, True),
        }
    ).drop("_take")


def page_text(df: DataFrame) -> DataFrame:
    """(page, text): the contents of a page's elements in order, blanks between them."""
    ordered = F.array_sort(F.collect_list(F.struct("elem_idx", F.coalesce("content", F.lit("")).alias("c"))))
    return df.groupBy(*PAGE).agg(F.array_join(F.transform(ordered, lambda e: e["c"]), " ").alias("text"))


def visual_elements(detections: DataFrame, width: Column, height: Column, labels: tuple[str, ...]) -> DataFrame:
    """Detected objects of the wanted labels, lower-cased, none of them too large."""
    label = F.lower("label")
    return detections.where(~g.too_large(g.box(), width, height, label) & label.isin(*labels)).withColumn("type", label)


def grounded_phrases(detections: DataFrame, width: Column, height: Column) -> DataFrame:
    """Grounded phrases as elements, whatever their label, none of them too large."""
    label = F.lower("label")
    return detections.where(~g.too_large(g.box(), width, height, label)).withColumns({"type": label, "description": F.concat(F.lit("Detected "), F.col("label"))})


def table_detections(detections: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Of a detector's boxes (label_id, confidence) those that are tables, label 0, and sure enough."""
    return detections.where((F.col("confidence") > threshold) & (F.col("label_id") == 0)).drop("label_id")


def structure_parts(detections: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Structure detections of table crops that are sure enough, shifted to the page and sorted into rows, columns, headers and cells.

    Needs keys, t_idx, label, confidence, box and the table's corner (t_x1, t_y1).
    """
    label = F.lower("label")
    header = label.contains("header")
    part = F.when(label.contains("row") & ~header, "rows").when(label.contains("column") & ~header, "columns").when(header, "headers").otherwise("cells")
    moved = detections.where(F.col("confidence") > threshold).withColumns({"part": part, "x1": F.col("x1") + F.col("t_x1"), "x2": F.col("x2") + F.col("t_x1"), "y1": F.col("y1") + F.col("t_y1"), "y2": F.col("y2") + F.col("t_y1")})
    item = F.struct("x1", "y1", "x2", "y2", "confidence")
    pick = lambda name, key: F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == name, F.struct(F.col(key).alias("k"), F.col("det_idx").alias("i"), item.alias("v"))))), lambda s: s["v"]).alias(name)
    return moved.groupBy(*PAGE, "t_idx").agg(pick("rows", "y1"), pick("columns", "x1"), pick("cells", "det_idx"), pick("headers", "det_idx"))
