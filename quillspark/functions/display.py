"""How elements are shown: colours and kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLOURS = {
    "figure": "#228b22",
    "human face": "#228b22",
    "image": "#228b22",
    "layout_region": "#b4b4b4",
    "logo": "#00b4b4",
    "seal": "#b400b4",
    "signature": "#9400d3",
    "table": "#0064c8",
    "text": "#1e90ff",
}
HANDWRITTEN, DOUBTFUL, OTHER = "#ff8c00", "#ff3232", "#c8c8c8"
COUNTED = ("layout_region", "table", "signature", "logo")


def colour(kind: Column, source: Column, hallucination: Column) -> Column:
    """Hex colour: by type, the handwriting recognizer's text apart, doubtful text above all."""
    out = F.lit(OTHER)
    for name, value in COLOURS.items():
        out = F.when(F.lower(kind) == name, F.lit(value)).otherwise(out)
    out = F.when((F.lower(kind) == "text") & (source == "trocr"), F.lit(HANDWRITTEN)).otherwise(out)
    return F.when(hallucination >= 0.40, F.lit(DOUBTFUL)).otherwise(out)


def bucket(kind: Column, source: Column) -> Column:
    low = F.lower(kind)
    return F.when((low == "text") & (source == "trocr"), "text_trocr").when(low == "text", "text").when(low.isin(*COUNTED), low).otherwise("other")


def label(content: Column, source: Column, confidence: Column, hallucination: Column) -> Column:
    """A text element's caption: its start, then who read it, how surely, and its hallucination score."""
    from quillspark.functions.text import truncate

    notes = F.array_compact(F.array(F.when(source == "trocr", "TrOCR"), F.when(confidence.isNotNull(), F.format_string("%.2f", confidence)), F.when(hallucination.isNotNull(), F.format_string("H:%.2f", hallucination))))
    shown = F.when(F.size(notes) > 0, F.concat(F.lit("["), F.array_join(notes, " | "), F.lit("]")))
    return F.concat_ws(" ", F.when(truncate(content) != "", truncate(content)), shown)


def shown(df: DataFrame, layout: bool = False, content: bool = True, confidence: bool = True) -> DataFrame:
    """What a viewer draws of each element: its box, colour and caption; layout regions only if asked for."""
    kept = df if layout else df.where(~F.col("type").eqNullSafe("layout_region"))
    score = F.col("hallucination_score") if "hallucination_score" in df.columns else F.lit(None).cast("double")
    none = F.lit(None).cast("string")
    caption = label(F.col("content") if content else none, F.col("source_model"), F.col("confidence") if confidence else F.lit(None).cast("double"), score)
    return kept.select("doc_id", "page_no", "elem_idx", "type", "x1", "y1", "x2", "y2", colour(F.col("type"), F.col("source_model"), score).alias("colour"), F.when(F.lower("type") == "text", caption).alias("label"))
