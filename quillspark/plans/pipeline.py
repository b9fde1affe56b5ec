"""The eighteen post-processing steps, in order, as one chain of DataFrame transforms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillspark.config import DEFAULT, Config
from quillspark.operators import cleaning, contacts, regions, scoring, spelling, tables
from quillspark.schema import PAGE
from quillspark.sources.lineage import cut

STRUCTURE = "struct<rows:array<struct<x1:double,y1:double,x2:double,y2:double>>,columns:array<struct<x1:double,y1:double,x2:double,y2:double>>,headers:array<struct<x1:double,y1:double,x2:double,y2:double>>>"


def postprocess(df: DataFrame, vocabulary: DataFrame | None = None, image_width: Column | None = None, config: Config = DEFAULT, log: dict[str, Observation] | None = None) -> DataFrame:
    """Clean the element relation.

    Steps that drop rows measure the page anew on what is left.  The two table steps read the relation more than once, so
    it is written before each of them; all other steps are narrow or share the page's partitioning.  Without a vocabulary the spelling step is left out.
    `document_type` and `structure` may be missing.  Each step's counts are put into log, by its name, once the result has been written.
    """
    if "document_type" not in df.columns:
        df = df.withColumn("document_type", F.lit("typed"))
    if "structure" not in df.columns:
        df = df.withColumn("structure", F.lit(None).cast(STRUCTURE))
    df = df.repartition(*PAGE)
    steps: list[tuple[str, Callable[[DataFrame], DataFrame]]] = [
        ("empty regions", lambda d: regions.filter_empty_regions(d, config)),
        ("underscore fields", cleaning.normalize_underscore_fields),
        ("invalid tables", lambda d: tables.filter_invalid_tables(cut(d), config)),
        ("repeated layout", regions.deduplicate_layout),
        ("hallucinations", lambda d: scoring.process_hallucinations(d, image_width, config)),
        ("rotated margin", lambda d: regions.filter_rotated_margin(d, image_width)),
        ("clean text", cleaning.clean_text),
        ("classification override", lambda d: cleaning.classification_override(d, config)),
        ("trailing periods", cleaning.strip_trailing_periods),
        ("decimal dashes", cleaning.repair_decimal_dashes),
        ("parentheses", cleaning.repair_parentheses),
        *([("spelling", lambda d: spelling.correct_nonwords(cut(d), vocabulary))] if vocabulary is not None else []),
        ("signature text", cleaning.replace_signature_text),
        ("signature garbage", lambda d: regions.filter_signature_garbage(d, config)),
        ("duplicate words", cleaning.remove_duplicate_words),
        ("table cells", lambda d: tables.absorb_tables(cut(d), config)),
        ("phones", contacts.normalize_phones),
        ("validation", contacts.validate),
    ]
    for name, step in steps:
        df = step(df)
        if log is not None:
            log[name] = Observation(name)
            df = observed(df, log[name])
    return df


def observed(df: DataFrame, to: Observation | str) -> DataFrame:
    """df with its rows and texts counted under a step's name as they pass; no extra job."""
    return df.observe(to, F.count(F.lit(1)).alias("elements"), F.count_if(F.col("type") == "text").alias("texts"))


def nested(df: DataFrame) -> DataFrame:
    """(doc_id, pages): the nested form, pages and elements in order, for the JSON sink."""
    inner = [c for c in df.columns if c not in (*PAGE, "document_type", "classification_override", "x1", "y1", "x2", "y2")]
    element = F.struct("elem_idx", *[c for c in inner if c != "elem_idx"], F.when(F.col("x1").isNotNull(), F.array("x1", "y1", "x2", "y2")).alias("bbox"))
    over = F.max("classification_override") if "classification_override" in df.columns else F.lit(None).cast("struct<original:string>")
    pages = df.groupBy(*PAGE).agg(F.array_sort(F.collect_list(element), lambda a, b: (a["elem_idx"] - b["elem_idx"]).cast("int")).alias("elements"), F.max("document_type").alias("document_type"), over.alias("classification_override"))
    page = F.struct("page_no", "document_type", "classification_override", "elements")
    return pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(page), lambda a, b: (a["page_no"] - b["page_no"]).cast("int")).alias("pages"))
