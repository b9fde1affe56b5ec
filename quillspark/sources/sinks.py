"""Sinks: nested JSON by document, error records, and evaluation baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def as_json(nested: DataFrame) -> DataFrame:
    """(doc_id, value): one JSON object a document; fields without a value are left out."""
    columns = [c for c in nested.columns if c != "doc_id"]
    return nested.select("doc_id", F.to_json(F.struct(F.col("doc_id").cast("string").alias("filename"), *columns)).alias("value"))


def write_json(nested: DataFrame, path: str, buckets: int = 64) -> None:
    """JSON lines, one a document (its filename field tells which), in folders by hash of doc_id (path/bucket=...), however many documents there are."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket")
    as_json(nested).select(bucket, "value").write.mode("overwrite").partitionBy("bucket").text(path)


def write_elements(df: DataFrame, path: str) -> None:
    """The element relation by type of document, for analysis."""
    df.write.mode("overwrite").partitionBy("document_type").parquet(path)


def error_records(failed: DataFrame) -> DataFrame:
    """(doc_id, value): the record of a document that could not be processed, from (doc_id, processing_error)."""
    record = F.struct(F.col("doc_id").cast("string").alias("filename"), F.array().cast("array<string>").alias("pages"), "processing_error")
    return failed.select("doc_id", F.to_json(record).alias("value"))


def save_baseline(summary: DataFrame, path: str) -> None:
    summary.coalesce(1).write.mode("overwrite").json(path)


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
