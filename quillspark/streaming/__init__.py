"""Streams of documents: a document is whole in one file, so no state crosses triggers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_elements(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Element files as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def run_batches(source: DataFrame, out: str, checkpoint: str, process: Callable[[DataFrame], DataFrame]):
    """Process each micro-batch with a batch plan; a batch that is run again overwrites its own output only."""

    def write(batch: DataFrame, batch_id: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return source.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def windowed_counts(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts and sums by event type in tumbling windows of event time; later events than the watermark are left out."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
