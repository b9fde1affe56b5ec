"""Cutting lineage where a plan's branches would recompute what is above them, and dealing rows to tasks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, written once to the folder in spark.checkpoint.dir and read back; a temporary folder only where none is set and all runs in one process."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        told = spark.conf.get("spark.checkpoint.dir", None)
        if not told and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(told or "file://" + tempfile.mkdtemp(prefix="quillspark-"))
    return df.checkpoint()


def spread(df: DataFrame, rows: int) -> DataFrame:
    """df dealt evenly to tasks of about so many rows, for work that costs much a row; a few bytes a row make one task otherwise."""
    return df.repartition(max(1, -(-df.count() // rows)))
