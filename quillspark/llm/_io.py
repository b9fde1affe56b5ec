"""Working tables in the folder that all executors share, and sizes of inputs."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ours: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder (spark.checkpoint.dir); a temporary one only where that is unset and all runs in one process."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not one_machine(spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _ours:
        _ours[key] = "file://" + tempfile.mkdtemp(prefix="quillspark-")
    return _ours[key]


def one_machine(master: str) -> bool:
    return master.split("[")[0] == "local"


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores before them until none is among columns, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def position(columns: list[str], name: str) -> int:
    """Where the column is, by the exact name or else in any case, as Spark resolves it."""
    return columns.index(name) if name in columns else [c.lower() for c in columns].index(name)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/quillspark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(delete, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


class Table:
    """A DataFrame written once and read back: its lineage is cut, and a lost executor costs no more than a rescan."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)


def spread(text: Column, limit: int, pieces: int = 32) -> Column:
    """The text, or of one of more than limit characters that many, in pieces at equal distances from its start to its end."""
    size = max(1, limit // pieces)
    at = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.substring(text, (1 + F.floor((F.length(text) - size) * i / (pieces - 1))).cast("int"), F.lit(size)))
    return F.when(F.length(text) > limit, F.array_join(at, "\n")).otherwise(text)


def text_bytes(df: DataFrame) -> int:
    """UTF-8 bytes of the texts, and some for each row, by a scan; a plan's own estimate may be off without bound."""
    got = df.agg(F.sum(F.octet_length("text").cast("long")), F.count("*")).first()
    return int(got[0] or 0) + 64 * int(got[1])
