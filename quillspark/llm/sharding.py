"""Two-pass external shuffle into shards of equal row counts.

Pass one scatters rows over buckets small enough for one task's memory, by a
seeded hash of the row.  Pass two reads a bucket, puts it in a canonical order,
applies a seeded Fisher-Yates permutation and deals the rows out: the global
position of a row is its bucket's offset plus its place in the permutation,
shard = position mod shards and slot = position div shards.  Shard sizes are
thus at most one apart, and the slots of a shard have no gaps.

Rows that occur very often (the same doc_id and text more than `hot_rows` times,
or a quarter of a bucket's bytes) would all hash to one bucket; their copies are
spread by row position.

Defined results: nulls hash as nulls and keep their rows; an empty table gives
an empty result; repeated rows each get their own slot; columns of the input
named shard or slot are replaced, and those of any other name are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillspark.llm._io import Table, fresh, text_bytes

ADDED = ("shard", "slot")


@dataclass(frozen=True)
class ShardParams:
    shards: int = 16
    seed: int = 20240
    bucket_bytes: int = 16 << 20
    hot_rows: int = 1000
    max_broadcast_rows: int = 200_000


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """Seeded permutation of range(n); numpy's permutation is a Fisher-Yates shuffle."""
    return np.random.default_rng(seed).permutation(n)


def scatter(df: DataFrame, params: ShardParams, buckets: int) -> DataFrame:
    """Pass one: two columns more, the key of each row within its bucket and the bucket (`_k` and `_b`, or as `inner` names them)."""
    k, b, _ = inner(df.columns)
    hot, spread, n, size = fresh([*df.columns, k, b], "hot", "spread", "n", "size")
    key: Column = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if c.lower() in ("doc_id", "text")] or [F.lit(0)])
    bytes_ = F.octet_length("text") if "text" in {c.lower() for c in df.columns} else F.lit(0)
    df = df.withColumn(k, key)
    most = df.groupBy(k).agg(F.count("*").alias(n), F.sum(F.coalesce(bytes_.cast("long"), F.lit(0))).alias(size))
    most = most.where((F.col(n) > params.hot_rows) | ((F.col(n) > 1) & (F.col(size) > params.bucket_bytes // 4)))
    known = Table(most.select(k, F.lit(True).alias(hot)), "hot").df
    # Usually none; a join of the wide rows is needed only where the hot keys don't fit a broadcast.
    df = df.join(F.broadcast(known) if known.count() <= params.max_broadcast_rows else known, k, "left")
    apart = F.when(F.col(hot), F.monotonically_increasing_id()).otherwise(F.lit(0))
    df = df.withColumn(spread, apart)
    return df.withColumn(b, F.pmod(F.xxhash64(F.lit(params.seed), k, spread), F.lit(buckets)).cast("int")).drop(hot, spread)


def inner(columns: list[str]) -> list[str]:
    """Names of the key, the bucket and the place in it that aren't among columns."""
    return fresh(columns, "_k", "_b", "_p")


def shuffle(df: DataFrame, params: ShardParams = ShardParams()) -> Table:
    """Write df in shuffled order, one row group run per bucket, without columns named as the added ones, with the bucket and the place in it (`inner`)."""
    keep = [c for c in df.columns if c.lower() not in ADDED]
    df = df.select(*[F.col(f"`{c}`") for c in keep])
    k, b, p = inner(keep)
    buckets = max(1, -(-text_bytes(df) // params.bucket_bytes))
    scattered = scatter(df, params, buckets)
    names = [*keep, k, b]
    placed = T.StructType([*df.schema.fields, T.StructField(b, T.IntegerType()), T.StructField(p, T.LongType())])
    seed = params.seed

    def permute(bucket: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        rank = np.empty(len(table), dtype=np.int64)
        key = table.column(table.num_columns - 2).to_numpy()
        rank[fisher_yates(len(table), seed * 1_000_003 + bucket)] = np.arange(len(table))
        where = np.empty_like(rank)
        where[np.argsort(key, kind="stable")] = rank
        order = np.argsort(where)
        out = table.select(range(table.num_columns - 2)).take(pa.array(order))
        out = out.append_column(b, pa.array(np.full(len(order), bucket, np.int32))).append_column(p, pa.array(np.arange(len(order))))
        yield from out.combine_chunks().to_batches(max_chunksize=4096)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi == lo:
                    continue
                if parts and at[lo] != now:
                    yield from permute(now, parts)
                    parts = []
                now = int(at[lo])
                parts.append(batch.slice(lo, hi - lo))
        if parts:
            yield from permute(now, parts)

    whole = scattered.select(*[F.col(f"`{c}`") for c in names]).repartitionById(min(buckets, 50_000), F.col(b) % F.lit(min(buckets, 50_000))).sortWithinPartitions(b).mapInArrow(run, placed)
    return Table(whole, "shuffled")


def offsets(shuffled: DataFrame, bucket: str = "_b", group: int = 4096) -> DataFrame:
    """(bucket, _before): rows before each bucket, by prefix sums within groups of buckets and over the groups."""
    counts = shuffled.groupBy(F.col(bucket).alias("_b")).agg(F.count("*").alias("_n")).withColumn("_g", F.floor(F.col("_b") / group))
    ahead = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = counts.groupBy("_g").agg(F.sum("_n").alias("_n")).select("_g", ahead(Window.orderBy("_g")).alias("_earlier"))
    within = counts.withColumn("_inside", ahead(Window.partitionBy("_g").orderBy("_b")))
    return within.join(groups, "_g").select(F.col("_b").alias(bucket), (F.col("_earlier") + F.col("_inside")).alias("_before"))


def assign(df: DataFrame, params: ShardParams = ShardParams()) -> DataFrame:
    """df, shuffled and written, with `shard` (0 to shards-1) and `slot` (0, 1, ... within the shard)."""
    written = shuffle(df, params).df
    _, b, p = inner(written.columns[:-2])
    (before,) = fresh(written.columns, "_before")
    starts = Table(offsets(written, b), "offsets").df.withColumnRenamed("_before", before)
    out = written.join(F.broadcast(starts) if starts.count() <= params.max_broadcast_rows else starts, b)
    at = F.col(before) + F.col(p)
    keep = [F.col(f"`{c}`") for c in written.columns if c not in (b, p)]
    return out.select(*keep, F.pmod(at, F.lit(params.shards)).cast("int").alias("shard"), F.floor(at / F.lit(params.shards)).cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str, params: ShardParams = ShardParams()) -> None:
    """One folder a shard (path/shard=0 ...), its rows in slot order within each file."""
    assign(df, params).repartition(params.shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
