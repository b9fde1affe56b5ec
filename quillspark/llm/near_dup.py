"""Near-duplicate grouping by MinHash.

A document's set is its distinct word shingles (ASCII-lower-cased words; a text
of fewer words is one shingle).  Equal sets are collapsed into one node first.
One-permutation hashing splits the hash range into equal bins and keeps each
bin's minimum; empty bins are filled by optimal densification (each probes
further bins by a universal hash of its own until one is filled).  Groups of
bins make band keys; nodes that share a key form a bucket.

Candidates are stars: each bucket links its members to one centre, the member
that meets the most others over all its buckets (the common original of edited
copies, where there is one), so a bucket of n nodes yields n-1 edges, and
buckets of one centre are one star.  A star's members are dealt into blocks of
bounded rows and bytes, each with the centre.  A task holds one block, counts
intersections of its full sets in integers and emits no more than the edges of
a spanning forest of its links.  Only a star of several blocks of which the
confirmed links leave several components needs more: its members outside the
centre's component are dealt into blocks anew, and each pair of blocks of which
one is such is a task.  So every two nodes that share a bucket and aren't
joined already are compared on their full sets; nothing is capped, and no pair
is emitted unless it is linked.  Components come from alternating large-star
and small-star rounds over tables in the shared folder.

Defined results: a text without words has an empty set and links with nothing;
repeated rows and equal texts share a node; a null doc_id never is a component's
smallest; an empty table gives an empty result; texts are used whole; columns of
the input, whatever their names, are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm._io import Table, fresh, position
from quillspark.llm._vec import U64, Words, buffers, chunks, grams, mix64


@dataclass(frozen=True)
class NearDupParams:
    """Links need 100 * intersection >= percent * union; 36 bands of 6 bins miss a pair at 0.8 with probability 2e-5."""

    shingle: int = 5
    percent: int = 80
    bands: int = 36
    rows: int = 6
    #: Bounds of a block's nodes and bytes of sets (a larger set is a block by itself).
    block_rows: int = 2048
    block_bytes: int = 16 << 20
    #: Up to so many ids of texts to read again (8 bytes each) are broadcast; more are joined.
    broadcast_ids: int = 4_000_000

    @property
    def bins(self) -> int:
        return self.bands * self.rows


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct shingle hashes of each text, ascending; first[i]:first[i+1] is text i."""
    words = Words(data, offsets)
    h = words.hashes()
    g, doc, _ = grams(h, words.first, k)
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        # The whole sequence as one shingle; its length is part of the hash.
        extra = np.empty(len(short), U64)
        with np.errstate(over="ignore"):
            for j, d in enumerate(short):
                v = U64(words.counts[d])
                for x in h[words.first[d] : words.first[d + 1]]:
                    v = mix64(np.array([v * U64(0x9E3779B97F4A7C15) + x], U64))[0]
                extra[j] = v
        g, doc = np.concatenate([g, extra]), np.concatenate([doc, short])
    # Sorting by text and hash: texts are in order but for the short ones.
    bounds = np.searchsorted(doc[: len(doc) - len(short)], np.arange(len(words.counts) + 1))
    parts, sizes = [], np.zeros(len(words.counts), np.int64)
    shorts = dict(zip(short.tolist(), range(len(doc) - len(short), len(doc))))
    for d in range(len(words.counts)):
        if d in shorts:
            u = g[shorts[d] : shorts[d] + 1]
        else:
            u = np.sort(g[bounds[d] : bounds[d + 1]])
            if len(u) > 1:
                u = u[np.concatenate([[True], u[1:] != u[:-1]])]
        parts.append(u)
        sizes[d] = len(u)
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), np.concatenate([[0], np.cumsum(sizes)])


def signatures(hashes: np.ndarray, first: np.ndarray, params: NearDupParams) -> np.ndarray:
    """One-permutation minima by text and bin, densified; rows of texts with empty sets mean nothing."""
    n, k = len(first) - 1, params.bins
    sig = np.zeros((n, k), U64)
    filled = np.zeros((n, k), bool)
    if len(hashes):
        doc = np.repeat(np.arange(n), np.diff(first))
        slot = doc * k + (((hashes >> U64(32)) * U64(k)) >> U64(32)).astype(np.int64)
        head = np.concatenate([[True], slot[1:] != slot[:-1]])
        sig.reshape(-1)[slot[head]] = hashes[head]
        filled.reshape(-1)[slot[head]] = True
    has = np.diff(first) > 0
    row, col = np.nonzero(~filled & has[:, None])
    base, attempt = filled.copy(), 0
    while len(row):
        attempt += 1
        probe = (mix64(col.astype(U64) * U64(1 << 20) + U64(attempt)) % U64(k)).astype(np.int64)
        hit = base[row, probe]
        sig[row[hit], col[hit]] = sig[row[hit], probe[hit]]
        row, col = row[~hit], col[~hit]
    return sig


def band_keys(sig: np.ndarray, params: NearDupParams) -> np.ndarray:
    v = sig.reshape(len(sig), params.bands, params.rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(mix64(np.arange(params.bands) + 77), v.shape[:2]).copy()
        for r in range(params.rows):
            key = mix64(key * U64(0x9E3779B97F4A7C15) + v[:, :, r])
    return key.view(np.int64)


def _fingerprint(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set."""
    out = []
    with np.errstate(over="ignore"):
        for salt in (11, 12):
            total = np.concatenate([np.zeros(1, U64), np.cumsum(mix64(hashes ^ mix64(np.array([salt]))[0]), dtype=U64)])
            out.append(mix64(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(U64)).view(np.int64))
    return out[0], out[1]


def _signed(df: DataFrame, params: NearDupParams) -> DataFrame:
    """doc_id, n, f1, f2, bands (null for an empty set) of each row."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("f1", T.LongType()), T.StructField("f2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for lo, hi, raw, offs in chunks(data, offsets):
                h, first = shingle_sets(raw, offs, params.shingle)
                keys = band_keys(signatures(h, first, params), params)
                n = np.diff(first)
                starts = np.arange(hi - lo + 1, dtype=np.int32) * params.bands
                bands = pa.ListArray.from_arrays(pa.array(starts), pa.array(keys.reshape(-1)), mask=pa.array(n == 0))
                f1, f2 = _fingerprint(h, first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(f1), pa.array(f2), bands], names=schema.names)

    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _sets(df: DataFrame, ids: DataFrame, params: NearDupParams) -> DataFrame:
    """doc_id, f1, f2, items (the set's hashes) of the rows whose doc_id is among ids (one column, low)."""
    spark = df.sparkSession
    texts = df.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ids = ids.distinct()
    shared = None
    if ids.count() <= params.broadcast_ids:
        known = ids.where("low is not null").toPandas()["low"].to_numpy(np.int64)
        shared = spark.sparkContext.broadcast((np.sort(known), not ids.where("low is null").isEmpty()))
    else:
        texts = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("low")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared is not None:
                known, nulls = shared.value
                has = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
                value = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(known, value), max(0, len(known) - 1))
                batch = batch.filter(pa.array(np.where(has, known[at] == value if len(known) else False, nulls)))
            data, offsets = buffers(batch.column(1))
            for lo, hi, raw, offs in chunks(data, offsets):
                h, first = shingle_sets(raw, offs, params.shingle)
                f1, f2 = _fingerprint(h, first)
                items = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(f1), [None, pa.py_buffer((first * 8).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(h))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(f1), pa.array(f2), items.cast(pa.binary())], names=["low", "f1", "f2", "items"])

    return texts.mapInArrow(run, "low long, f1 long, f2 long, items binary")


def overlaps(sets: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Sizes of the pairwise intersections: shingles of many sets by matrix products, those of few by their pairs."""
    r = len(sets)
    out = np.zeros((r, r), np.int32)
    h, owner = np.concatenate(sets), np.repeat(np.arange(r), [len(x) for x in sets])
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    count = np.diff(np.append(head, len(h)))
    dense = count > max(1, r // 10)
    column = np.repeat(np.where(dense, np.cumsum(dense) - 1, -1), count)
    for lo in range(0, int(dense.sum()), width):
        mine = np.flatnonzero((column >= lo) & (column < lo + width))
        x = np.zeros((r, min(width, int(dense.sum()) - lo)), np.float32)
        x[owner[mine], column[mine] - lo] = 1
        out += (x @ x.T).astype(np.int32)
    few = np.repeat((count > 1) & ~dense, count)
    owner, group = owner[few], np.repeat(np.arange(len(count)), count)[few]
    step = 1
    while step < len(owner):
        same = np.flatnonzero(group[step:] == group[:-step])
        if not len(same):
            break
        a, b = owner[same], owner[same + step]
        for lo in range(0, len(a), 1 << 22):
            np.add.at(out, (a[lo : lo + (1 << 22)], b[lo : lo + (1 << 22)]), 1)
            np.add.at(out, (b[lo : lo + (1 << 22)], a[lo : lo + (1 << 22)]), 1)
        step += 1
    return out


def forest(sets: list[np.ndarray], percent: int) -> tuple[list[int], list[int]]:
    """Edges (member, root) that span the components of the sets' links."""
    n = np.array([len(x) for x in sets], np.int64)
    common = overlaps(sets).astype(np.int64)
    ok = (common > 0) & (100 * common >= percent * (n[:, None] + n[None, :] - common))
    np.fill_diagonal(ok, False)
    left, u, v = np.ones(len(sets), bool), [], []
    for i in np.flatnonzero(ok.any(1)).tolist():
        if not left[i]:
            continue
        left[i], front = False, np.array([i])
        while len(front):
            front = np.flatnonzero(ok[front].any(0) & left)
            left[front] = False
            u += front.tolist()
            v += [i] * len(front)
    return u, v


def _linked(df: DataFrame, nodes: DataFrame, tasks: DataFrame, params: NearDupParams) -> DataFrame:
    """Spanning edges (u, v) of the links within each task; tasks: c, a, b (the task) and node, each task of bounded size."""
    wanted = nodes.join(tasks.select("node").distinct(), "node", "left_semi")
    here = tasks.join(nodes.select("node", "f1", "f2", "low", "again"), "node")
    parts = []
    for again in (False, True):
        ids = wanted.where(F.col("again") == again).select("low")
        if again and ids.isEmpty():
            break
        sets = _sets(df, ids, params)
        # Rows of one doc_id and set more than once: one of them is enough.
        sets = sets.dropDuplicates(["low", "f1", "f2"]) if again else sets
        mine = here.where(F.col("again") == again).withColumnRenamed("low", "l").alias("t")
        match = (F.col("s.f1") == F.col("t.f1")) & (F.col("s.f2") == F.col("t.f2")) & F.col("s.low").eqNullSafe(F.col("t.l"))
        parts.append(sets.alias("s").join(mine, match).select("c", "a", "b", "node", "items"))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, members, sets = None, [], []

        def solved() -> pa.RecordBatch:
            u, v = forest(sets, params.percent) if len(sets) > 1 else ([], [])
            at = np.array(members, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(at[u] if u else [], pa.int64()), pa.array(at[v] if v else [], pa.int64())], names=["u", "v"])

        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(4)))
            for (c, a, b, node), x in zip(keys, batch.column(4)):
                if (c, a, b) != task:
                    if len(sets) > 1:
                        yield solved()
                    task, members, sets = (c, a, b), [], []
                members.append(node)
                sets.append(np.frombuffer(x.as_buffer(), U64))
        if len(sets) > 1:
            yield solved()

    return rows.repartition("c", "a", "b").sortWithinPartitions("c", "a", "b").mapInArrow(run, "u long, v long")


def _blocks(rows: Column, hashes: Column, params: NearDupParams) -> Column:
    """How many blocks so many rows and hashes need."""
    return F.greatest(F.lit(1), F.ceil(rows / params.block_rows), F.ceil(hashes * 8 / params.block_bytes)).cast("long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge (u, v); root is the smallest node reachable.

    Alternating large-star and small-star rounds; each works on minima by node, so no neighbourhood is gathered.
    """
    now = Table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        e = now.df
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        mid = Table(large, "edges")
        now.drop()
        small = mid.df.groupBy("u").agg(F.min("v").alias("m"))
        out = mid.df.join(small, "u")
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        now = Table(out, "edges")
        mid.drop()
        state = tuple(now.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    e = now.df
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def classes(df: DataFrame, params: NearDupParams = NearDupParams()) -> DataFrame:
    """One row per input row: doc_id, n (set size), f1, f2 (set), root (node id of its component, null for an empty set), component_id."""
    signed = Table(_signed(df, params).withColumn("rid", F.monotonically_increasing_id()), "signed")
    rows = signed.df.drop("bands")
    full = rows.where("n > 0")
    by_id = full.groupBy("f1", "f2", "doc_id").agg(F.min("rid").alias("rid"), F.count("*").alias("copies"), F.min("n").alias("n"))
    again = F.min_by(F.col("copies") > 1, F.struct(F.col("doc_id").isNull(), F.col("doc_id")))
    reps = by_id.groupBy("f1", "f2").agg(F.min("rid").alias("node"), F.min("doc_id").alias("low"), F.min("n").alias("n"), again.alias("again"))
    nodes = Table(reps, "nodes")
    banded = signed.df.where("n > 0").join(nodes.df.select(F.col("node").alias("rid")), "rid", "left_semi").select(F.col("rid").alias("node"), F.explode("bands").alias("key"))
    bucket = banded.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    buckets = Table(banded.join(bucket, "key"), "buckets")

    met = buckets.df.groupBy("node").agg(F.sum("members").alias("met"))
    centres = buckets.df.join(met, "node").groupBy("key").agg(F.max_by("node", F.struct("met", -F.col("node"))).alias("c"))
    sizes = nodes.df.select("node", "n")
    edges = buckets.df.join(centres, "key").where("node <> c").select("c", "node").distinct()
    edges = edges.join(sizes, "node").join(sizes.select(F.col("node").alias("c"), F.col("n").alias("nc")), "c")
    star = edges.groupBy("c").agg((F.count("*") + 1).alias("rows"), (F.sum("n") + F.first("nc")).alias("hashes"), F.min("n").alias("small"), F.first("nc").alias("nc"))
    # Two nodes alone are refused by their sizes where these are too unlike.
    star = star.where(f"rows > 2 or 100 * least(small, nc) >= {params.percent} * greatest(small, nc)")
    star = Table(star.select("c", "nc", _blocks(F.col("rows"), F.col("hashes"), params).alias("blocks")), "stars")
    members = Table(edges.select("c", "node", "n").join(star.df.select("c", "blocks"), "c"), "members")
    buckets.drop()

    zero = F.lit(0).cast("long").alias("a")
    dealt = members.df.select("c", zero, F.pmod(F.xxhash64("node"), F.col("blocks")).alias("b"), "node")
    dealt = dealt.unionByName(star.df.select("c", zero, F.explode(F.expr("sequence(0L, blocks - 1)")).alias("b"), F.col("c").alias("node")))
    links = Table(_linked(df, nodes.df, dealt, params), "links")
    labels = Table(components(links.df), "labels")

    wide = star.df.where("blocks > 1")
    if not wide.isEmpty():
        rest = members.df.where("blocks > 1").select("c", "node", "n").unionByName(wide.select("c", F.col("c").alias("node"), F.col("nc").alias("n")))
        rest = rest.join(labels.df, "node", "left").withColumn("root", F.coalesce("root", "node"))
        home = wide.select(F.col("c").alias("node")).join(labels.df, "node", "left").select(F.col("node").alias("c"), F.coalesce("root", "node").alias("home"))
        rest = rest.join(home, "c").select("c", "node", "n", (F.col("root") != F.col("home")).alias("out"))
        rest = Table(rest, "rest")
        out = F.col("out").cast("long")
        cut = rest.df.groupBy("c").agg(F.sum(out).alias("ro"), F.sum(out * F.col("n")).alias("ho"), F.sum(1 - out).alias("rm"), F.sum((1 - out) * F.col("n")).alias("hm")).where("ro > 0")
        cut = cut.select("c", _blocks(F.col("ro"), F.col("ho"), params).alias("no"), _blocks(F.col("rm"), F.col("hm"), params).alias("nm"))
        # Blocks 0 to no - 1 are of nodes outside the centre's component; each meets every block once.
        own = F.when(F.col("out"), F.pmod(F.xxhash64("node"), F.col("no"))).otherwise(F.col("no") + F.pmod(F.xxhash64("node"), F.col("nm")))
        others = F.when(F.col("out"), F.expr("sequence(0L, no + nm - 1)")).otherwise(F.expr("sequence(0L, no - 1)"))
        pairs = rest.df.join(cut, "c").select("c", "node", own.alias("own"), F.explode(others).alias("other")).select("c", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node")
        more = Table(_linked(df, nodes.df, pairs, params), "links")
        if not more.df.isEmpty():
            labels.drop()
            labels = Table(components(links.df.unionByName(more.df)), "labels")
        rest.drop()
        more.drop()
    for t in (star, members, links):
        t.drop()
    placed = nodes.df.join(labels.df, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lows = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    final = placed.select("f1", "f2", "root").join(lows, "root")
    out = rows.withColumn("_full", F.col("n") > 0).join(final.withColumn("_full", F.lit(True)), ["f1", "f2", "_full"], "left").drop("_full")
    return out.withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))


def deduplicate(df: DataFrame, params: NearDupParams = NearDupParams()) -> DataFrame:
    """df with one row of each group: that of its smallest doc_id (null ids last).  Rows without words stay; extra columns are kept."""
    c = Table(classes(df, params), "classes").df
    best = F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("rid").alias("c")))
    chosen = c.where("n > 0").groupBy("root").agg(best.alias("k")).select(F.col("k.c").alias("rid"))
    names = df.columns
    d, f1, f2, n, again = fresh(names, "d", "f1", "f2", "n", "again")
    kept = c.join(chosen, "rid", "left_semi").select(F.col("doc_id").alias("d"), "f1", "f2")
    # A chosen row is found again by its doc_id and set; where several rows have both, one of them is taken.
    rows = c.where("n > 0").groupBy("doc_id", "f1", "f2").agg((F.count("*") > 1).alias("again"))
    same = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k.f1") == F.col("r.f1")) & (F.col("k.f2") == F.col("r.f2"))
    kept = Table(kept.alias("k").join(rows.alias("r"), same).select(F.col("d").alias(d), F.col("k.f1").alias("k1"), F.col("k.f2").alias("k2"), F.col("again").alias(again)), "kept").df
    k1, k2 = fresh([*names, d, f1, f2, n, again], "k1", "k2")
    kept = kept.withColumnsRenamed({"k1": k1, "k2": k2})
    schema = T.StructType([*df.schema.fields, *(T.StructField(x, T.LongType()) for x in (n, f1, f2))])
    at = position(names, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(at).cast(pa.string()))
            for lo, hi, raw, offs in chunks(data, offsets):
                h, first = shingle_sets(raw, offs, params.shingle)
                g1, g2 = _fingerprint(h, first)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(first)), pa.array(g1), pa.array(g2)], names=schema.names)

    own = [F.col(f"`{x}`") for x in names]
    marked = df.mapInArrow(run, schema)
    out = marked.where(F.col(n) == 0).select(*own)
    match = F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.col(f1) == F.col(k1)) & (F.col(f2) == F.col(k2))
    for repeated in (False, True):
        wanted = kept.where(F.col(again) == repeated)
        if repeated and wanted.isEmpty():
            break
        full = marked.where(F.col(n) > 0).join(wanted, match, "left_semi")
        out = out.unionByName((full.dropDuplicates(["doc_id", f1, f2]) if repeated else full).select(*own))
    return out


def oracle(params: NearDupParams = NearDupParams()) -> str:
    """DuckDB SQL for the components of documents, from all pairs that share a shingle; for small tables with distinct doc_ids."""
    k, upper = params.shingle, "".join(map(chr, range(65, 91)))
    run = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) >= {k} THEN list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: {run})) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS x FROM t),
 f AS MATERIALIZED (SELECT doc_id, len(x) AS n, unnest(x) AS g FROM s),
 c AS (SELECT a.doc_id AS u, b.doc_id AS v, a.n AS p, b.n AS q, count(*) AS shared FROM f a JOIN f b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {params.percent} * greatest(a.n, b.n) GROUP BY ALL),
 l AS MATERIALIZED (SELECT u, v FROM c WHERE 100 * shared >= {params.percent} * (p + q - shared)),
 e AS MATERIALIZED (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
 r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u),
 m AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT doc_id, len(x)::BIGINT AS n_shingles, low AS component_id, doc_id = low AS kept FROM s JOIN m ON a = doc_id"""
