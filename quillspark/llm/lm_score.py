"""Language-model scoring with a log-frequency Bloom filter.

Tokens are ASCII-lower-cased words, then one end of text.  All training texts
are counted: each task sorts and adds up the hashes of its tokens and bigrams
and ships them as packed runs by hash range, so the exchange costs about nine
bytes a distinct n-gram and task; each range is merged by streaming its runs.

The filter is one of segments, a segment a hash range.  An n-gram of count c is
held at the levels 1 to 1 + floor(log2 c): level j is a set of bits chosen by
hashes of the n-gram and j.  A count is read back by probing level after level
until one is missing.  Bigram and word estimates are interpolated.

The filter and the exact word counts are broadcast only while they are within
`max_filter_bytes` and `max_vocab_bytes`.  Beyond, the hashes of each run of
texts are sent to the segments of their ranges, probed there and sent back: the
same bits and hashes, false positives included, so equal scores at every size.

Defined results: a null text is an empty one (one token, the end); long texts
are scored whole; repeated rows get equal scores; without training texts every
count is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm._io import Table, text_bytes
from quillspark.llm._vec import U64, Words, buffers, chunks, mix64, sum_ranges

END = mix64(np.array([424242], U64))[0]
WORD, PAIR = 0, 1


@dataclass(frozen=True)
class LmParams:
    hashes: int = 6
    bits_per_item: float = 9.0
    bigram_weight: float = 0.5
    smoothing: float = 0.1
    range_bytes: int = 16 << 20
    held_tokens: int = 1_500_000
    max_vocab_bytes: int = 128 << 20
    max_filter_bytes: int = 128 << 20


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes, bigram hashes, first) of a run of texts; each text's last token is its end, and its first one's bigram begins with an end."""
    w = Words(raw, offsets)
    h = w.hashes()
    n = w.counts + 1
    first = np.concatenate([[0], np.cumsum(n)])
    out = np.full(int(first[-1]), END, U64)
    ends = np.zeros(len(out), bool)
    ends[first[1:] - 1] = True
    out[~ends] = h
    before = np.concatenate([np.array([END], U64), out[:-1]])
    with np.errstate(over="ignore"):
        return out, mix64(before * U64(0x9E3779B97F4A7C15) + out), first


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return (((keys >> U64(32)) * U64(ranges)) >> U64(32)).astype(np.int64)


def _added(keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their counts added up."""
    if counts is None:
        keys = np.sort(keys)
        head = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
        return keys[head], np.diff(np.append(head, len(keys))).astype(np.uint32)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[head], np.add.reduceat(counts, head) if len(head) else counts


def by_range(k: np.ndarray, ranges: int, *values: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """The ranges that ascending keys k fall into, and of each range the bytes of its keys and values."""
    cuts = np.searchsorted(range_of(k, ranges), np.arange(ranges + 1))
    some = np.flatnonzero(np.diff(cuts))
    ends = np.append(cuts[some], cuts[-1])
    return some, [pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(ends * a.itemsize), pa.py_buffer(a)]).cast(pa.binary()) for a in (k, *values)]


SEGMENT = "range int, bits binary, size long, keys binary, counts binary, n long, total long"


def count(training: DataFrame, params: LmParams = LmParams()) -> tuple[Table, int]:
    """The filter's segments and the words' counts over all training texts as rows of SEGMENT, one a range; and the number of ranges."""
    spark = training.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(training) // params.range_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {WORD: [], PAIR: []}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                if not parts:
                    continue
                k, c = _added(np.concatenate(parts), None)
                some, packed = by_range(k, ranges, c)
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), kind, np.int32)), *packed], names=["range", "kind", "keys", "counts"])

        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for _, _, raw, offs in chunks(data, offsets):
                t, p, _ = tokens(raw, offs)
                held[WORD].append(t)
                held[PAIR].append(p)
                size += len(t)
                if size >= params.held_tokens:
                    yield from out()
                    held, size = {WORD: [], PAIR: []}, 0
        yield from out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        runs: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        waiting: dict[tuple[int, int], int] = {}
        for batch in batches:
            for r, kind, k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                at = (r, kind)
                runs.setdefault(at, []).append((np.frombuffer(k.as_py(), U64), np.frombuffer(c.as_py(), np.uint32).astype(np.int64)))
                waiting[at] = waiting.get(at, 0) + 1
                if waiting[at] >= 64:
                    runs[at] = [_added(np.concatenate([x for x, _ in runs[at]]), np.concatenate([x for _, x in runs[at]]))]
                    waiting[at] = 1
        for (r, kind), parts in sorted(runs.items()):
            k, c = _added(np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts]))
            yield r, kind, k, c.astype(np.int64)

    def seal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, group in itertools.groupby(merge(batches), key=lambda x: x[0]):
            parts, words = [], (b"", b"", 0, 0)
            for _, kind, k, c in group:
                parts.append((kind, k, c))
                if kind == WORD:
                    words = (k.tobytes(), c.tobytes(), len(k), int(c.sum()))
            bits, size = segment(parts, params)
            yield pa.RecordBatch.from_pylist([dict(zip((c.split()[0] for c in SEGMENT.split(", ")), (r, bits.tobytes(), size, *words)))], schema=pa.schema([("range", pa.int32()), ("bits", pa.binary()), ("size", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("n", pa.int64()), ("total", pa.int64())]))

    packed = training.select(F.col("text").cast("string")).mapInArrow(run, "range int, kind int, keys binary, counts binary")
    packed = packed.repartitionById(min(ranges, 50_000), F.col("range") % F.lit(min(ranges, 50_000)))
    return Table(packed.mapInArrow(seal, SEGMENT), "segments"), ranges


def levels_of(counts: np.ndarray) -> np.ndarray:
    """The quantised count: 1 + floor(log2 c)."""
    return np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1


def estimate(level: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level; 0 of level 0."""
    return np.where(level > 0, 1.5 * 2.0 ** (level - 1) - 0.5, 0.0)


class Filter:
    """Segments of bits in one array; offsets and sizes (in bits) by range."""

    def __init__(self, bits: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, hashes: int):
        self.bits, self.offsets, self.sizes, self.hashes = bits, offsets, sizes, hashes

    @staticmethod
    def places(key: np.ndarray, kind: int, level: int, j: int, size: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64(key + U64(1_000_003) * U64(level * 64 + j * 2 + kind + 1)) % size

    def probe(self, key: np.ndarray, kind: int, level: int) -> np.ndarray:
        r = range_of(key, len(self.sizes))
        alive = np.flatnonzero(self.sizes[r] > 0)
        for j in range(self.hashes):
            at = self.places(key[alive], kind, level, j, self.sizes[r[alive]].astype(U64)).astype(np.int64) + self.offsets[r[alive]]
            alive = alive[(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
        return alive

    def level(self, key: np.ndarray, kind: int) -> np.ndarray:
        """The highest level up to which all are held."""
        out = np.zeros(len(key), np.int64)
        alive, level = np.arange(len(key)), 0
        while len(alive):
            level += 1
            alive = alive[self.probe(key[alive], kind, level)]
            out[alive] = level
        return out


def segment(parts: list[tuple[int, np.ndarray, np.ndarray]], params: LmParams) -> tuple[np.ndarray, int]:
    """(bits, size) of one range, from (kind, keys, counts)."""
    levels = [(kind, k, levels_of(c)) for kind, k, c in parts]
    items = sum(int(v.sum()) for _, _, v in levels)
    size = max(64, -(-int(items * params.bits_per_item) // 64) * 64) if items else 0
    flags = np.zeros(size, np.uint8)
    for kind, k, v in levels:
        for level in range(1, int(v.max(initial=0)) + 1):
            mine = k[v >= level]
            for j in range(params.hashes):
                flags[Filter.places(mine, kind, level, j, np.array([size], U64)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little"), size


def _log10(pair: np.ndarray, context: np.ndarray, word: np.ndarray, total: int, distinct: int, params: LmParams) -> np.ndarray:
    """log10 of the interpolated probability, from count estimates."""
    a = params.smoothing
    plain = (word + a) / (total + a * (distinct + 1))
    ratio = np.minimum(1.0, np.divide(pair, context, out=np.zeros(len(pair)), where=context > 0))
    share = np.where(context > 0, params.bigram_weight, 0.0)
    return np.log10(share * ratio + (1 - share) * np.minimum(plain, 1.0))


@dataclass
class LmModel:
    keys: np.ndarray
    counts: np.ndarray
    filter: Filter
    total: int
    distinct: int
    params: LmParams


def score_run(raw: np.ndarray, offsets: np.ndarray, m: LmModel) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n_tokens, n_known, base_score, score) of a run of texts."""
    t, p, first = tokens(raw, offsets)
    key, inverse = np.unique(t, return_inverse=True)
    at = np.searchsorted(m.keys, key)
    at[at == len(m.keys)] = 0
    c = np.where(m.keys[at] == key, m.counts[at], 0) if len(m.keys) else np.zeros(len(key), np.int64)
    return scored(first, key, inverse, c, m.filter.level(key, WORD), m.filter.level(p, PAIR), m.total, m.distinct, m.params)


def scored(first: np.ndarray, key: np.ndarray, inverse: np.ndarray, c: np.ndarray, level: np.ndarray, pair_level: np.ndarray, total: int, distinct: int, params: LmParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same from the distinct tokens' counts and levels and the levels of all bigrams."""
    a = params.smoothing
    base = np.log10((c + a) / (total + a * (distinct + 1)))
    held = estimate(level)
    word = held[inverse]
    ends = held[np.searchsorted(key, END)]
    context = np.concatenate([[ends], word[:-1]])
    value = _log10(estimate(pair_level), context, word, total, distinct, params)
    return np.diff(first), sum_ranges((c > 0).astype(np.int64)[inverse], first), sum_ranges(base[inverse], first), sum_ranges(value, first)


RESULT = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, trainable: Column, params: LmParams = LmParams()) -> DataFrame:
    """One row a document; the model learns from the rows where trainable holds, over all of them."""
    table, ranges = count(docs.where(F.coalesce(trainable, F.lit(True))), params)
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return _by_segments(slim, table.df, ranges, params)


def _broadcast(slim: DataFrame, model: LmModel) -> DataFrame:
    shared = slim.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for lo, hi, raw, offs in chunks(data, offsets):
                n, known, base, value = score_run(raw, offs, m)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(known), pa.array(np.full(hi - lo, m.total, np.int64)), pa.array(base), pa.array(value)], names=[c.split()[0] for c in RESULT.split(", ")])

    return slim.mapInArrow(run, RESULT)


def _by_segments(slim: DataFrame, segments: DataFrame, ranges: int, params: LmParams) -> DataFrame:
    """Scores by the filter's segments, broadcast where they and the words are within the bounds."""
    sums = segments.agg(F.sum("n"), F.sum("total"), F.sum(F.octet_length("bits"))).first()
    distinct, total, bits = (int(x or 0) for x in sums)
    if 16 * distinct > params.max_vocab_bytes or bits > params.max_filter_bytes:
        return _probed(slim, segments, ranges, total, distinct, params)
    sizes, known = np.zeros(ranges, np.int64), np.zeros(ranges, np.int64)
    for r in segments.select("range", "size", "n").collect():
        sizes[r["range"]], known[r["range"]] = r["size"], r["n"]
    offsets, first = (np.concatenate([[0], np.cumsum(x)]) for x in (sizes, known))
    held, keys, counts = np.zeros(bits, np.uint8), np.zeros(distinct, U64), np.zeros(distinct, np.int64)
    # A partition at a time and into place, as the driver would hold several copies of the filter else.
    for r in segments.select("range", "bits", "keys", "counts").toLocalIterator():
        at = r["range"]
        held[offsets[at] // 8 : offsets[at + 1] // 8] = np.frombuffer(r["bits"], np.uint8)[: sizes[at] // 8]
        keys[first[at] : first[at + 1]], counts[first[at] : first[at + 1]] = np.frombuffer(r["keys"], U64), np.frombuffer(r["counts"], np.int64)
    return _broadcast(slim, LmModel(keys, counts, Filter(held, offsets[:-1], sizes, params.hashes), total, distinct, params))


RUN_BYTES = 8 << 20


def _probed(slim: DataFrame, segments: DataFrame, ranges: int, total: int, distinct: int, params: LmParams) -> DataFrame:
    """The same scores where no process can hold the filter: a run of texts sends its distinct hashes to the ranges, and each range probes its segment for them."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray]]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for lo, hi, raw, offs in chunks(data, offsets, RUN_BYTES):
                yield batch.column(2)[lo].as_py(), batch.slice(lo, hi - lo), raw, offs

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, _, raw, offs in runs(batches):
            t, p, _ = tokens(raw, offs)
            for kind, keys in ((WORD, t), (PAIR, p)):
                some, (packed,) = by_range(np.unique(keys), ranges)
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), n)), pa.array(np.full(len(some), kind, np.int32)), packed], names=["range", "run", "kind", "asked"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, part, _, _ in runs(batches):
            one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([-1], pa.int32()), pa.array([-1], pa.int32()), one(part.column(0)), one(part.column(1).cast(pa.string()))], names=["run", "kind", "range", "ids", "texts"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, words, counts = -1, None, None, None
        for batch in batches:
            for r, n, kind, asked, bits, size, k, c in zip(*(x if x.type == pa.binary() else x.to_pylist() for x in batch.columns)):
                if n < 0:
                    sizes = np.zeros(ranges, np.int64)
                    sizes[r] = size
                    at, held = r, Filter(np.frombuffer(bits.as_py(), np.uint8), np.zeros(ranges, np.int64), sizes, params.hashes)
                    words, counts = np.frombuffer(k.as_py(), U64), np.frombuffer(c.as_py(), np.int64)
                    continue
                key = np.frombuffer(asked.as_py(), U64)
                level, exact = np.zeros(len(key), np.int64), np.zeros(len(key) if kind == WORD else 0, np.int64)
                if at == r:
                    level = held.level(key, kind)
                    if kind == WORD and len(words):
                        i = np.minimum(np.searchsorted(words, key), len(words) - 1)
                        exact = np.where(words[i] == key, counts[i], 0)
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([kind], pa.int32()), pa.array([r], pa.int32()), pa.array([level.astype(np.uint8).tobytes()], pa.binary()), pa.array([exact.tobytes()], pa.binary())], names=["run", "kind", "range", "levels", "exact"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, got = None, None, {}

        def out() -> pa.RecordBatch:
            t, p, first = tokens(*buffers(texts))
            key, inverse = np.unique(t, return_inverse=True)
            pair, where = np.unique(p, return_inverse=True)
            level, levels = (np.frombuffer(b"".join(got.get((kind, "levels"), [])), np.uint8).astype(np.int64) for kind in (WORD, PAIR))
            c = np.frombuffer(b"".join(got.get((WORD, "exact"), [])), np.int64)
            if (len(level), len(c), len(levels)) != (len(key), len(key), len(pair)):
                raise RuntimeError("the documents changed between two readings")
            n, known, base, value = scored(first, key, inverse, c, level, levels[where], total, distinct, params)
            return pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(known), pa.array(np.full(len(n), total, np.int64)), pa.array(base), pa.array(value)], names=[c.split()[0] for c in RESULT.split(", ")])

        for batch in batches:
            for i, kind in enumerate(batch.column(1).to_pylist()):
                if kind < 0:
                    if ids is not None:
                        yield out()
                    ids, texts, got = batch.column(3)[i].values, batch.column(4)[i].values, {}
                else:
                    for name, col in (("levels", 5), ("exact", 6)):
                        got.setdefault((kind, name), []).append(batch.column(col)[i].as_py())
        if ids is not None:
            yield out()

    width, null = min(ranges, 50_000), F.lit(None)
    # A run is named after its first row.
    rows = slim.withColumn("row", F.monotonically_increasing_id())
    binary = null.cast("binary")
    held = segments.select("range", F.lit(-1).cast("long").alias("run"), F.lit(-1).alias("kind"), binary.alias("asked"), "bits", "size", "keys", "counts")
    asked = rows.mapInArrow(ask, "range int, run long, kind int, asked binary").select("range", "run", "kind", "asked", binary.alias("bits"), null.cast("long").alias("size"), binary.alias("keys"), binary.alias("counts"))
    answers = held.unionByName(asked).repartitionById(width, F.col("range") % F.lit(width)).sortWithinPartitions("range", "run", "kind").mapInArrow(answer, "run long, kind int, range int, levels binary, exact binary")
    kept = rows.mapInArrow(keep, "run long, kind int, range int, ids array<long>, texts array<string>").select("*", binary.alias("levels"), binary.alias("exact"))
    back = answers.select("run", "kind", "range", null.cast("array<long>").alias("ids"), null.cast("array<string>").alias("texts"), "levels", "exact")
    parts = min(50_000, max(1, -(-text_bytes(slim) // (2 * RUN_BYTES))))
    return kept.unionByName(back).repartition(parts, "run").sortWithinPartitions("run", "kind", "range").mapInArrow(finish, RESULT)
