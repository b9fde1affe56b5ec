"""Benchmark decontamination by rare seeds and Smith-Waterman alignment.

Words are runs of letters, digits and non-ASCII bytes, ASCII-lower-cased.  All
word n-grams of the test items are seeds.  One pass over the texts joins each
with the items by the seeds they share, gathers neighbouring hits into windows
of the text, and aligns window and item by words (match +1, mismatch and gap
-1, local).  A text is a copy of an item if the best score reaches `least` of
the item's length, so that insertions, deletions and replaced words are
tolerated.

Rarity decides how a window is treated, never whether: one hit of a rare seed
(in at most `rare_items` items of its block) is enough to align it.  A window
that has common seeds only is aligned unless item and window share too few words
in any order for that score, which is a proof and not a guess.  So no seed, hit,
text or candidate is dropped for being frequent, and a single hit suffices.  The
limit of the method is a copy of which no n words in sequence are left.

Items are taken in blocks of at most `block_grams` n-grams; what is broadcast
is one block's seeds, however large the benchmark, and each block costs one pass.

Defined results: null and empty texts and items match nothing; an item of fewer
words than a seed is its own seed; repeated rows each get their result; ties
between windows go to the earliest; empty tables give an empty result; columns
of the input are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._io import position
from quillspark.llm._vec import IS_LETTER, U64, Words, buffers, chunks, grams


@dataclass(frozen=True)
class DecontaminateParams:
    gram: int = 3
    rare_items: int = 8
    least: float = 0.5
    slack: int = 8
    block_grams: int = 2_000_000
    #: Hits held at once, and words of a window aligned at once; longer windows go in overlapping pieces.
    held_hits: int = 2_000_000
    piece_words: int = 4096


@dataclass
class Items:
    """A block of test items: ids, word hashes, and n-grams, ascending, with where they occur and in how many items."""

    ids: list[int]
    words: list[np.ndarray]
    gram: np.ndarray
    item: np.ndarray
    at: np.ndarray
    size: np.ndarray
    held: np.ndarray


def prepare(rows: list[tuple[int, str | None]], n: int) -> Items:
    raw = [(t or "").encode("utf-8", "replace") for _, t in rows]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    w = Words(np.frombuffer(b"".join(raw), np.uint8), offsets, IS_LETTER)
    h = w.hashes()
    words = [h[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
    parts = []
    for size in sorted({min(n, int(c)) for c in w.counts if c}):
        g, d, at = grams(h, w.first, size)
        mine = w.counts[d] == size if size < n else w.counts[d] >= n
        parts.append((g[mine], d[mine], at[mine], np.full(int(mine.sum()), size)))
    join = lambda i, t: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t)
    gram, item, at, length = join(0, U64), join(1, np.int64), join(2, np.int64), join(3, np.int64)
    order = np.lexsort((at, item, gram, length))
    gram, item, at, length = gram[order], item[order], at[order], length[order]
    new = lambda *x: np.concatenate([np.ones(min(1, len(gram)), bool), np.any([y[1:] != y[:-1] for y in x], axis=0)])
    head = np.flatnonzero(new(gram, length))
    held = np.add.reduceat(new(gram, length, item).astype(np.int64), head) if len(head) else head
    return Items([r[0] for r in rows], words, gram, item, at, length, np.repeat(held, np.diff(np.append(head, len(gram)))))


def smith_waterman(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(score, end) of the best local alignment of each (item, window), many at a time."""
    out = np.zeros((len(pairs), 2), np.int64)
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][1]), len(pairs[i][0])))
    at = 0
    while at < len(order):
        width = 64
        while width > 1 and at + width <= len(order) and len(pairs[order[min(len(order), at + width) - 1]][1]) * width > 400_000:
            width //= 2
        block = order[at : at + width]
        at += width
        cols, rows = max(len(pairs[i][1]) for i in block), max(len(pairs[i][0]) for i in block)
        # Padding is distinct on both sides, so it matches nothing.
        a, b = np.zeros((len(block), rows), U64), np.ones((len(block), cols), U64)
        for k, i in enumerate(block):
            a[k, : len(pairs[i][0])], b[k, : len(pairs[i][1])] = pairs[i]
        h = np.zeros((len(block), cols + 1), np.int32)
        slope = np.arange(cols + 1, dtype=np.int32)
        best, end = np.zeros(len(block), np.int32), np.zeros(len(block), np.int64)
        for r in range(rows):
            step = np.where(b == a[:, r : r + 1], 1, -1).astype(np.int32)
            new = np.zeros_like(h)
            new[:, 1:] = np.maximum(np.maximum(h[:, :-1] + step, h[:, 1:] - 1), 0)
            h = np.maximum.accumulate(new + slope, axis=1) - slope
            top = h.max(1)
            better = top > best
            best = np.where(better, top, best)
            end = np.where(better, h.argmax(1), end)
        out[block, 0], out[block, 1] = best, end
    return out


def hits(words: Words, h: np.ndarray, items: Items, params: DecontaminateParams) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, item, place in the text, place in the item, items that hold the gram) of the seeds' hits, in portions of bounded size."""
    for size in np.unique(items.size):
        lo, hi = np.searchsorted(items.size, [size, size + 1])
        table = items.gram[lo:hi]
        g, doc, at = grams(h, words.first, int(size))
        low = np.searchsorted(table, g)
        low[low == len(table)] = 0
        found = np.flatnonzero(table[low] == g)
        count = np.searchsorted(table, g[found], side="right") - low[found]
        total = np.cumsum(count)
        begin = 0
        while begin < len(found):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + params.held_hits, side="right")))
            f, c = found[begin:end], count[begin:end]
            which = lo + np.repeat(low[f], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            yield np.repeat(doc[f], c), items.item[which], np.repeat(at[f], c), items.at[which], items.held[which]
            begin = end


def shared_words(item: np.ndarray, window: np.ndarray) -> int:
    """Words in common in any order: no alignment scores more."""
    a, n = np.unique(item, return_counts=True)
    at = np.minimum(np.searchsorted(a, window), len(a) - 1)
    return int(np.minimum(np.bincount(at[a[at] == window], minlength=len(a)), n).sum())


def find_in(words: Words, h: np.ndarray, items: Items, params: DecontaminateParams) -> list[tuple[int, int, float, int, int, int]]:
    """(text, item, score, seeds hit, first word, end word) of the copies in a run of texts; one a text and item."""
    length = np.array([len(w) for w in items.words], np.int64)
    best: dict[tuple[int, int], tuple[int, int, float, int, int, int]] = {}
    for doc, item, at, inside, held in hits(words, h, items, params):
        order = np.lexsort((at, item, doc))
        doc, item, at, inside, held = doc[order], item[order], at[order], inside[order], held[order]
        begin = at - inside
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (at[1:] - at[:-1] > length[item[1:]] + params.slack)])
        heads = np.flatnonzero(new)
        work, meta = [], []
        bounds = zip(heads.tolist(), np.append(heads[1:], len(doc)).tolist(), np.minimum.reduceat(begin, heads).tolist(), np.maximum.reduceat(begin, heads).tolist(), np.minimum.reduceat(held, heads).tolist())
        for a, b, low, high, rarest in bounds:
            d, i = int(doc[a]), int(item[a])
            n, first = int(length[i]), int(words.first[d])
            lo, hi = max(0, low - params.slack), min(int(words.counts[d]), high + n + params.slack)
            window, need = h[first + lo : first + hi], params.least * n
            if rarest > params.rare_items and shared_words(items.words[i], window) < need:
                continue
            hit = len(set(inside[a:b].tolist()))
            # An alignment that scores enough spans at most twice the item.
            piece = max(params.piece_words, 4 * n)
            for from_ in range(0, max(1, len(window) - 2 * n), piece - 2 * n):
                work.append((items.words[i], window[from_ : from_ + piece]))
                meta.append((d, i, hit, lo, lo + from_))
        for (d, i, hit, lo, from_), (score, end) in zip(meta, smith_waterman(work).tolist()):
            share = score / len(items.words[i])
            if share >= params.least and share > best.get((d, i), (0, 0, 0.0))[2]:
                best[d, i] = (d, i, share, hit, lo, from_ + end)
    return [best[k] for k in sorted(best)]


def _blocks(benchmark: DataFrame, params: DecontaminateParams) -> Iterator[Items]:
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // (4 * params.block_grams)))
    for b in range(n):
        part = sorted(((r[0], r[1]) for r in rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        items = prepare(part, params.gram)
        if len(items.gram):
            yield items


PAIRS = "doc_id long, item_id long, score double, seeds_hit int, word_start long, word_end long"


def find(docs: DataFrame, benchmark: DataFrame, params: DecontaminateParams = DecontaminateParams()) -> DataFrame:
    """One row for each text and item it copies: doc_id, item_id, score (share of the item), seeds_hit, word_start, word_end."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], PAIRS)
    for items in _blocks(benchmark, params):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for batch in batches:
                data, offsets = buffers(batch.column(1))
                for lo, hi, raw, offs in chunks(data, offsets):
                    w = Words(raw, offs, IS_LETTER)
                    got = find_in(w, w.hashes(), m, params)
                    if got:
                        d, i, share, hit, a, b = zip(*got)
                        ids = batch.column(0).slice(lo, hi - lo).take(pa.array(d))
                        yield pa.RecordBatch.from_arrays([ids, pa.array([m.ids[k] for k in i], pa.int64()), pa.array(share), pa.array(hit, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=[c.split()[0] for c in PAIRS.split(", ")])

        out = out.unionByName(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PAIRS))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, params: DecontaminateParams = DecontaminateParams()) -> DataFrame:
    """docs without the rows that copy an item; rows and columns are otherwise as they were."""
    out = docs
    names = docs.columns
    at = position(names, "text")
    for items in _blocks(benchmark, params):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = buffers(batch.column(at).cast(pa.string()))
                keep = np.ones(len(batch), bool)
                for lo, _, raw, offs in chunks(data, offsets):
                    w = Words(raw, offs, IS_LETTER)
                    for d, *_ in find_in(w, w.hashes(), shared.value, params):
                        keep[lo + d] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
