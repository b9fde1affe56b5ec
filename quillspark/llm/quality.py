"""Quality rules: plain statistics, and n-gram perplexity within language-specific bands.

The model is an interpolated modified Kneser-Ney model over the bytes of the
folded text (ASCII lower case, digits as 0, separators as blanks), one for each
language.  Spark counts the highest order over all texts, with partial sums in
each task; lower orders' continuation counts, discounts and probabilities are
DataFrame aggregations and joins of those counts.  What scoring needs is stored
in sorted arrays of 64-bit hashes of language and n-gram, broadcast to the
workers.  Documents are scored by the model of all of them, so only the highest
order is looked up, every n-gram being known.  Byte n-grams saturate, so the
arrays grow far slower than the corpus; their size is checked all the same, and
where all languages together have more than `max_entries`, languages are scored
in groups, each with its own broadcast, and a larger language in parts of its
n-grams, whose sums are added up by document.  The driver holds one of these
broadcasts at a time.

A document's perplexity is compared with its language's band: the median of the
log perplexities of that language's documents, give or take `width` times their
interquartile range (at least `least_width`), by documents of enough words.
Short documents' perplexities vary more: the band of one of n words is wider by
the square root of 1 + short_words / n.

Defined results: a null text is an empty one; texts shorter than an n-gram have
no perplexity, and keep what the other rules say; null is a language of its own;
repeated rows get equal results; an empty table gives an empty result; columns
of the input are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm._io import Table, fresh, position
from quillspark.llm._vec import LOWER, SEPARATORS, U64, Words, buffers, chunks, distinct, grams, mix64, sum_ranges, text_sums


@dataclass(frozen=True)
class QualityParams:
    order: int = 5
    width: float = 2.5
    least_width: float = 0.02
    short_words: int = 100
    min_words: int = 50
    max_repeat_percent: int = 50
    max_entries: int = 12_000_000
    held_entries: int = 1_000_000


_FOLD = LOWER.copy()
_FOLD[list(SEPARATORS)] = 32
_FOLD[48:58] = 48
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_HEAD = np.array([(b & 0xC0) != 0x80 for b in range(256)], np.int64)
_ALL_SEPARATORS = bytes(SEPARATORS)


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    w = Words(data, offsets)
    h = w.hashes(lower=False)
    g, doc, at = grams(h, w.first, 3)
    twice = np.zeros(len(g), bool)
    if len(g):
        with np.errstate(over="ignore"):
            keyed = mix64(g + mix64(doc))
        order = np.argsort(keyed, kind="stable")
        s = keyed[order]
        same = np.zeros(len(s) + 1, bool)
        same[1:-1] = s[1:] == s[:-1]
        twice[order] = same[1:] | same[:-1]
    covered = np.zeros(len(h) + 3, bool)
    hit = (w.first[doc] + at)[twice]
    for k in range(3):
        covered[hit + k] = True
    dup = np.zeros(len(offsets) - 1, np.int64)
    raw = data.tobytes()
    many = text_sums((data == 10).astype(np.int64), offsets)
    for i in np.flatnonzero(many):
        seen: set[bytes] = set()
        for line in raw[offsets[i] : offsets[i + 1]].split(b"\n"):
            if line in seen:
                dup[i] += 1
            elif line.strip(_ALL_SEPARATORS):
                seen.add(line)
    return {
        "n_words": w.counts,
        "word_chars": text_sums(_HEAD[data] * w.inside, offsets),
        "n_symbols": text_sums(_SYMBOL[data], offsets),
        "n_dup_lines": dup,
        "n_repeat_words": text_sums(covered[: len(h)].astype(np.int64), w.first),
    }


def packed(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams as integers, first): all inside one text; first[i]:first[i+1] are those of text i."""
    size = np.maximum(np.diff(offsets) - n + 1, 0)
    first = np.concatenate([[0], np.cumsum(size)])
    if len(data) < n:
        return np.zeros(0, U64), first
    b = _FOLD[data].astype(U64)
    key = b[: len(b) - n + 1].copy()
    for k in range(1, n):
        key = (key << U64(8)) | b[k : len(b) - n + 1 + k]
    doc_of = np.ones(len(key), bool)
    for back in range(1, n):
        at = offsets[1:] - back
        doc_of[at[(at >= 0) & (at < len(key)) & (at >= offsets[:-1])]] = False
    return key[doc_of], first


def language_hash(name: str | None) -> int:
    """A signed 64-bit hash of a language's name."""
    h = U64(0x243F6A8885A308D3 if name is None else 0x13198A2E03707344)
    with np.errstate(over="ignore"):
        for b in (name or "").encode():
            h = mix64(np.array([h * U64(31) + U64(b)], U64))[0]
    return int(np.array([h], U64).view(np.int64)[0])


def by_language(langs: pa.Array, texts: pa.Array) -> Iterator[tuple[str | None, np.ndarray, pa.Array]]:
    """(language, row numbers, texts) of a batch."""
    coded = langs.dictionary_encode()
    index = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
    for k in np.unique(index):
        rows = np.flatnonzero(index == k)
        yield (None if k < 0 else coded.dictionary[int(k)].as_py()), rows, texts.take(pa.array(rows))


def count(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """(lang, gram, c): the highest order's counts over all texts; lang is a hash, gram the packed bytes."""
    n = params.order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            k, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(k, kind="stable")
            k, c = k[order], c[order]
            head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            return k[head], np.add.reduceat(c, head)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                k, c = merged(parts)
                yield pa.RecordBatch.from_pydict({"lang": pa.array(np.full(len(k), lang, np.int64)), "gram": k.view(np.int64), "c": c})

        for batch in batches:
            for name, _, texts in by_language(batch.column(0), batch.column(1)):
                data, offsets = buffers(texts)
                for _, _, raw, offs in chunks(data, offsets):
                    key, _ = packed(raw, offs, n)
                    if not len(key):
                        continue
                    key = np.sort(key)
                    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                    held.setdefault(language_hash(name), []).append((key[head], np.diff(np.append(head, len(key)))))
                    size += len(head)
            if size > params.held_entries:
                held = {k: [merged(p)] for k, p in held.items()}
                size = sum(len(p[0][0]) for p in held.values())
                if size > params.held_entries // 2:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    slim = docs.select(F.col("lang").cast("string"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "lang long, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def estimate(counts: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """(order, lang, gram, value): log10 probabilities (order k) and, at order -k, log10 of what context gram passes on."""
    n = params.order
    tables = {n: Table(counts, "grams").df}
    for k in range(n - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1))
        tables[k] = Table(tables[k + 1].groupBy("lang", suffix.alias("gram")).agg(F.count("*").alias("c")), "grams").df
    lower = None
    out = None
    for k in range(1, n + 1):
        t = tables[k].withColumn("context", F.shiftright("gram", 8))
        ns = t.groupBy("lang").agg(*[F.sum((F.col("c") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)])
        y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
        d = [F.greatest(F.lit(0.05), F.least(F.lit(float(i)) - 0.05, F.coalesce(i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")), F.lit(0.5 * i)))) for i in (1, 2, 3)]
        ns = ns.select("lang", *[x.alias(f"d{i + 1}") for i, x in enumerate(d)])
        contexts = t.groupBy("lang", "context").agg(F.sum("c").cast("double").alias("total"), *[F.sum(((F.col("c") == i) if i < 3 else (F.col("c") >= 3)).cast("double")).alias(f"k{i}") for i in (1, 2, 3)])
        contexts = contexts.join(F.broadcast(ns), "lang").withColumn("pass", sum(F.col(f"d{i}") * F.col(f"k{i}") for i in (1, 2, 3)) / F.col("total"))
        contexts = Table(contexts, "contexts").df
        cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        t = t.join(contexts, ["lang", "context"]).withColumn("tail", F.col("gram").bitwiseAND(F.lit((1 << (8 * (k - 1))) - 1)))
        if lower is None:
            t = t.withColumn("below", F.lit(1 / 256))
        else:
            t = t.join(lower.select("lang", F.col("gram").alias("tail"), F.col("p").alias("below")), ["lang", "tail"])
        lower = Table(t.select("lang", "gram", ((F.col("c") - cut) / F.col("total") + F.col("pass") * F.col("below")).alias("p")), "probabilities").df
        here = lower.select(F.lit(k).alias("order"), "lang", "gram", F.log10("p").alias("value"))
        here = here.unionByName(contexts.select(F.lit(-k).alias("order"), "lang", F.col("context").alias("gram"), F.log10("pass").alias("value")))
        out = here if out is None else out.unionByName(here)
    return out


@dataclass
class PerplexityModel:
    """For each order, the sorted hashes of (language, n-gram) and log10 probabilities; for -order those of contexts."""

    order: int
    keys: dict[int, np.ndarray]
    values: dict[int, np.ndarray]

    def find(self, which: int, lang: int, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key, value = self.keys.get(which), self.values.get(which)
        if key is None or not len(key):
            return np.zeros(len(gram), bool), np.zeros(len(gram))
        h = hashed(lang, gram)
        at = np.searchsorted(key, h)
        at[at == len(key)] = 0
        return key[at] == h, value[at].astype(np.float64)

    def log10(self, lang: int, gram: np.ndarray, k: int | None = None) -> np.ndarray:
        """log10 probability of the last byte of each distinct n-gram given the others, backing off where it is unknown."""
        k = self.order if k is None else k
        known, value = self.find(k, lang, gram)
        rest = np.flatnonzero(~known)
        if len(rest):
            has, passed = self.find(-k, lang, gram[rest] >> U64(8))
            passed = np.where(has, passed, 0.0)
            if k == 1:
                value[rest] = passed - np.log10(256.0)
            else:
                value[rest] = passed + self.log10(lang, gram[rest] & U64((1 << (8 * (k - 1))) - 1), k - 1)
        return value


def hashed(lang: int, gram: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(gram.astype(U64) ^ np.array([lang], np.int64).view(U64)[0])


def collect(entries: DataFrame, order: int) -> PerplexityModel:
    t = entries.toArrow()
    which, lang, gram, value = (t.column(c).to_numpy() for c in ("order", "lang", "gram", "value"))
    with np.errstate(over="ignore"):
        key = mix64(gram.astype(np.int64).view(U64) ^ lang.astype(np.int64).view(U64))
    keys, values = {}, {}
    for k in np.unique(which):
        mine = which == k
        order_ = np.argsort(key[mine])
        keys[int(k)], values[int(k)] = key[mine][order_], value[mine][order_].astype(np.float32)
    return PerplexityModel(order, keys, values)


def models(docs: DataFrame, params: QualityParams = QualityParams()) -> list[tuple[None, PerplexityModel]]:
    """The whole model of docs with all orders, for any text; it is collected, so this is for corpora of at most max_entries."""
    entries = Table(estimate(count(docs, params), params), "model").df
    if entries.count() > params.max_entries:
        raise ValueError(f"the model has more than {params.max_entries} entries")
    return [(None, collect(entries, params.order))]


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SPREAD = 1_000_003


@dataclass
class Part:
    """A broadcast model for the languages in group (None: all) and, of parts, the n-grams of one."""

    group: frozenset[int] | None
    part: int
    parts: int
    shared: Broadcast


def fit(docs: DataFrame, params: QualityParams = QualityParams()) -> list[Part]:
    """The model of docs for scoring docs: the highest order's probabilities, in broadcasts of at most max_entries."""
    entries = Table(estimate(count(docs, params), params), "model").df.where(F.col("order") == params.order)
    sizes = entries.groupBy("lang").agg(F.count("*").alias("n"))
    plans: list[tuple[frozenset[int] | None, int, int]] = []
    if (sizes.agg(F.sum("n")).first()[0] or 0) <= params.max_entries:
        plans = [(None, 0, 1)]
    else:
        held = 0
        for r in sizes.orderBy("n", "lang").toLocalIterator():
            parts = -(-r["n"] // params.max_entries)
            if parts > 1:
                plans += [(frozenset([r["lang"]]), j, parts) for j in range(parts)]
            elif plans and held + r["n"] <= params.max_entries:
                plans[-1], held = (plans[-1][0] | {r["lang"]}, 0, 1), held + r["n"]
            else:
                plans, held = [*plans, (frozenset([r["lang"]]), 0, 1)], r["n"]
    out = []
    for group, part, parts in plans:
        mine = entries if group is None else entries.where(F.col("lang").isin(*group))
        mine = mine.where(F.col("gram") % _SPREAD % parts == part) if parts > 1 else mine
        out.append(Part(group, part, parts, docs.sparkSession.sparkContext.broadcast(collect(mine, params.order))))
    return out


def _log_sums(p: Part, name: str | None, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of log10 probabilities of each text's n-grams in this part, and the number of all its n-grams."""
    model = p.shared.value
    key, first = packed(data, offsets, model.order)
    if not len(key):
        return np.zeros(len(first) - 1), np.diff(first)
    values, inverse = distinct(key, 8 * model.order)
    here = (values % U64(_SPREAD) % U64(p.parts)).astype(np.int64) == p.part
    known, found = model.find(model.order, language_hash(name), values[here])
    if not known.all():
        raise RuntimeError("the documents changed between counting and scoring")
    log = np.zeros(len(values))
    log[here] = found
    return sum_ranges(log[inverse], first), np.diff(first)


MEASURED = "rid long, doc_id long, lang string, " + ", ".join(f"{s} long" for s in STATS) + ", base_failed boolean, log_ppl double"


def _failed(s: dict[str, np.ndarray], params: QualityParams) -> np.ndarray:
    return (s["n_words"] < params.min_words) | (100 * s["n_repeat_words"] > params.max_repeat_percent * s["n_words"])


def _measured(p: Part, name: str | None, texts: pa.Array, params: QualityParams) -> dict[str, np.ndarray]:
    data, offsets = buffers(texts)
    parts = []
    for _, _, raw, offs in chunks(data, offsets):
        s = statistics(raw, offs)
        total, n = _log_sums(p, name, raw, offs)
        with np.errstate(invalid="ignore", divide="ignore"):
            s["log_ppl"] = np.where(n > 0, -total / n, np.nan)
        parts.append(s)
    s = {k: np.concatenate([x[k] for x in parts]) for k in parts[0]}
    return s | {"failed": _failed(s, params)}


def measure(docs: DataFrame, fitted: list[Part], params: QualityParams = QualityParams()) -> DataFrame:
    """rid, doc_id, lang, the statistics, base_failed, log_ppl of each row; rid numbers the rows of docs as they are read."""
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    out = []
    for p in fitted:

        def run(batches: Iterator[pa.RecordBatch], p=p) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, rows, texts in by_language(batch.column(2), batch.column(3)):
                    if p.group is not None and language_hash(name) not in p.group:
                        continue
                    s = _measured(p, name, texts, params)
                    at = pa.array(rows)
                    ppl = pa.array(s["log_ppl"], pa.float64(), mask=np.isnan(s["log_ppl"]))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([name] * len(rows), pa.string()), *[pa.array(s[k].astype(np.int64)) for k in STATS], pa.array(s["failed"]), ppl], names=["rid", "doc_id", "lang", *STATS, "base_failed", "log_ppl"])

        out.append((p.parts, base.mapInArrow(run, MEASURED)))
    names = [c.split()[0] for c in MEASURED.split(", ")]
    whole = [d for parts, d in out if parts == 1]
    split = [d for parts, d in out if parts > 1]
    if split:
        # Each part has its share of a document's sum; the rest of the row is the same in all.
        some = reduce(DataFrame.unionByName, split)
        some = some.groupBy("rid").agg(*[F.first(c).alias(c) for c in names[1:-1]], F.sum("log_ppl").alias("log_ppl"))
        whole.append(some.select(*names))
    return reduce(DataFrame.unionByName, whole)


def bands_of(measured: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """(lang, mid, half): each language's band of log10 perplexity, from all documents of enough words.

    Quartiles to nine digits, from counts: of coarse bins, then of the values within those that hold a quartile.
    """
    m = measured.where(f"log_ppl is not null and n_words >= {params.min_words}").select("lang", F.floor(F.col("log_ppl") * 10_000).alias("bin"), F.round("log_ppl", 9).alias("v"))
    up_to = lambda by, order: F.sum("c").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    bins = m.groupBy("lang", "bin").agg(F.count("*").alias("c"))
    bins = bins.withColumn("n", F.sum("c").over(Window.partitionBy("lang"))).withColumn("top", up_to(["lang"], "bin"))
    ranks = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.greatest(F.lit(1), F.ceil(q * F.col("n"))).alias("rank")) for q in (0.25, 0.5, 0.75)]))
    hit = bins.select("lang", "bin", "c", "top", ranks.alias("r")).where("r.rank <= top and r.rank > top - c")
    hit = Table(hit.select(F.col("lang").alias("l"), F.col("bin").alias("b"), "r.q", (F.col("r.rank") - F.col("top") + F.col("c")).alias("rank")), "quartiles").df
    wanted = hit.select("l", "b").distinct()
    fine = m.join(wanted, F.col("lang").eqNullSafe(F.col("l")) & (F.col("bin") == F.col("b")), "left_semi").groupBy("lang", "bin", "v").agg(F.count("*").alias("c"))
    fine = fine.withColumn("top", up_to(["lang", "bin"], "v"))
    found = fine.join(hit, F.col("lang").eqNullSafe(F.col("l")) & (F.col("bin") == F.col("b"))).where("rank <= top and rank > top - c")
    at = lambda q: F.max(F.when(F.col("q") == q, F.col("v")))
    half = F.greatest(F.lit(params.least_width), params.width * (at(0.75) - at(0.25)))
    return found.groupBy("lang").agg(at(0.5).alias("mid"), half.alias("half"))


def inside_band(params: QualityParams = QualityParams()) -> Column:
    slack = F.col("half") * F.sqrt(1 + F.lit(params.short_words) / F.greatest(F.col("n_words"), F.lit(1)))
    return F.coalesce(F.abs(F.col("log_ppl") - F.col("mid")) <= slack, F.lit(True))


def _judged(docs: DataFrame, fitted: list[Part], params: QualityParams) -> DataFrame:
    measured = Table(measure(docs, fitted, params), "measured").df
    bands = Table(bands_of(measured, params), "bands").df
    small = bands.count() <= 100_000
    found = measured.join(F.broadcast(bands) if small else bands, measured["lang"].eqNullSafe(bands["lang"]), "left").drop(bands["lang"])
    return found.withColumn("kept", ~F.col("base_failed") & inside_band(params))


def judge(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """One row a document: the statistics, base_failed, log_ppl, the band (mid, half) and kept."""
    return _judged(docs, fit(docs, params), params).drop("rid")


def keep(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    fitted = fit(docs, params)
    judged = _judged(docs, fitted, params)
    if any(p.parts > 1 for p in fitted):
        (rid,) = fresh(docs.columns, "rid")
        passed = judged.where("kept").select(F.col("rid").alias(rid))
        return docs.withColumn(rid, F.monotonically_increasing_id()).join(passed, rid, "left_semi").drop(rid)
    known = {r["lang"]: (r["mid"], r["half"]) for r in judged.select("lang", "mid", "half").where("mid is not null").distinct().toLocalIterator()}
    names = docs.columns
    at_lang, at_text = position(names, "lang"), position(names, "text")
    out = []
    # Each row is measured again rather than shuffled with its text.
    for p in fitted:

        def run(batches: Iterator[pa.RecordBatch], p=p) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, rows, texts in by_language(batch.column(at_lang).cast(pa.string()), batch.column(at_text).cast(pa.string())):
                    if p.group is not None and language_hash(name) not in p.group:
                        continue
                    s = _measured(p, name, texts, params)
                    mid, half = known.get(name, (0.0, np.inf))
                    slack = half * np.sqrt(1 + params.short_words / np.maximum(s["n_words"], 1))
                    ok = ~s["failed"] & ~(np.abs(s["log_ppl"] - mid) > slack)
                    if ok.any():
                        yield batch.take(pa.array(rows[ok]))

        out.append(docs.mapInArrow(run, docs.schema))
    return reduce(DataFrame.unionByName, out)
