"""Toxicity by compression distance.

Pairs of zstandard dictionaries are trained, one of each pair on ordinary text
and one on the passages that set toxic text apart.  Every text is cut into
overlapping windows and each window is compressed with both; the bytes the toxic
dictionary saves are compared with thresholds, and the shares of windows beyond
each threshold are turned into a probability by a logistic calibration on
labelled texts that took no part in training the dictionaries, its intercept
shifted from the sample's share of toxic texts to that of all labelled rows.  One pair's
lengths are noisy, as a window's matches shift with its surroundings; three
pairs that differ in match finder and layout are calibrated together.

Defined results: a null or empty text is one empty window and gets a score as
any other; very long texts are cut into more windows, never truncated; repeated
rows get equal scores; an empty table gives an empty result; without labelled
rows of both kinds every score is the share of toxic rows (0.0 without any).
Other columns are carried along unless their name is one this operator adds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm._io import position, spread
from quillspark.llm._vec import LOWER, buffers


@dataclass(frozen=True)
class DictionaryPair:
    """trained: the toxic part is what zstandard's trainer selects, else all passages; toxic_last: it lies nearest to the window."""

    trained: bool = True
    body_bytes: int = 8192
    min_match: int = 5
    strategy: int = 3
    toxic_last: bool = False


@dataclass(frozen=True)
class ToxicityParams:
    """max_docs bounds the labelled sample of each kind, max_doc_bytes what training reads of one text (from all over it), max_windows the trainer's sample of ordinary windows, drawn over all of these."""

    window: int = 64
    stride: int = 52
    level: int = 3
    head_bytes: int = 8192
    pairs: tuple[DictionaryPair, ...] = (DictionaryPair(), DictionaryPair(strategy=5, toxic_last=True), DictionaryPair(trained=False, body_bytes=16_384, min_match=6, strategy=2, toxic_last=True))
    gram: int = 6
    max_docs: int = 3000
    max_doc_bytes: int = 20_000
    max_windows: int = 20_000
    thresholds: tuple[int, ...] = (2, 3, 4, 6)


@dataclass
class ToxicityModel:
    """dictionaries: (ordinary, toxic) of each pair."""

    params: ToxicityParams
    dictionaries: list[tuple[bytes, bytes]] = field(default_factory=list)
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    prior: float = 0.0


def windows(raw: bytes, params: ToxicityParams) -> list[bytes]:
    last = max(1, len(raw) - (params.window - params.stride))
    return [raw[i : i + params.window] for i in range(0, last, params.stride)]


class Compressors:
    """The compressors of each pair; both dictionaries share a body, so that only the toxic part makes a difference."""

    def __init__(self, model: ToxicityModel):
        self.params = p = model.params
        self.pairs = []
        for pair, contents in zip(p.pairs, model.dictionaries):
            settings = zstd.ZstdCompressionParameters.from_level(
                p.level, strategy=pair.strategy, min_match=pair.min_match, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstd.FORMAT_ZSTD1_MAGICLESS
            )
            self.pairs.append([zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(c, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=settings).compress for c in contents])

    def savings(self, raw: bytes) -> np.ndarray:
        """(pairs, windows) bytes saved."""
        cut = windows(raw, self.params)
        return np.array([[len(a(w)) - len(b(w)) for w in cut] for a, b in self.pairs], dtype=np.int64)


def features(savings: np.ndarray, params: ToxicityParams) -> np.ndarray:
    """For each pair, the shares of windows beyond each threshold and the bytes saved beyond the first, on a log scale."""
    n = savings.shape[1]
    over = [(savings >= t).sum(1) / n for t in params.thresholds]
    gain = np.where(savings >= params.thresholds[0], savings, 0).sum(1) / n
    return np.log1p(25.0 * np.array([*over, gain])).T.ravel()


def _marked(docs: Sequence[bytes], n: int) -> Counter:
    seen: Counter = Counter()
    for b in docs:
        seen.update({b[i : i + n] for i in range(len(b) - n + 1)})
    return seen


def _passages(raw: bytes, good: set[bytes], n: int) -> list[bytes]:
    """Maximal runs of raw that are covered by marked grams."""
    runs: list[list[int]] = []
    for i in range(len(raw) - n + 1):
        if raw[i : i + n] in good:
            if runs and i <= runs[-1][1] - n + 1:
                runs[-1][1] = i + n
            else:
                runs.append([i, i + n])
    return [raw[a:b] for a, b in runs]


def _trained(size: int, samples: list[bytes]) -> bytes:
    """What zstandard's trainer selects; all samples where they are too few for it."""
    try:
        return zstd.train_dictionary(size, samples).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[-size:]


def train(toxic: Sequence[str | None], ordinary: Sequence[str | None], params: ToxicityParams = ToxicityParams(), share: float | None = None) -> ToxicityModel:
    """Fit dictionaries on two thirds of the texts and the calibration on the rest; share is that of toxic texts where the two kinds were sampled unequally."""
    raw = lambda s: bytes((s or "").encode("utf-8", "replace").lower())
    tox, plain = [raw(s) for s in toxic], [raw(s) for s in ordinary]
    model = ToxicityModel(params, prior=len(tox) / max(1, len(tox) + len(plain)) if share is None else share)
    if len(tox) < 3 or len(plain) < 3:
        return model
    fit = lambda docs: [d for i, d in enumerate(docs) if i % 3]
    rest = lambda docs: docs[::3]
    n, a, b = params.gram, fit(tox), fit(plain)
    in_tox, in_plain = _marked(a, n), _marked(b, n)
    least = 2 if len(a) < 60 else 4
    good = {g for g, c in in_tox.items() if c >= least and c / len(a) > 5 * (in_plain.get(g, 0) + 1) / len(b)}
    marked: Counter = Counter(p for d in a for p in set(_passages(d, good, n)))
    usual = [w for d in b for w in windows(d, params)]
    rng = np.random.default_rng(7)
    usual = [usual[i] for i in rng.permutation(len(usual))[: params.max_windows]]
    fragments = [p for p, c in sorted(marked.items()) for _ in range(min(c, 20))]
    for pair in params.pairs:
        if pair.trained:
            head = _trained(params.head_bytes, fragments) if fragments else b""
            head = head[-max(0, min(len(head) - 300, params.head_bytes)) :] if len(head) > 600 else head
        else:
            # The most frequent passages lie last, where they are cheapest to refer to.
            head = b"".join(p for p in sorted(marked, key=lambda p: (marked[p], p)) if marked[p] >= 2)[-params.head_bytes :]
        body = _trained(pair.body_bytes, usual)[-pair.body_bytes + 512 :]
        filler = _trained(max(params.head_bytes, len(head)), usual[::-1])[-len(head) :] if head else b""
        model.dictionaries.append((body + filler, body + head) if pair.toxic_last else (filler + body, head + body))
    c = Compressors(model)
    x = np.array([features(c.savings(d), params) for d in rest(tox) + rest(plain)])
    y = np.array([1.0] * len(rest(tox)) + [0.0] * len(rest(plain)))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z, w = np.c_[(x - mean) / scale, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        ridge = np.r_[np.full(x.shape[1], 1.0), 1e-6]
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
    if share is not None and 0 < share < 1:
        w[-1] += np.log(share / (1 - share)) - np.log(len(rest(tox)) / len(rest(plain)))
    model.mean, model.scale, model.weights = mean.tolist(), scale.tolist(), w.tolist()
    return model


def score_bytes(raw: bytes, model: ToxicityModel, c: Compressors | None) -> tuple[float, int]:
    """(probability, windows beyond the lowest threshold) of one lower-cased text."""
    if c is None:
        return model.prior, 0
    s = c.savings(raw)
    z = (features(s, model.params) - np.array(model.mean)) / np.array(model.scale)
    value = float(z @ np.array(model.weights[:-1]) + model.weights[-1])
    return float(1 / (1 + np.exp(-np.clip(value, -30, 30)))), int(np.count_nonzero((s >= model.params.thresholds[0]).any(0)))


def labelled_sample(docs: DataFrame, labels: DataFrame, trainable: Column, params: ToxicityParams = ToxicityParams()) -> tuple[list[str], list[str]]:
    """At most max_docs texts of each kind, one a doc_id, those with the smallest hash of it; of longer texts max_doc_bytes characters from all over them.  Only so much reaches the driver."""
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("_toxic")).where("doc_id is not null and _toxic in (0, 1)")
    d = docs.select("doc_id", "text").where(trainable & F.col("doc_id").isNotNull())
    out = []
    for kind in (1, 0):
        picked = marks.where(F.col("_toxic") == kind).select("doc_id").distinct()
        if kind == 0:
            picked = picked.join(marks.where("_toxic = 1").select("doc_id").distinct(), "doc_id", "left_anti")
        chosen = picked.where(trainable).orderBy(F.xxhash64("doc_id", F.lit(kind)), "doc_id").limit(params.max_docs)
        rows = d.join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(spread(F.col("text"), params.max_doc_bytes)).alias("text"))
        out.append([r["text"] for r in sorted(rows.collect(), key=lambda r: r["doc_id"])])
    return out[0], out[1]


def toxic_share(docs: DataFrame, labels: DataFrame, trainable: Column) -> float | None:
    """The share of toxic rows among all rows that labelled_sample draws from; None without any."""
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("_toxic")).where("doc_id is not null and _toxic in (0, 1)")
    kinds = marks.where(trainable).groupBy("doc_id").agg(F.max("_toxic").alias("_toxic"))
    return docs.select("doc_id").where(trainable).join(kinds, "doc_id").agg(F.avg("_toxic")).first()[0]


ADDED = ("score", "toxic_windows")


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs with `score` and `toxic_windows`; one narrow pass, no shuffle."""
    keep = [c for c in docs.columns if c.lower() not in ADDED]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType()), T.StructField("toxic_windows", T.LongType())])
    names = [c for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Compressors(model) if model.weights else None
        for batch in batches:
            data, offsets = buffers(batch.column(position(names, "text")))
            low = LOWER[data].tobytes()
            got = [score_bytes(low[a:b], model, c) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            cols = [*batch.columns, pa.array([s for s, _ in got], pa.float64()), pa.array([n for _, n in got], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, *ADDED])

    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)
