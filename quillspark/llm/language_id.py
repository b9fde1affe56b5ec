"""Language identification by nearest centroid.

Texts become vectors of hashed letter trigrams (bytes of the ASCII-lower-cased
UTF-8, everything that isn't a letter as one blank), weighted by log frequency
and inverse document frequency and normalised.  Each language's training vectors
are clustered (spherical k-means) into several centroids; a text gets the
language of the centroid with the largest cosine.  Texts further from every
centroid than almost all training texts were from their own are rejected.

Training reads a sample of at most `max_docs` texts a language, whole ones or,
of texts of more than `max_doc_chars` characters, pieces from all over them.  It
runs in one task a language, so neither texts nor vectors come to the driver.
There may be any number of languages: their centroids are broadcast in blocks of
`block_languages`, and a text is compared with one block after the other.
Prediction reads every text whole.

Defined results: a null text, or one without a letter, is `und` with score 0; a
rejected text is `und` in `language`, and keeps its nearest language in
`nearest`; without training rows everything is `und`; repeated rows get equal
results; other columns are carried along unless named as an added one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillspark.llm._io import Table, position, spread
from quillspark.llm._vec import LOWER, buffers, chunks

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageParams:
    dims: int = 8192
    centroids: int = 4
    max_docs: int = 400
    max_doc_chars: int = 8000
    block_languages: int = 256
    reject_quantile: float = 0.002
    rounds: int = 12


@dataclass
class LanguageModel:
    """A block of languages, ascending, their centroids and to which language each belongs; idf and limit are those of all blocks."""

    params: LanguageParams
    languages: list[str]
    idf: np.ndarray
    centres: np.ndarray
    owner: np.ndarray
    limit: float


# Letters keep their byte, everything else in ASCII is a blank.
_FOLD = LOWER.copy()
_FOLD[:128][~(((np.arange(128) >= 65) & (np.arange(128) <= 90)) | ((np.arange(128) >= 97) & (np.arange(128) <= 122)))] = 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def counts(data: np.ndarray, offsets: np.ndarray, dims: int) -> np.ndarray:
    """(texts, dims) counts of hashed trigrams; trigrams of three blanks or across texts don't count."""
    n = len(offsets) - 1
    if len(data) < 3:
        return np.zeros((n, dims), np.float32)
    b = _FOLD[data].astype(np.uint32)
    key = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    slot = ((key * np.uint32(2654435761)) >> np.uint32(32 - dims.bit_length() + 1)).astype(np.int64)
    doc = np.repeat(np.arange(n), np.diff(offsets))[: len(key)]
    good = key != 0x202020
    # The last two positions of a text start no trigram.
    for back in (1, 2):
        at = offsets[1:] - back
        at = at[(at >= 0) & (at < len(good))]
        good[at] = False
    return np.bincount((doc * dims + slot)[good], minlength=n * dims).reshape(n, dims).astype(np.float32)


def _vectors(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(c) * idf
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    return v / np.maximum(norm, 1e-9)[:, None]


def _clusters(v: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means, begun with texts far from each other."""
    picked = [0]
    near = v @ v[0]
    for _ in range(1, min(k, len(v))):
        picked.append(int(np.argmin(near)))
        near = np.maximum(near, v @ v[picked[-1]])
    centre = v[picked].copy()
    for _ in range(rounds):
        who = np.argmax(v @ centre.T, axis=1)
        for j in range(len(centre)):
            if np.any(who == j):
                m = v[who == j].sum(0)
                centre[j] = m / max(float(np.linalg.norm(m)), 1e-9)
    return centre


def _counts_of(texts: Sequence[str | None], dims: int) -> np.ndarray:
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    c = [counts(d, o, dims) for _, _, d, o in chunks(np.frombuffer(b"".join(raw), np.uint8), offsets)]
    c = np.concatenate(c) if c else np.zeros((0, dims), np.float32)
    return c[c.sum(1) > 0]


def _idf(texts: int, having: np.ndarray) -> np.ndarray:
    return (np.log((1 + texts) / (1 + having)) + 1).astype(np.float32)


def _centroids(c: np.ndarray, idf: np.ndarray, params: LanguageParams) -> tuple[np.ndarray, np.ndarray]:
    """A language's centroids, and its texts' cosines with the nearest of them."""
    v = _vectors(c, idf)
    k = _clusters(v, params.centroids, params.rounds).astype(np.float32)
    return k, (v @ k.T).max(1)


def _limit(own: list[np.ndarray], params: LanguageParams) -> float:
    return float(np.quantile(np.concatenate(own), params.reject_quantile)) * 0.8 if own else 0.0


def train(texts: Sequence[str | None], languages: Sequence[str], params: LanguageParams = LanguageParams()) -> LanguageModel:
    """The model of a few texts that are here, in one block."""
    by = {name: [t for t, x in zip(texts, languages) if x == name] for name in sorted(set(languages))}
    found = {name: c for name, mine in by.items() if len(c := _counts_of(mine, params.dims))}
    idf = _idf(sum(map(len, found.values())), sum(((c > 0).sum(0) for c in found.values()), np.zeros(params.dims, np.int64)))
    parts = [_centroids(c, idf, params) for c in found.values()]
    centres = np.concatenate([k for k, _ in parts]) if parts else np.zeros((0, params.dims), np.float32)
    return LanguageModel(params, list(found), idf, centres, np.repeat(np.arange(len(parts)), [len(k) for k, _ in parts]).astype(int), _limit([o for _, o in parts], params))


def labelled_sample(docs: DataFrame, trainable: Column, params: LanguageParams = LanguageParams()) -> DataFrame:
    """(lang, text): at most max_docs texts of each language, those with the smallest hash of doc_id and text length."""
    d = docs.select("doc_id", "text", "lang").where(trainable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    d = d.select("lang", "text", F.xxhash64("doc_id", F.length("text")).alias("_h"), F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(64)).alias("_r"))
    # Hashes are chosen first, and within ranges before that, so that no task sorts a whole language or any texts.
    few = d.select("lang", "_h", "_r").distinct()
    few = few.withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_r").orderBy("_h"))).where(F.col("_n") <= params.max_docs).drop("_n")
    few = few.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_h"))).where(F.col("_n") <= params.max_docs).select("lang", "_h")
    few = Table(few, "chosen").df
    few = F.broadcast(few) if few.count() <= params.max_docs * params.block_languages else few
    return d.join(few, ["lang", "_h"], "left_semi").groupBy("lang", "_h").agg(F.min(spread(F.col("text"), params.max_doc_chars)).alias("text"))


def fit(docs: DataFrame, trainable: Column, params: LanguageParams = LanguageParams()) -> list[LanguageModel]:
    """The model of all languages of the rows where trainable holds, in blocks."""
    sample = Table(labelled_sample(docs, trainable, params), "sample").df
    dims = params.dims

    def having(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = np.zeros(dims, np.int64), 0
        for batch in batches:
            for lo in range(0, len(batch), 256):
                c = _counts_of(batch.column(0).slice(lo, 256).to_pylist(), dims)
                total, texts = total + (c > 0).sum(0), texts + len(c)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"slot": np.append(some, -1), "n": np.append(total[some], texts)})

    seen = {r["slot"]: r["n"] for r in sample.select("text").mapInArrow(having, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()}
    df = np.zeros(dims, np.int64)
    for slot, n in seen.items():
        if slot >= 0:
            df[slot] = n
    idf = _idf(seen.get(-1, 0), df)
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def cluster(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("_h").to_numpy(), kind="stable")
        c = _counts_of(group.column("text").take(pa.array(order)).to_pylist(), dims)
        k, own = _centroids(c, shared.value, params) if len(c) else (np.zeros((0, dims), np.float32), np.zeros(0, np.float32))
        return pa.Table.from_pydict({"lang": group.column("lang").slice(0, 1), "centres": pa.array([k.tobytes()], pa.binary()), "own": pa.array([own.astype(np.float32).tobytes()], pa.binary())})

    found = Table(sample.groupBy("lang").applyInArrow(cluster, "lang string, centres binary, own binary"), "centroids").df.where("octet_length(centres) > 0")
    limit = _limit([np.frombuffer(r["own"], np.float32) for r in found.select("own").toLocalIterator()], params)
    out: list[LanguageModel] = []
    names, parts = [], []

    def close() -> None:
        owner = np.repeat(np.arange(len(parts)), [len(k) for k in parts])
        out.append(LanguageModel(params, list(names), idf, np.concatenate(parts), owner.astype(int), limit))
        names.clear()
        parts.clear()

    for r in found.orderBy("lang").select("lang", "centres").toLocalIterator():
        names.append(r["lang"])
        parts.append(np.frombuffer(r["centres"], np.float32).reshape(-1, dims))
        if len(names) == params.block_languages:
            close()
    if names or not out:
        parts = parts or [np.zeros((0, dims), np.float32)]
        close()
    return out


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    total = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
    found = total[offsets[1:]] > total[offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        raw = data[offsets[i] : offsets[i + 1]]
        if (raw >= 128).any():
            found[i] = any(map(str.isalpha, raw.tobytes().decode("utf-8", "replace")))
    return found


def nearest(data: np.ndarray, offsets: np.ndarray, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """(language index, cosine) of each text."""
    v = _vectors(counts(data, offsets, model.params.dims), model.idf)
    s = v @ model.centres.T
    best = np.argmax(s, axis=1)
    return model.owner[best], np.clip(s[np.arange(len(s)), best], 0, 1)


ADDED = ("language", "nearest", "score", "rejected")


def predict(docs: DataFrame, model: LanguageModel | list[LanguageModel]) -> DataFrame:
    """docs with `language`, `nearest`, `score` and `rejected`; one narrow pass, which is longer by one comparison for each block more."""
    models = model if isinstance(model, list) else [model]
    keep = [c for c in docs.columns if c.lower() not in ADDED]
    docs = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([*docs.schema.fields, T.StructField("language", T.StringType()), T.StructField("nearest", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    at, width = position(keep, "text"), len(keep)
    for block, one in enumerate(models):
        # Of a block, centroids * block_languages vectors of dims * 4 bytes at most.
        shared = docs.sparkSession.sparkContext.broadcast(one)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, block=block) -> Iterator[pa.RecordBatch]:
            m = shared.value
            names = np.array([*m.languages, UNKNOWN], dtype=object)
            for batch in batches:
                data, offsets = buffers(batch.column(at))
                for lo, hi, raw, offs in chunks(data, offsets):
                    for a in range(lo, hi, 256):
                        b = min(hi, a + 256)
                        o = offs[a - lo : b - lo + 1]
                        part, o = raw[o[0] : o[-1]], o - o[0]
                        letters = has_letter(part, o) & (len(m.languages) > 0)
                        who, s = nearest(part, o, m) if len(m.languages) else (np.zeros(b - a, int), np.zeros(b - a))
                        near = names[np.where(letters, who, len(m.languages))]
                        s = np.where(letters, s, 0.0).astype(np.float64)
                        piece = batch.slice(a, b - a)
                        if block:
                            # An earlier block's language stays unless this one's is nearer.
                            before = piece.column(width + 2).to_numpy()
                            near = np.where(s > before, near, np.array(piece.column(width + 1).to_pylist(), dtype=object))
                            s = np.maximum(s, before)
                        out = letters & (s < m.limit)
                        lang = np.where(out, UNKNOWN, near)
                        yield pa.RecordBatch.from_arrays([*piece.columns[:width], pa.array(lang, pa.string()), pa.array(near, pa.string()), pa.array(s), pa.array(out)], names=[*keep, *ADDED])

        docs = docs.mapInArrow(run, schema)
    return docs
