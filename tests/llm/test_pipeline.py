"""Every stage of the corpus pipeline against a brute-force version, each on its own input."""

import collections
import math
import re

import numpy as np
import pyarrow as pa
from test_files_and_shards import check_shards, plain_targets
from test_models import ASCII_LOWER, plain_kneser_ney, plain_statistics
from test_pairs import components_by_force

import corpus_pipeline
from quillspark.llm import decontaminate, quality
from quillspark.llm._io import Table
from quillspark.llm._vec import IS_LETTER, Words, buffers

FOLD = bytes(48 if 48 <= b < 58 else 32 if b in (9, 10, 11, 12, 13) else b for b in range(256))


def grams_of(text):
    raw = (text or "").translate(ASCII_LOWER).encode().translate(FOLD)
    return [raw[i : i + 5] for i in range(len(raw) - 4)]


def kept_by_rules(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.lang].append(r)
    out = set()
    for mine in by.values():
        p = plain_kneser_ney([g for r in mine for g in grams_of(r.text)], 5)
        ppl, words = {}, {}
        for r in mine:
            g = grams_of(r.text)
            ppl[r.doc_id] = -sum(math.log10(p[x]) for x in g) / len(g) if g else None
            words[r.doc_id] = plain_statistics(r.text)
        usual = sorted(v for i, v in ppl.items() if v is not None and words[i][0] >= 50)
        if not usual:
            continue
        at = lambda q: usual[max(0, math.ceil(q * len(usual)) - 1)]
        q = quality.QualityParams()
        half = max(q.least_width, q.width * (at(0.75) - at(0.25)))
        for r in mine:
            n, repeated = words[r.doc_id][0], words[r.doc_id][4]
            if n >= 50 and 100 * repeated <= 50 * n and abs(ppl[r.doc_id] - at(0.5)) <= half * math.sqrt(1 + q.short_words / n) + 1e-9:
                out.add(r.doc_id)
    return out


def hashed(texts):
    data, offsets = buffers(pa.array(texts))
    w = Words(data, offsets, IS_LETTER)
    h = w.hashes()
    return [h[a:b] for a, b in zip(w.first[:-1], w.first[1:])]


def test_stages_equal_brute_force(spark, sf):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "benchmark decontamination", "mix sources", "external shuffle"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(Table(stage(spark, tables[-1], sf), "stage").df)
    rows = [t.collect() for t in tables]
    assert all(t.columns == names for t in tables[:5])
    assert {r.doc_id for r in rows[1]} == kept_by_rules(rows[0])
    found, groups = components_by_force([(r.doc_id, r.text) for r in rows[1]], 5, 80)
    assert sorted(r.doc_id for r in rows[2]) == sorted({c for _, n, c in found}) and len(rows[2]) == groups
    items = [x for x in hashed([r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]) if len(x)]
    whole = hashed([r.text for r in rows[2]])
    pairs = [(i, d) for d in range(len(whole)) for i in range(len(items))]
    score = decontaminate.smith_waterman([(items[i], whole[d]) for i, d in pairs])[:, 0]
    copies = {rows[2][d].doc_id for (i, d), s in zip(pairs, score) if s >= 0.5 * len(items[i])}
    assert copies and {r.doc_id for r in rows[3]} == {r.doc_id for r in rows[2]} - copies
    count = lambda rs: collections.Counter() if not rs else sum((collections.Counter({r.source: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))}) for r in rs), collections.Counter())
    before, after = count(rows[3]), count(rows[4])
    order = sorted(before)
    assert all(abs(after[s] - t) <= 0.5 for s, t in zip(order, plain_targets([before[s] for s in order])))
    assert collections.Counter(r.doc_id for r in rows[4]) == collections.Counter(r.doc_id for r in rows[5])
    check_shards(rows[5], 16)
    again = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, r.text) for r in again.collect()) == sorted((r.doc_id, r.text) for r in rows[5])


def test_stages_on_hard_and_empty_tables(spark, sf, hard_docs, empty_docs):
    for docs in (hard_docs, empty_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = Table(stage(spark, docs, sf), "stage").df
        assert np.isfinite(docs.count())
