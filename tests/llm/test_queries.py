"""The registered queries over whole small tables: columns, folds and base values by plain Python."""

import base64
import collections
import hashlib
import math
import re
import zlib

import pytest
from test_files_and_shards import check_shards, plain_targets
from test_models import plain_statistics
from test_pairs import ASCII_LOWER, components_by_force

from quillspark.llm import pii, queries

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def rows_of(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    return df.columns, {r[0]: r for r in df.collect()}, df


def test_op1(spark, sf, docs):
    columns, rows, _ = rows_of(spark, sf, "op1_toxicity")
    assert columns[:4] == ["doc_id", "held_out", "score", "predicted"] and rows.keys() == docs.keys()
    assert all(r.held_out == (fold(i, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in rows.items())


def test_op2(spark, sf, docs):
    columns, rows, _ = rows_of(spark, sf, "op2_external_shuffle")
    assert columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and rows.keys() == docs.keys()
    for i, r in rows.items():
        raw = (docs[i].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    check_shards(list(rows.values()), 16)


def test_op3(spark, sf, docs):
    columns, rows, _ = rows_of(spark, sf, "op3_near_duplicates")
    want, _ = components_by_force([(i, d.text) for i, d in docs.items()], 3, 85)
    assert columns[:4] == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows.values()) == sorted(want) and all(r.kept == (i == r.component_id) for i, r in rows.items())


def test_op4(spark, sf, docs):
    columns, rows, _ = rows_of(spark, sf, "op4_lm_score")
    assert columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"] and rows.keys() == docs.keys()
    tokens = {i: [*WORDS.findall((d.text or "").translate(ASCII_LOWER)), None] for i, d in docs.items()}
    c = collections.Counter(t for i, ts in tokens.items() if fold(i, 10) for t in ts)
    total, distinct = sum(c.values()), len(c)
    for i, r in rows.items():
        base = sum(math.log10((c[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in tokens[i])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i, 10) == 0, len(tokens[i]), sum(c[t] > 0 for t in tokens[i]), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isfinite(r.score) and r.score < 0


def test_op5(spark, sf, docs):
    columns, rows, _ = rows_of(spark, sf, "op5_pii")
    assert columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"] and rows.keys() == docs.keys()
    for i, r in rows.items():
        spans = pii.base_spans(docs[i].text or "")
        text = pii.joined(spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(filter(None, text.split(","))) <= set(r.spans.split(","))
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]


def test_op6(spark, sf, docs):
    columns, rows, _ = rows_of(spark, sf, "op6_language_id")
    assert columns[:4] == ["doc_id", "held_out", "lang_pred", "score"] and rows.keys() == docs.keys()
    learned = {d.lang for i, d in docs.items() if d.lang and fold(i, 4) != 2}
    for i, r in rows.items():
        has = any(map(str.isalpha, docs[i].text or ""))
        assert r.held_out == (fold(i, 4) == 2) and 0 <= r.score <= 1 and (r.lang_pred in learned if has else r.lang_pred == "und")


def test_op7(spark, sf, docs):
    df = queries.queries()["op7_decontaminate"](spark, sf)
    items = {r.item_id for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    rows = df.collect()
    assert rows and all(r.doc_id in docs and r.item_id in items and 0.5 <= r.score <= 1 for r in rows)


def test_op8(spark, sf, docs):
    columns, rows, _ = rows_of(spark, sf, "op8_quality_rules")
    assert columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"] and rows.keys() == docs.keys()
    for i, r in rows.items():
        want = plain_statistics(docs[i].text)
        assert tuple(r[1:6]) == want and r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def test_op9(spark, sf):
    columns, rows, _ = rows_of(spark, sf, "op9_warc_segments")
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert columns[:5] == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] and rows.keys() == pages.keys()
    first = {}
    for i in sorted(pages, reverse=True):
        first[pages[i]] = i
    for i, r in rows.items():
        low = first[pages[i]]
        assert (r.payload_bytes, r.payload_digest) == (len(pages[i]), base64.b32encode(hashlib.sha1(pages[i]).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if low == i else ("revisit", low))


def test_op10(spark, sf, docs):
    columns, rows, df = rows_of(spark, sf, "op10_mix_sources")
    assert columns[:5] == ["doc_id", "size", "source_size", "target", "taken"] and rows.keys() == docs.keys()
    total, taken = collections.Counter(), collections.Counter()
    for i, r in rows.items():
        assert r["size"] == len(WORDS.findall(docs[i].text or "")) and 0 <= r.taken <= 3 * r["size"]
        total[docs[i].source] += r["size"]
        taken[docs[i].source] += r.taken
    order = sorted(total, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, plain_targets([total[s] for s in order])))
    assert all(abs(r.target - want[docs[i].source]) < 1e-6 * max(1, r.target) and r.source_size == total[docs[i].source] for i, r in rows.items())
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in order)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


def test_no_local_folder_off_one_machine():
    from quillspark.llm import _io

    assert _io.one_machine("local[8]") and _io.one_machine("local") and not any(map(_io.one_machine, ("local-cluster[3,2,1024]", "yarn", "spark://h:7077", "k8s://x")))
