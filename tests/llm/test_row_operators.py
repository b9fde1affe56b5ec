"""Toxicity, personal data and language identification: operators that look at one row at a time."""

import dataclasses
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import _io, language_id, pii, toxicity


def test_toxicity_separates_marked_texts():
    rng = np.random.default_rng(0)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta"]
    line = lambda bad: " ".join("blastfool" if bad and rng.random() < 0.06 else words[i] for i in rng.integers(0, 8, 120))
    toxic, plain = [line(True) for _ in range(120)], [line(False) for _ in range(240)]
    m = toxicity.train(toxic[:90], plain[:180])
    c = toxicity.Compressors(m)
    score = lambda t: toxicity.score_bytes(t.encode(), m, c)[0]
    hot, cold = np.array([score(t) for t in toxic[90:]]), np.array([score(t) for t in plain[180:]])
    assert (hot[:, None] > cold[None]).mean() > 0.9


def test_toxicity_edge_cases(hard_docs, empty_docs):
    m = toxicity.train(["you fool " * 30] * 6, ["a quiet line " * 30] * 6)
    rows = toxicity.score(hard_docs, m).collect()
    assert len(rows) == 10 and all(0.0 <= r.score <= 1.0 for r in rows) and rows[0].shard == 7
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert toxicity.score(empty_docs, m).count() == 0
    assert {r.score for r in toxicity.score(hard_docs, toxicity.train([], ["x"])).collect()} == {0.0}


LOCAL, LABEL = "[A-Za-z0-9._%+-]+", "[A-Za-z0-9-]+"


def plain_spans(text):
    rules = {
        "email": (LOCAL + "@" + LABEL + "(\\." + LABEL + ")+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", pii.is_card),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", pii.is_phone),
    }
    found = [(k, *m.span()) for k, (p, ok) in rules.items() for m in re.finditer(p, text) if ok(m.group())]
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@pytest.mark.parametrize(
    "text",
    ["", "a@b.c", "x@@y.com", "a@b a@b.co,c@d.e.f", "1.2.3.4.5.6.7.8", "256.1.1.1 10.0.0.255", "4111 1111 1111 1111", "4111-1111-1111-1112 +1 (415) 555-0100.", "é+49 30 1234567 éa.b@c-d.org", "000255.1.1.1", "+1+2 3", "@a.b", "a.@-.-"],
)
def test_base_spans_equal_plain_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_equal_plain_patterns_at_random():
    rng = np.random.default_rng(1)
    for _ in range(400):
        text = "".join(rng.choice(list("a1.@+- 25(é"), 60))
        assert pii.base_spans(text) == plain_spans(text)


def test_long_runs_stay_linear():
    assert pii.base_spans("a" * 300_000 + "1" * 300_000) == []


def test_network_learns_and_gradients_agree():
    params = pii.PiiParams(rounds=200, synthetic=900)
    net = pii.train(pii.synthetic(900, 5), params)
    held = pii.synthetic(120, 77)
    got = pii.model_spans([t for t, _ in held], net, params)
    right = sum(len(set(a) & set(b)) for a, (_, b) in zip(got, held))
    assert right / max(1, sum(map(len, got))) > 0.75 and right / sum(len(b) for _, b in held) > 0.5
    x = np.random.default_rng(0).integers(1, pii.CLASSES, (2, 8))
    y = np.zeros((2, 8), int)
    y[0, 2:5] = [1, 2, 2]
    _, grad = net.loss(x, y)
    for key, at in (("out", (3, 1)), ("hf", (2, 5)), ("xb", (1, 7)), ("bias", (2,))):
        keep = net.p[key][at]
        net.p[key][at] = keep + 1e-2
        up = net.loss(x, y)[0]
        net.p[key][at] = keep - 1e-2
        down = net.loss(x, y)[0]
        net.p[key][at] = keep
        assert abs((up - down) / 2e-2 - grad[key][at]) < 2e-3


def test_pii_edge_cases(spark, hard_docs, empty_docs):
    params = pii.PiiParams(rounds=20, synthetic=100)
    net = pii.fit(hard_docs, params)
    rows = pii.find(hard_docs, net, params).collect()
    assert len(rows) == 10 and [r.n_card for r in rows if r.text is None or r.text == ""] == [0, 0]
    assert pii.find(empty_docs, net, params).count() == 0
    one = spark.createDataFrame([(1, "mail é a.b@c.org now")], "doc_id long, text string")
    r = pii.find(one, net, params).first()
    assert r.base_spans == "email:7:16" and pii.masked(r.text, r.base_spans) == "mail é [email] now"


def test_language_accuracy_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    fold = docs.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4)
    fit, rest = docs[fold != 2], docs[fold == 2]
    m = language_id.train(fit.text.tolist(), fit.lang.tolist())
    found = language_id.predict(spark.createDataFrame(rest[["doc_id", "text", "lang"]]), m).toPandas()
    assert (found.nearest == found.lang).mean() > 0.97


def test_language_edge_cases(hard_docs, empty_docs):
    m = language_id.train(["the cat and the dog " * 5, "der hund und die katze " * 5], ["en", "de"])
    rows = language_id.predict(hard_docs, m).collect()
    assert len(rows) == 10 and all(0.0 <= r.score <= 1.0 for r in rows)
    blank = [r for r in rows if not r.text or not r.text.strip()]
    assert {r.nearest for r in blank} == {"und"} and {r.score for r in blank} == {0.0}
    assert language_id.predict(empty_docs, m).count() == 0
    assert {r.language for r in language_id.predict(hard_docs, language_id.train([], [])).collect()} == {"und"}


def test_letters_of_any_script():
    from quillspark.llm._vec import buffers
    import pyarrow as pa

    data, offsets = buffers(pa.array(["", "12 .,", "a", "中", "– …", None, "é"]))
    assert language_id.has_letter(data, offsets).tolist() == [False, False, True, True, False, False, True]


def test_blocks_of_languages_make_no_difference(spark, sf, empty_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    learned = F.col("doc_id") % 3 != 0
    params = language_id.LanguageParams(max_docs=30)
    whole, parts = language_id.fit(docs, learned, params), language_id.fit(docs, learned, dataclasses.replace(params, block_languages=1))
    assert len(whole) == 1 and len(parts) == len(whole[0].languages) > 2
    show = lambda m: sorted((repr(r.doc_id), r.nearest, round(r.score, 5), r.rejected) for r in language_id.predict(docs, m).collect())
    assert show(whole) == show(parts)
    assert {r.language for r in language_id.predict(docs, language_id.fit(empty_docs, F.lit(True))).collect()} == {"und"}


def test_samples_reach_all_over_long_texts(spark):
    text = "a" * 50_000 + "z1" * 3000 + "b" * 50_000
    df = spark.createDataFrame([(1, text), (2, None), (3, "short"), (3, "short")], "doc_id long, text string")
    got = [r[0] for r in df.select(_io.spread(F.col("text"), 6400).alias("t")).collect()]
    assert len(got[0]) == 6400 + 31 and got[0].startswith("aaa") and got[0].endswith("bbb") and "z1z1" in got[0] and got[1:] == [None, "short", "short"]
    assert len(pii.sample(df, pii.PiiParams(max_doc_chars=640))) == 1


def test_windows_in_parts_equal_windows_at_once():
    params = pii.PiiParams(rounds=20, synthetic=200)
    net = pii.train(pii.synthetic(200, 1), params)
    texts = [" ".join(t for t, _ in pii.synthetic(40, k)) for k in range(6)]
    whole = pii.model_spans(texts, net, params)
    assert [pii.model_spans([t], net, params)[0] for t in texts] == whole and any(whole)
