"""The two language models against plain counts."""

import collections
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from made_texts import prose
from pyspark.sql import functions as F

from quillspark.llm import lm_score, quality
from quillspark.llm._vec import buffers

ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER)), "\0end"]


def plain_scores(rows, held):
    c, pairs = collections.Counter(), collections.Counter()
    for i, t in rows:
        if not held(i):
            w = plain_tokens(t)
            c.update(w)
            pairs.update(zip(["\0end", *w], w))
    n, v = sum(c.values()), len(c)
    level = lambda k: math.floor(math.log2(k)) if k else -1
    word = lambda x: 1.5 * 2.0 ** level(c[x]) - 0.5 if c[x] else 0.0
    pair = lambda x: 1.5 * 2.0 ** level(pairs[x]) - 0.5 if pairs[x] else 0.0
    out = []
    for i, t in rows:
        w = plain_tokens(t)
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        score = 0.0
        for a, b in zip(["\0end", *w], w):
            share = 0.5 if word(a) else 0.0
            ratio = min(1.0, pair((a, b)) / word(a)) if word(a) else 0.0
            score += math.log10(share * ratio + (1 - share) * min(1.0, (word(b) + 0.1) / (n + 0.1 * (v + 1))))
        out.append((i, len(w), sum(c[x] > 0 for x in w), n, base, score))
    return out


@pytest.mark.parametrize("params", [lm_score.LmParams(hashes=20, bits_per_item=40.0, held_tokens=300), lm_score.LmParams(hashes=20, bits_per_item=40.0, max_vocab_bytes=0)])
def test_lm_scores_equal_plain_counts(spark, params):
    rows = [(i, prose(40, i % 7) + f" Only{i} word") for i in range(40)] + [(90, None), (91, ""), (92, "a A a A a"), (None, "no id")]
    held = lambda i: i is not None and i % 5 == 0
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lm_score.score(df, F.coalesce(F.col("doc_id") % 5 != 0, F.lit(True)), params).collect()}
    assert len(got) == len(rows)
    for i, n, known, total, base, score in plain_scores(rows, held):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-6)


def test_lm_edge_cases(hard_docs, empty_docs):
    rows = lm_score.score(hard_docs, F.lit(True)).collect()
    assert len(rows) == 10 and {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {1}
    assert lm_score.score(empty_docs, F.lit(True)).count() == 0
    none = lm_score.score(hard_docs, F.lit(False)).collect()
    assert {r.train_tokens for r in none} == {0} and all(math.isfinite(r.score) for r in none)


def test_filter_has_no_false_negatives():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**64, 3000, dtype=np.uint64))
    counts = rng.integers(1, 200, len(keys))
    bits, size = lm_score.segment([(lm_score.WORD, keys, counts)], lm_score.LmParams())
    f = lm_score.Filter(bits, np.array([0]), np.array([size]), lm_score.LmParams().hashes)
    assert (f.level(keys, lm_score.WORD) >= lm_score.levels_of(counts)).all()
    other = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    assert (f.level(other, lm_score.WORD) > 0).mean() < 0.05


def plain_statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    c = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {j + k for j in range(len(w) - 2) if c[w[j], w[j + 1], w[j + 2]] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_statistics_equal_plain_code():
    texts = ["", None, "a a a a", "x y z x y z\nx y z\n \n \nq\nq", "é ü é ü é ü #*", "|<>&", "one\n\ntwo\n\none\none", prose(50, 1) + "\n" + prose(50, 1)]
    data, offsets = buffers(pa.array(texts))
    s = quality.statistics(data, offsets)
    assert list(zip(*[s[k].tolist() for k in quality.STATS])) == [plain_statistics(t) for t in texts]


def plain_kneser_ney(grams, n):
    """Probabilities of all n-grams (bytes) by the textbook recursion."""
    counts = {n: collections.Counter(grams)}
    for k in range(n - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    p = {}
    for k in range(1, n + 1):
        c = counts[k]
        m = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        y = m[0] / (m[0] + 2 * m[1]) if m[0] + 2 * m[1] else None
        d = [max(0.05, min(i - 0.05, i - (i + 1) * y * m[i] / m[i - 1] if y is not None and m[i - 1] else 0.5 * i)) for i in (1, 2, 3)]
        contexts = collections.defaultdict(list)
        for g, v in c.items():
            contexts[g[:-1]].append(v)
        for g, v in c.items():
            vs = contexts[g[:-1]]
            passed = sum(d[min(x, 3) - 1] for x in vs) / sum(vs)
            p[g] = (v - d[min(v, 3) - 1]) / sum(vs) + passed * (p[g[1:]] if k > 1 else 1 / 256)
    return p


def test_perplexity_equals_plain_kneser_ney(spark):
    texts = [prose(60, i) for i in range(12)]
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    params = quality.QualityParams(order=3, held_entries=500)
    (_, model), = quality.models(docs, params)
    grams = [t.translate(ASCII_LOWER).encode().translate(bytes(48 if 48 <= b < 58 else b for b in range(256)))[i : i + 3] for t in texts for i in range(len(t) - 2)]
    p = plain_kneser_ney(grams, 3)
    keys = np.array([int.from_bytes(g, "big") for g in p if len(g) == 3], np.uint64)
    got = model.log10(quality.language_hash("en"), keys)
    assert np.allclose(got, [math.log10(p[g]) for g in p if len(g) == 3], atol=1e-5)
    # Of every known context the probabilities of all bytes add up to one, unknown n-grams included.
    context = int.from_bytes(grams[5][:2], "big")
    every = np.array([context * 256 + b for b in range(256)], np.uint64)
    assert abs((10 ** model.log10(quality.language_hash("en"), every)).sum() - 1) < 1e-3


def test_bands_reject_gibberish_and_keep_prose(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "en", prose(120, i)) for i in range(150)] + [(900, "en", " ".join("".join(rng.choice(list("qxzjkvw"), 9)) for _ in range(120)))]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert not got[900].kept and not got[900].base_failed and sum(r.kept for r in got.values()) >= 148
    kept = {r.doc_id for r in quality.keep(docs).collect()}
    assert kept == {i for i, r in got.items() if r.kept}
    for most in (1500, 10**5):
        mixed = docs.unionByName(docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "de")).withColumn("doc_id", F.col("doc_id") + 1000))
        grouped = quality.QualityParams(max_entries=most)
        whole = {r.doc_id: r for r in quality.judge(mixed).collect()}
        parts = {r.doc_id: r for r in quality.judge(mixed, grouped).collect()}
        assert whole.keys() == parts.keys() and all(w.kept == parts[i].kept and abs(w.log_ppl - parts[i].log_ppl) < 1e-9 for i, w in whole.items())
        assert {r.doc_id for r in quality.keep(mixed, grouped).collect()} == {i for i, r in whole.items() if r.kept}


def test_quartiles_equal_sorted_values(spark):
    rng = np.random.default_rng(5)
    rows = [(lang, float(v), 60) for lang, n in (("a", 1), ("b", 2), ("c", 501), (None, 40)) for v in np.round(rng.normal(1.0, 0.0001 if lang == "c" else 0.1, n), 12)]
    rows += [("c", 9.0, 49), ("d", None, 60)]
    p = quality.QualityParams()
    got = {r.lang: (r.mid, r.half) for r in quality.bands_of(spark.createDataFrame(rows, "lang string, log_ppl double, n_words long"), p).collect()}
    by = collections.defaultdict(list)
    for lang, v, n in rows:
        if v is not None and n >= p.min_words:
            by[lang].append(v)
    assert got.keys() == by.keys()
    for lang, v in by.items():
        at = lambda q: sorted(v)[max(0, math.ceil(q * len(v)) - 1)]
        assert abs(got[lang][0] - at(0.5)) < 2e-9 and abs(got[lang][1] - max(p.least_width, p.width * (at(0.75) - at(0.25)))) < 1e-8


def test_quality_edge_cases(hard_docs, empty_docs):
    rows = quality.judge(hard_docs).collect()
    assert len(rows) == 10 and all(r.base_failed for r in rows if r.doc_id in (3, 4, 5, 7, 8))
    assert quality.keep(hard_docs).columns == hard_docs.columns
    assert quality.judge(empty_docs).count() == 0 and quality.keep(empty_docs).count() == 0
