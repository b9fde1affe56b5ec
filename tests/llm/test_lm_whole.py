"""The registered language-model score: every bigram counts, and the filter is probed at every size."""

import dataclasses
import math
import zlib

from made_texts import prose

from pyspark.sql import functions as F

from quillspark.llm import lm_score, queries


def saved(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def folds(n, held):
    return [i for i in range(10_000) if (zlib.crc32(str(i).encode()) % 10 == 0) == held][:n]


def test_a_bigram_seen_once_raises_the_score(spark, tmp_path):
    train, held = folds(41, False), folds(2, True)
    rows = [(i, prose(30, i)) for i in train[:-1]] + [(train[-1], "once only here"), (held[0], "once only here"), (held[1], "here only once")]
    got = {r.doc_id: r for r in queries.op4_lm_score(spark, saved(spark, tmp_path, rows)).collect()}
    seen, unseen = got[held[0]], got[held[1]]
    assert seen.n_known == unseen.n_known == 4 and math.isclose(seen.base_score, unseen.base_score)
    # All four bigrams of the first text were seen once, of the second none.
    assert seen.score > unseen.score + 2


def test_segments_score_as_the_broadcast_filter_does(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "RUN_BYTES", 4000)
    # Few bits, so that false positives are common and have to be the same ones.
    params = lm_score.LmParams(bits_per_item=3.0, held_tokens=300)
    rows = [(i, prose(40, i % 23) + f" Only{i} word") for i in range(60)] + [(90, None), (91, ""), (92, "a A a A a"), (None, "no id"), (93, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    df.cache()
    learned = F.coalesce(F.col("doc_id") % 5 != 0, F.lit(True))
    show = lambda p: sorted((repr(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9), round(r.score, 9)) for r in lm_score.score(df, learned, p).collect())
    small = show(params)
    assert len(small) == len(rows) and small == show(dataclasses.replace(params, max_filter_bytes=0)) == show(dataclasses.replace(params, max_vocab_bytes=0))
    more = show(dataclasses.replace(params, bits_per_item=40.0, hashes=20))
    assert [r[:5] for r in more] == [r[:5] for r in small] and more != small
    usual = lm_score.LmParams()
    assert show(usual) == show(dataclasses.replace(usual, max_filter_bytes=0, max_vocab_bytes=0))


def test_segments_of_hard_and_missing_texts(hard_docs, empty_docs):
    for most in (128 << 20, -1):
        params = lm_score.LmParams(max_filter_bytes=most)
        rows = lm_score.score(hard_docs, F.lit(True), params).collect()
        assert len(rows) == 10 and {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {1}
        assert lm_score.score(empty_docs, F.lit(True), params).count() == 0
        none = lm_score.score(hard_docs, F.lit(False), params).collect()
        assert {r.train_tokens for r in none} == {0} and all(math.isfinite(r.score) for r in none)
