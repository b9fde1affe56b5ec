"""Lines of many words: the same results as by plain Python, in time that grows with the words."""

import time

import pytest
from pyspark.sql import functions as F

from quillspark.functions import geometry as g
from quillspark.functions import text as tx


def boxes(words, x1, x2, least=10.0):
    unit = (x2 - x1) / (float(sum(max(len(w), 1) for w in words)) + (len(words) - 1) * 0.5)
    out, at = [], None
    for w in words:
        start = x1 if at is None else at + 0.5 * unit
        at = min(start + max(max(len(w), 1) * unit, least), x2)
        out.append((w, start, at))
    return out


@pytest.mark.parametrize("count", [2, 63, 64, 65, 129, 12_000])
def test_word_boxes(spark, count):
    words = [("ab", "cdefg", "h", "ijkl")[i * i % 4] + "xyz"[: i % 4] for i in range(count)]
    line = spark.createDataFrame([(" ".join(words), 40.0, 40.0 + 30 * count, 540.0)], "content string, x1 double, wide double, x2 double")
    of = lambda right: g.word_boxes([F.col("x1"), F.lit(0.0), F.col(right), F.lit(9.0)], tx.words(F.col("content")))
    began = time.time()
    r = line.select(of("wide").alias("wide"), of("x2").alias("narrow")).first()
    assert [tuple(w) for w in r.wide] == boxes(words, 40.0, 40.0 + 30 * count) and [tuple(w) for w in r.narrow] == boxes(words, 40.0, 540.0)
    assert time.time() - began < 30


def test_repeated_words(spark):
    words = [w for i in range(15_000) for w in (f"w{i}", f"W{i}", "x")]
    began = time.time()
    df = spark.createDataFrame([(" ".join(words),), ("a b",), ("",), (None,), ("x X  x y",)], "c string")
    r = df.select(*[c.alias(n) for c, n in zip(tx.repeated_words(F.col("c")), ("t", "n"))]).collect()
    assert (r[0].t, r[0].n) == (" ".join(w for w in words if w[0] != "W"), 15_000)
    assert [tuple(x) for x in r[1:]] == [("a b", None), ("", None), (None, None), ("x y", 2)]
    assert time.time() - began < 30


def test_patterns_are_matched_once(spark):
    """No filter holds the patterns of the score, and repeats in long lines are found in time."""
    from quillspark.functions import hallucination as h
    from quillspark.operators import scoring

    words = " ".join(f"w{i}" for i in range(15_000))
    columns = "doc_id long, page_no long, elem_idx long, type string, content string, x1 double, y1 double, x2 double, y2 double, confidence double, source_model string"
    rows = [(1, 1, i, "text", c, 100.0, 100.0 + i, 300.0, 120.0 + i, 0.9, "surya") for i, c in enumerate((words, words + " same same", None))]
    df = spark.createDataFrame(rows, columns)
    began = time.time()
    got = df.select("elem_idx", h.has_repetition(F.col("content")).alias("r")).collect()
    assert [r.r for r in sorted(got)] == [False, True, None]
    done = scoring.process_hallucinations(df)
    assert not [line for line in done._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in line and "RLIKE" in line]
    assert done.count() == 3 and time.time() - began < 30


def test_tokens_of_one_word_are_dealt(spark):
    """Short words, and many tokens of one misread word, don't all go to one key of the join."""
    from quillspark.operators import spelling

    df = spark.range(400).selectExpr("id AS doc_id", "1L AS page_no", "0L AS elem_idx", "'text' AS type", "'of thc  housc! ' AS content")
    vocabulary = spark.createDataFrame([("house", 9), ("the", 9)], "word string, freq long")
    done = spelling.correct_nonwords(df, vocabulary)
    assert {(r.content, r["count"]) for r in done.groupBy("content").count().collect()} == {("of thc house!", 400)}
    assert "deal" in done._jdf.queryExecution().optimizedPlan().toString()
