"""Edit distances by blocks against a table a row at a time, and the measures that follow from them."""

import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.functions import distance, metrics


def changed(rng, s, letters):
    out = []
    for c in s:
        k = rng.random()
        out += [] if k < 0.1 else [c, rng.choice(letters)] if k < 0.2 else [rng.choice(letters)] if k < 0.3 else [c]
    return out


def test_blocks_of_any_lengths(monkeypatch):
    rng = random.Random(1)
    letters = "abcdé\U0001f600"
    sizes = [0, 1, 2, 62, 63, 64, 65, 127, 128, 129, 500] + [rng.randrange(90) for _ in range(150)]
    a = [[rng.choice(letters) for _ in range(n)] for n in sizes]
    b = [changed(rng, s, letters) if i % 3 else [rng.choice(letters) for _ in range(rng.randrange(200))] for i, s in enumerate(a)]
    want = [metrics.edit_distance(x, y) for x, y in zip(a, b)]
    texts = ["".join(x) for x in a], ["".join(x) for x in b]
    assert distance.of_texts(*texts).tolist() == want == distance.of_texts(*texts[::-1]).tolist()
    assert distance.of_words(pa.array(a), pa.array(b)).tolist() == want
    monkeypatch.setattr(distance, "TABLE_BYTES", 0)
    monkeypatch.setattr(distance, "BLOCK_STEPS", 300)
    assert distance.of_texts(*texts).tolist() == want
    assert distance.of_texts(["", "x"], ["", ""]).tolist() == [0, 1]


def test_long_lines_take_seconds():
    rng = random.Random(2)
    a = "".join(rng.choices("abcdefgh ", k=60_000))
    began = time.time()
    assert distance.of_texts([a], [a[7:].replace("a", "b")])[0] >= 7
    assert time.time() - began < 30


def test_rates_of_missing_and_blank_texts(spark):
    df = spark.createDataFrame([("Ab c.", "ab d"), (None, "x"), ("x", None), ("", "x"), ("same", "same")], "r string, h string")
    m = metrics.evaluate(df, F.col("r"), F.col("h"))
    got = [(r.strict_cer, r.flexible_cer, r.strict_wer) for r in m.select("strict_cer", "flexible_cer", "strict_wer").collect()]
    assert got == [(0.5, 1 / 3, 0.5), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0)]
