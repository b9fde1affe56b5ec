"""The calibration of toxicity holds for the share of toxic rows, not for that of the sample."""

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import toxicity


def test_share_counts_all_rows(spark):
    docs = spark.createDataFrame([(i, "x") for i in [*range(40), 0, 1]] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 4)) for i in range(20)] + [(10, 1), (None, 1), (30, None), (77, 1)], "doc_id long, toxic int")
    # Toxic: 0 and 1 twice, 2, 3 and 10; ordinary: the other 15 labelled ones; 13 is kept out.
    assert toxicity.toxic_share(docs, labels, F.coalesce(F.col("doc_id") != 13, F.lit(True))) == 7 / 21
    assert toxicity.toxic_share(docs, labels.limit(0), F.lit(True)) is None


def test_an_equal_sample_is_calibrated_to_the_true_share():
    rng = np.random.default_rng(0)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta"]
    line = lambda bad: " ".join("blastfool" if bad and rng.random() < 0.02 else words[i] for i in rng.integers(0, 8, 60))
    toxic, plain = [line(True) for _ in range(150)], [line(False) for _ in range(150)]
    even, rare = toxicity.train(toxic, plain), toxicity.train(toxic, plain, share=0.1)
    assert abs(rare.weights[-1] - even.weights[-1] - np.log(1 / 9)) < 1e-9 and rare.weights[:-1] == even.weights[:-1]
    assert rare.prior == 0.1
    # Of texts at one in ten, the mean score is about one in ten.
    c = toxicity.Compressors(rare)
    mean = lambda docs: np.mean([toxicity.score_bytes(d.encode(), rare, c)[0] for d in docs])
    assert abs(0.1 * mean([line(True) for _ in range(150)]) + 0.9 * mean([line(False) for _ in range(150)]) - 0.1) < 0.05
