"""The toxicity sample takes both labels evenly and calibrates to their share."""

import numpy as np
from pyspark.sql import functions as F

from deltaspan.llm import toxicity


def test_sample_is_even_as_far_as_labels_go(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("en").alias("lang"))
    every = lambda c: F.lit(True)
    for toxic, limit, want in ((100, 120, (60, 60)), (20, 120, (100, 20)), (100, 1000, (500, 100)), (0, 120, (120, 0))):
        labels = spark.range(600).select(F.col("id").alias("doc_id"), (F.col("id") < toxic).cast("int").alias("toxic"))
        taken = toxicity.shares(toxicity.usable_labels(labels, "toxic", every), limit)
        rows = toxicity.training_rows(docs, labels, "toxic", every, limit, balance=taken)
        found = [y for _, y, _ in rows]
        assert (found.count(0), found.count(1)) == (min(want[0], 600 - toxic), want[1])


def test_calibration_is_to_the_share_of_all_rows():
    rng = np.random.default_rng(3)
    y = np.repeat([0.0, 1.0], [9000, 1000])
    logit = rng.normal(np.where(y == 1, 1, -1), 1.5)
    even = np.r_[np.arange(1000), np.arange(9000, 10000)]
    weight = np.where(y == 1, 1.0, 9.0)[even]
    slope, offset = toxicity.platt(logit[even], y[even], weight=weight / weight.mean())
    assert abs((1 / (1 + np.exp(-slope * logit - offset))).mean() - 0.1) < 0.015
    slope, offset = toxicity.platt(logit[even], y[even])
    assert (1 / (1 + np.exp(-slope * logit - offset))).mean() > 0.15
