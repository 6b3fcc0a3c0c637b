"""What keeps the queries whole on tables of 60 times the size."""

import numpy as np
import pytest
from compare import DATA
from pyspark.sql import functions as F

from deltaspan.functions import numeric
from deltaspan.operators import bayes, resample
from deltaspan.plans import registry

COUNTS = "TestCaseId string, AssertionId string, y_prev bigint, n_prev bigint, y_next bigint, n_next bigint"


def some_counts(spark, pairs=30):
    return spark.createDataFrame([(f"c{i // 3:02d}", f"a{i % 3}", i % 7, 8, (i * 5) % 9, 8) for i in range(pairs)], COUNTS)


def test_parts_of_the_density_agree_with_the_whole(monkeypatch):
    rng = np.random.default_rng(1)
    counts = {"y_prev": rng.integers(0, 5, 50), "n_prev": np.full(50, 5), "y_next": rng.integers(0, 5, 50), "n_next": np.full(50, 5)}
    monkeypatch.setattr(bayes, "BLOCK", 16)
    for cases, covariate in ((None, True), (np.arange(50) // 5, True), (None, False)):
        d = bayes.Density(counts, cases, covariate)
        x = rng.normal(0, 0.5, d.size)
        lp, g = d(x)
        assert d.value(x) == pytest.approx(lp, rel=1e-12) and np.allclose(d.slope(x), g, rtol=1e-4, atol=1e-4)


def test_scalars_of_draws_are_those_of_their_vectors(spark):
    counts = some_counts(spark)
    whole, scalars = (bayes.sample(spark, counts, 2, 60, 80, vectors=v) for v in (True, False))
    assert not [t for _, t in scalars.dtypes if t.startswith("array")]
    key, names = ["chain", "draw"], ["lp", "tau", "theta", "overall_delta"]
    a, b = (x.orderBy(*key).select(*key, *names).collect() for x in (whole, scalars))
    assert len(a) == 120 and a == b
    a, b = (np.array(bayes.mean_rates(x).orderBy(*key).select("mean_prev", "mean_next").collect()) for x in (whole, scalars))
    assert np.allclose(a, b, rtol=1e-12)


def test_top_pairs_without_a_table_of_all_draws(spark):
    counts = some_counts(spark)
    want = bayes.top_pairs(bayes.pair_summary(bayes.sample(spark, counts, 2, 60, 80), counts), 7).collect()
    found = bayes.top_pairs_of(spark, counts, 7, 2, 60, 80).collect()
    assert [r.label for r in found] == [r.label for r in want] and len(want) == 7
    for x, y in zip(found, want):
        assert (x.delta_mean, x.delta_ci_lo, x.delta_ci_hi, x.prob_improved) == pytest.approx((y.delta_mean, y.delta_ci_lo, y.delta_ci_hi, y.prob_improved), abs=1e-12)
    assert bayes.top_pairs_of(spark, counts.limit(0)).collect() == []


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_queries_of_the_model_draw_no_vectors(spark):
    assert not [t for _, t in registry._model(spark, str(DATA)).dtypes if t.startswith("array")]
    assert registry.QUERIES["mean_rates"](spark, str(DATA)).agg(F.count("*")).first()[0] == 4_000


def test_draws_in_arrays_are_those_of_the_columns(spark, monkeypatch):
    n, states = 1_000, [(5, 7), (2**28 - 1, 2**28 - 1), (0, 0)]
    table = spark.range(n).withColumn("slot", F.col("id"))
    monkeypatch.setattr(resample, "SLOTS", 64)
    monkeypatch.setattr(resample, "_STRIDES", np.arange(64) * numeric.STRIDE)
    values = np.arange(n) ** 1.5
    for one, two in states:
        want = np.array([r[0] for r in table.select(numeric.draw_place(F.lit(n), (F.lit(one), F.lit(two)), F.col("slot"))).collect()])
        assert resample.drawn_sum(values, 0, n, one, two) == (pytest.approx(values[want].sum()), n)
        part = want[(want >= 300) & (want < 500)]
        assert resample.drawn_sum(values[300:500], 300, n, one, two) == (pytest.approx(values[part].sum()), len(part))


def test_replicates_of_a_group_in_several_arrays(spark, monkeypatch):
    cases = spark.createDataFrame([(m, f"c{i:02d}", float(i * i % 17)) for m in "ab" for i in range(30)], "LLMScore string, TestCaseId string, Diff double")
    want = {r.rep: r.boot_mean for r in resample.pooled_replicates(cases, 250).collect()}
    monkeypatch.setattr(resample, "HELD", 10)
    monkeypatch.setattr(resample, "CHUNK", 7)
    pooled = resample.pooled_replicates(cases, 250)
    # Arrays of at most CHUNK places stand for the group; no row for each draw.
    arrays = resample._chunks(cases.select(F.lit("p").alias("group_"), "LLMScore", "TestCaseId", "Diff", F.lit(0).alias("range_"), F.lit(60).alias("n")))
    assert sorted((r.start, len(r["values"])) for r in arrays.collect()) == [(7 * i, 7) for i in range(8)] + [(56, 4)]
    assert {r.rep: r.boot_mean for r in pooled.collect()} == pytest.approx(want, abs=1e-12) and len(want) == 250
