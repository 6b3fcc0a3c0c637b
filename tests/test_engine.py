"""Edges and invariants on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltaspan.functions import numeric
from deltaspan.operators import assertions, bayes, coverage, cuped, inference, paired, resample, simulate
from deltaspan.plans import pipeline

OBS = "Period string, TestCaseId string, LLMScore string, Value double"


def obs(spark, rows):
    return spark.createDataFrame(rows, OBS)


def usual(spark):
    rng = np.random.default_rng(1)
    rows = [(p, f"c{c}", m, float(rng.normal(c % 5, 1) + (p == "Next") * 0.3)) for p in ("Previous", "Next") for c in range(30) for m in ("a", "b") for _ in range(3) if not (p == "Next" and c < 3) and not (p == "Previous" and c > 26)]
    return obs(spark, rows)


def test_theta_is_one_and_diff_is_raw(spark):
    o = usual(spark)
    for r in cuped.theta(o).collect():
        assert abs(r.theta - 1) < 1e-9 and abs(r.OLS_slope - r.theta) < 1e-9
    raw = o.groupBy("TestCaseId", "LLMScore").agg((F.avg(F.when(F.col("Period") == "Next", F.col("Value"))) - F.avg(F.when(F.col("Period") == "Previous", F.col("Value")))).alias("raw"))
    both = cuped.per_case(cuped.adjusted(o)).join(raw, ["TestCaseId", "LLMScore"]).collect()
    assert all((r.Diff is None) == (r.raw is None) and (r.raw is None or abs(r.Diff - r.raw) < 1e-9) for r in both)


def test_constant_metric(spark):
    o = obs(spark, [(p, c, "m", 1.0) for p in ("Previous", "Next") for c in "ab"])
    t = cuped.theta(o).first()
    assert (t.theta, t.corr_XY, t.OLS_slope, t.variance_or_corr_flag) == (0.0, None, None, True)
    s = cuped.summary(cuped.per_case(cuped.adjusted(o))).first()
    assert s.cohens_d is None and s.n_cases == 2
    assert inference.paired_t(cuped.per_case(cuped.adjusted(o))).first().p_value_ttest is None


def test_next_only_cases_and_imputation(spark):
    o = obs(spark, [("Previous", "a", "m", 1.0), ("Previous", "b", "m", 3.0), ("Next", "a", "m", 2.0), ("Next", "z", "m", 9.0), ("Next", "z", "new", 1.0), ("Next", None, "m", 5.0)])
    rows = {(r.TestCaseId, r.LLMScore): r for r in cuped.per_case(cuped.adjusted(o)).collect()}
    assert rows["z", "m"].Next_CUPED_Mean is None and rows["z", "m"].Diff is None
    assert rows["b", "m"].Next_CUPED_Mean is None and len(rows) == 4
    filled = {(r.TestCaseId, r.LLMScore): r for r in cuped.per_case(cuped.adjusted(o, True)).collect()}
    assert filled["z", "m"].Next_CUPED_Mean == pytest.approx(9.0)
    s = {r.LLMScore: r for r in cuped.summary(cuped.per_case(cuped.adjusted(o))).collect()}
    assert s["new"].n_cases == 0 and s["new"].mean_diff is None and s["m"].n_cases == 1
    assert coverage.coverage(o).where("LLMScore = 'new'").first().coverage_rate_next == 0.0


def test_coverage_flag_is_strict(spark):
    o = obs(spark, [("Next", str(i), "m", 1.0) for i in range(10)] + [("Previous", str(i), "m", 1.0) for i in range(7)])
    r = coverage.coverage(o).first()
    assert r.coverage_rate_next == 0.7 and r.low_overlap_flag is False


def test_t_distribution(spark):
    # Two-sided p from tables: t = 12.706 (1), 4.303 (2), 2.571 (5), 2.228 (10), 2.042 (30).
    rows = [(12.706, 1), (4.303, 2), (2.571, 5), (2.228, 10), (2.042, 30), (1.96, 1_000_000), (0.0, 4)]
    df = spark.createDataFrame(rows, "t double, df bigint").select("df", numeric.t_two_sided(F.col("t"), F.col("df")).alias("p"))
    found = {r.df: r.p for r in df.collect()}
    assert all(abs(found[d] - 0.05) < 2e-4 for _, d in rows[:6]) and found[4] == 1.0
    edge = spark.createDataFrame([(2.5, d) for d in (19_999, 20_000, 20_001, 20_002)], "t double, df bigint").select(numeric.t_two_sided(F.col("t"), F.col("df")).alias("p")).collect()
    assert max(r.p for r in edge) - min(r.p for r in edge) < 1e-7


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.03), ("e", None), ("f", 0.9)], "LLMScore string, p_value_ttest double")
    q = {r.LLMScore: r.q_value_bh for r in inference.benjamini_hochberg(df).collect()}
    assert q["e"] is None and q["a"] == pytest.approx(0.05) and q["c"] == q["d"] == pytest.approx(0.05) and q["b"] == pytest.approx(0.05) and q["f"] == pytest.approx(0.9)


def test_winsor_keeps_nulls(spark):
    df = spark.createDataFrame([("m", str(i), float(i)) for i in range(101)] + [("m", "x", None), ("n", "x", None)], "LLMScore string, TestCaseId string, Diff double")
    rows = {(r.LLMScore, r.TestCaseId): r.Diff_winsor for r in inference.winsorized(df).collect()}
    assert rows["m", "x"] is None and rows["n", "x"] is None and rows["m", "0"] == 2.5 and rows["m", "100"] == 97.5


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 30_000])
def test_exact_quantiles(spark, n):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(0, 3, n), 3 if n % 2 else 0)
    shares = [0.0, 0.001, 0.025, 0.25, 0.5, 0.975, 0.9995, 1.0]
    rows = spark.createDataFrame([("a", float(v)) for v in x] + [("a", None), ("none", None), ("c", 2.0)], "g string, v double").repartition(5)
    found = {r.g: r.q for r in numeric.exact_quantiles(rows, ["g"], "v", shares, "q").collect()}
    assert found.keys() == {"a", "c"} and found["c"] == [2.0] * 8
    assert found["a"] == pytest.approx(np.quantile(x, shares).tolist(), abs=1e-12)


def test_bootstrap(spark):
    rng = np.random.default_rng(2)
    rows = [("m", f"c{i:03d}", float(x)) for i, x in enumerate(rng.normal(1, 2, 60))] + [("none", "c", None)]
    cases = spark.createDataFrame(rows, "LLMScore string, TestCaseId string, Diff double")
    a = resample.metric_bootstrap(cases, resample.metric_replicates(cases, 2000)).collect()
    b = resample.metric_bootstrap(cases.repartition(7), resample.metric_replicates(cases.repartition(7), 2000)).collect()
    x = np.array([r[2] for r in rows[:60]])
    assert len(a) == 1 and a[0].SE == pytest.approx(b[0].SE) and a[0].SE == pytest.approx(x.std() / math.sqrt(60), rel=0.08)
    assert a[0].CI_lo_95 < x.mean() < a[0].CI_hi_95
    pooled = resample.describe(resample.pooled_replicates(cases, 500)).first()
    assert pooled["count"] == 500 and pooled["mean"] == pytest.approx(x.mean(), abs=0.1)


def test_paired_invariants(spark):
    p = paired.pairs(usual(spark)).cache()
    for r in paired.paired_cuped(p).collect():
        mean = p.where(F.col("LLMScore") == r.LLMScore).agg(F.avg("D")).first()[0]
        assert r.delta == pytest.approx(mean) and r.var_D_star == pytest.approx(r.var_D * (1 - r.rho**2))
    folds = paired.crossfit(p, 3).collect()
    local = p.withColumn("f", paired.fold(F.col("TestCaseId"), 3)).toPandas()
    for r in folds:
        rest = local[(local.LLMScore == r.LLMScore) & (local.f != r.fold)]
        assert r.theta == pytest.approx(np.cov(rest.D, rest.Z)[0, 1] / rest.Z.var())


def test_pairs_with_separators_stay_apart(spark):
    o = spark.createDataFrame([("Previous", "a", "b||c", 1), ("Next", "a||b", "c", 0)], "Period string, TestCaseId string, AssertionId string, IsTrue int")
    r = coverage.pair_coverage(o).first()
    assert (r.pairs_prev, r.pairs_next, r.pairs_intersection) == (1, 1, 0)
    counts = {x.TestCaseId: tuple(x)[2:] for x in assertions.pair_counts(o).collect()}
    assert counts == {"a": (1, 1, 0, 0), "a||b": (0, 0, 0, 1)}


def test_gradient():
    rng = np.random.default_rng(0)
    counts = {"y_prev": rng.integers(0, 5, 20), "n_prev": np.full(20, 5), "y_next": rng.integers(0, 5, 20), "n_next": np.full(20, 5)}
    for cases in (None, np.arange(20) // 4):
        d = bayes.Density(counts, cases)
        x = rng.normal(0, 0.5, d.size)
        _, g = d(x)
        e = np.eye(d.size) * 1e-5
        assert np.allclose(g, [(d(x + v)[0] - d(x - v)[0]) / 2e-5 for v in e], atol=1e-4)


def test_model_recovers_the_shift(spark):
    previous, following, truth = simulate.simulate(spark, simulate.Config(cases=20, runs_prev=20, runs_next=20))
    counts = assertions.pair_counts(previous.unionByName(following))
    draws = bayes.sample(spark, counts, draws=300, warmup=300).cache()
    r = bayes.scalar_summary(draws).first()
    assert r.ci_lo < simulate.population(truth).first().mean_delta < r.ci_hi and r.prob_positive > 0.99
    assert all(x.r_hat < 1.1 for x in bayes.diagnostics(draws).where("parameter in ('tau', 'overall_delta')").collect())
    assert bayes.pair_summary(draws, counts).count() == 100
    with pytest.raises(ValueError):
        bayes.pair_summary(draws, counts.limit(3))
    with pytest.raises(ValueError):
        bayes.scalar_summary(draws.drop("overall_delta"))
    assert bayes.sample(spark, counts.limit(0)).count() == 0


def test_simulation_does_not_depend_on_partitions(spark):
    t = simulate.truth(spark)
    assert sorted(simulate.runs(t, "Next").collect()) == sorted(simulate.runs(t.repartition(5), "Next").collect())
    ids = [int(r.RunId) for p in ("Previous", "Next") for r in simulate.runs(t, p).collect()]
    assert sorted(ids) == list(range(1, 2001))


def test_whole_pipelines(spark):
    o = usual(spark).withColumn("RunId", F.lit("r"))
    c = pipeline.Config(n_boot=50, draws=50, warmup=50)
    out = pipeline.run_scores(o.where("Period = 'Previous'").drop("Period"), o.where("Period = 'Next'").drop("Period"), c)
    assert all(df.count() > 0 for df in out.values())
    previous, following, _ = simulate.simulate(spark, simulate.Config(cases=5))
    out = pipeline.run_assertions(spark, previous.drop("Period"), following.drop("Period"), c)
    assert all(df.count() > 0 for df in out.values())
