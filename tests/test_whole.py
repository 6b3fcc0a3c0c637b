"""Registered queries do the operators' whole job."""

import math

import numpy as np
import pytest
from compare import DATA
from pyspark.sql import functions as F

from deltaspan.operators import assertions, bayes, resample
from deltaspan.plans import registry
from deltaspan.sources import adapters

tables = pytest.mark.skipif(not DATA.exists(), reason="no tables")


@tables
def test_bootstraps_draw_all_replicates(spark):
    found = registry.QUERIES["bootstrap_replicates"](spark, str(DATA)).groupBy("LLMScore").agg(F.count("*").alias("n"), F.count_distinct("rep").alias("reps")).collect()
    assert len(found) == 5 and all(r.n == r.reps == 10_000 for r in found)
    assert registry.QUERIES["bootstrap_pooled"](spark, str(DATA)).first()["count"] == 10_000


def test_ways_of_joining_draws_agree(spark, monkeypatch):
    cases = spark.createDataFrame([(m, f"c{i:02d}", float(i * i % 17)) for m in "ab" for i in range(30)], "LLMScore string, TestCaseId string, Diff double")

    def found():
        one = resample.metric_replicates(cases, 250).collect() + resample.pooled_replicates(cases, 250).select(F.lit("").alias("LLMScore"), "rep", "boot_mean").collect()
        return {(r.LLMScore, r.rep): r.boot_mean for r in one}

    held = found()
    monkeypatch.setattr(resample, "HELD", 10)
    shuffled = found()
    assert len(held) == 750 and held.keys() == shuffled.keys()
    assert all(held[k] == pytest.approx(shuffled[k], abs=1e-12) for k in held)


@tables
def test_model_reads_the_assertions(spark):
    counts = assertions.pair_counts(adapters.lineitem(spark, str(DATA)))
    draws = bayes.sample(spark, counts).cache()
    assert draws.count() == 4_000 and draws.select(F.size("delta")).distinct().collect() == [(counts.count(),)]
    for name, own in (("model_summary", draws), ("model_case_effects", bayes.sample(spark, counts, case_effects=True))):
        assert registry.QUERIES[name](spark, str(DATA)).collect() == registry.tidy(bayes.scalar_summary(own)).collect()
    found = {r.parameter: r for r in registry.QUERIES["model_diagnostics"](spark, str(DATA)).collect()}
    assert len(found) == 5 and all(r.r_hat < 1.05 and r.ess > 400 for r in found.values())
    # Enough runs for pairs to say more than the prior: the overall change is near that of the raw rates.
    raw = counts.where("n_prev > 0 and n_next > 0").agg(F.avg(F.col("y_next") / F.col("n_next") - F.col("y_prev") / F.col("n_prev"))).first()[0]
    r = registry.QUERIES["model_summary"](spark, str(DATA)).first()
    assert r.ci_lo < raw < r.ci_hi


@tables
def test_summaries_are_of_the_models_draws(spark):
    get = lambda name: registry.QUERIES[name](spark, str(DATA))
    counts = assertions.pair_counts(adapters.lineitem(spark, str(DATA)))
    draws = bayes.sample(spark, counts).cache()
    rates = draws.select("chain", "draw", "p_prev", "p_next").toPandas()
    means = {(r.chain, r.draw): (sum(r.p_prev) / len(r.p_prev), sum(r.p_next) / len(r.p_next)) for r in rates.itertuples()}
    found = get("mean_rates").collect()
    assert len(found) == 4_000 and all((r.mean_prev, r.mean_next) == pytest.approx(means[r.chain, r.draw], abs=2e-6) for r in found)
    assert get("melt_rates").count() == 8_000
    change = [b - x for x, b in means.values()]
    for name in ("rate_difference", "posterior_summary"):
        assert get(name).first()["mean"] == pytest.approx(sum(change) / 4_000, abs=2e-6)
    tau = [r.tau for r in draws.select("tau").collect()]
    lift = [1 / (1 + 7 / 3 * math.exp(-x)) - 0.3 for x in tau]
    assert get("posterior_lift").first()["mean"] == pytest.approx(sum(lift) / 4_000, abs=2e-6)
    low = {r.Period: (r.low, r.high) for r in get("violins").collect()}
    assert low["Next"] == pytest.approx((min(b for _, b in means.values()), max(b for _, b in means.values())), abs=2e-6)
    top = get("top_pairs").collect()
    each = {tuple(r): 0.0 for r in counts.select("TestCaseId", "AssertionId").collect()}
    by_id = sorted(each)
    total = [sum(x) / 4_000 for x in zip(*[r.delta for r in draws.select("delta").collect()])]
    want = sorted(zip(by_id, total), key=lambda p: (-abs(p[1]), p[0]))[:30]
    assert [(r.TestCaseId, r.AssertionId) for r in top] == [p for p, _ in want]
    assert all(r.delta_mean == pytest.approx(x, abs=2e-6) for r, (_, x) in zip(top, want))


def test_gradient_without_the_covariate():
    rng = np.random.default_rng(0)
    counts = {"y_prev": rng.integers(0, 5, 20), "n_prev": np.full(20, 5), "y_next": rng.integers(0, 5, 20), "n_next": np.full(20, 5)}
    d = bayes.Density(counts, covariate=False)
    x = rng.normal(0, 0.5, d.size)
    _, g = d(x)
    assert np.allclose(g, [(d(x + v)[0] - d(x - v)[0]) / 2e-5 for v in np.eye(d.size) * 1e-5], atol=1e-4)
    assert np.allclose(d.parts(x)[4], d.parts(x)[2] + x[2])


def test_gain_of_the_covariate(spark):
    # Next rates fall where previous ones are high, which tau alone can't say.
    rows = [(f"c{i:02d}", "a", 2 + 16 * (i % 2), 20, 14 - 8 * (i % 2), 20) for i in range(40)]
    counts = spark.createDataFrame(rows, "TestCaseId string, AssertionId string, y_prev bigint, n_prev bigint, y_next bigint, n_next bigint")
    one, two = bayes.sample(spark, counts).cache(), bayes.sample(spark, counts, covariate=False).cache()
    assert {r.theta for r in two.select("theta").collect()} == {0.0}
    assert one.agg(F.avg("theta")).first()[0] < -1
    a, b = (np.var([r[0] for r in x.select("overall_delta").collect()], ddof=1) for x in (one, two))
    r = bayes.ess_gain(one, two).first()
    assert (r.var_with, r.var_without, r.ess_gain) == pytest.approx((a, b, b / a))


def test_run_effects():
    rng = np.random.default_rng(4)
    counts = {"y_prev": rng.integers(0, 3, 60), "n_prev": np.full(60, 3), "y_next": rng.integers(0, 3, 60), "n_next": np.full(60, 3)}
    runs = (np.repeat(np.arange(12), 5), np.tile(np.arange(5), 12))
    for cases in (None, np.arange(12) // 3):
        d = bayes.Density(counts, cases, runs=runs)
        assert d.size == 4 + 12 + 6 + (0 if cases is None else 5)
        x = rng.normal(0, 0.5, d.size)
        _, g = d(x)
        assert np.allclose(g, [(d(x + v)[0] - d(x - v)[0]) / 2e-5 for v in np.eye(d.size) * 1e-5], atol=1e-4)


def test_run_effects_absorb_a_lenient_judge(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [("Previous" if t % 2 else "Next", f"c{c:02d}", "a", f"r{r}", int(rng.random() < (0.9 if r == 0 else 0.4))) for c in range(20) for r in range(4) for t in range(6)]
    obs = spark.createDataFrame(rows, "Period string, TestCaseId string, AssertionId string, RunId string, IsTrue int")
    counts = assertions.run_counts(obs)
    assert counts.count() == 80 and counts.agg(F.sum("n_prev")).first()[0] == 240
    draws = bayes.sample(spark, counts, draws=200, warmup=300, run_effects=True)
    assert draws.select(F.size("delta")).distinct().collect() == [(20,)]
    r = bayes.scalar_summary(draws).first()
    assert r.ci_lo < 0 < r.ci_hi
    monkeypatch.setattr(bayes, "MAX_ROWS", 10)
    with pytest.raises(ValueError):
        bayes.sample(spark, counts)


def test_diagnostics_against_known_chains():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(4, 2000))
    assert bayes.split_r_hat(x) == pytest.approx(1, abs=0.01) and bayes.effective_size(x) == pytest.approx(8000, rel=0.15)
    for a, name in ((0.8, "slow"), (-0.5, "alternating")):
        y = x.copy()
        for t in range(1, 2000):
            y[:, t] = a * y[:, t - 1] + x[:, t]
        assert bayes.effective_size(y) == pytest.approx(8000 * (1 - a) / (1 + a), rel=0.25), name
    drift = x + np.linspace(0, 3, 2000)
    assert bayes.split_r_hat(drift) > 1.2 and bayes.split_r_hat(x + np.arange(4)[:, None]) > 1.2
    assert bayes.split_r_hat(np.ones((2, 10))) is None and bayes.effective_size(np.ones((2, 3))) is None


def test_exports(spark, tmp_path):
    from deltaspan.sources import sinks

    one = spark.createDataFrame([("m", 1.0)], "LLMScore string, theta double")
    arrays = spark.createDataFrame([(1, [0.5, 1.0])], "draw int, delta array<double>")
    paths = sinks.export({"theta_table": one, "draws": arrays}, str(tmp_path))
    assert spark.read.option("header", True).csv(paths["draws"]).first().delta == "[0.5,1.0]"
    assert list(sinks.export({"theta_table": one, "draws": arrays}, str(tmp_path), ("theta_table",))) == ["theta_table"]
    with pytest.raises(KeyError):
        sinks.export({"theta_table": one}, str(tmp_path), ("draws",))
