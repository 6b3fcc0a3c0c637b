"""Means of rates drawn pool by pool, without the density of the draws."""

import numpy as np
import pytest

from deltaspan.operators import assertions as a
from deltaspan.operators import bayes
from deltaspan.plans import registry
from deltaspan.sources import adapters

X = np.array([-0.7, -1.2, 0.1, -0.6])


def _counts(n: int, kinds: int = 90) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(4)
    few = {f"n_{p}": rng.integers(0, 30, kinds) for p in ("prev", "next")}
    few |= {f"y_{p}": rng.binomial(few[f"n_{p}"], 0.4) for p in ("prev", "next")}
    # Kinds of unequal numbers of pairs.
    at = np.concatenate([np.arange(kinds), rng.integers(0, kinds // 3, n - kinds)])
    return {k: v[at] for k, v in few.items()}


@pytest.mark.parametrize("block, pool, x", [(7, 4, X), (bayes.BLOCK, 32, np.array([0.5, 0.7, -0.3, 2.0]))])
def test_rates_are_from_the_distribution_of_means_of_draws(monkeypatch, block, pool, x):
    monkeypatch.setattr(bayes, "BLOCK", block)
    monkeypatch.setattr(bayes.Marginal, "POOL", pool)
    d, rng = bayes.Marginal(_counts(2500)), np.random.default_rng(1)
    whole = np.array([(f[3], f[6].mean(), f[7].mean(), (f[7] - f[6]).mean()) for f in (d.draw(x, rng)[1] for _ in range(1000))])
    rates = np.array([(f[3], f[6], f[7], f[7] - f[6]) for f in (d.rates(x, rng)[1] for _ in range(1000))])
    off = (whole.mean(0) - rates.mean(0)) / np.sqrt((whole.var(0) + rates.var(0)) / 1000)
    assert (np.abs(off) < 4).all()
    assert (np.abs(np.log(whole.std(0) / rates.std(0))) < 4 / np.sqrt(1000)).all()


def test_every_pair_has_a_place(monkeypatch):
    # Kinds that have nothing in common, and one whose periods disagree beyond what a single-precision product holds.
    ends = {"y_prev": [3000, 0, 3000, 5], "n_prev": [3000, 3000, 3000, 10], "y_next": [3000, 0, 0, 5], "n_next": [3000, 3000, 3000, 10]}
    d = bayes.Marginal({k: np.repeat(v, 300) for k, v in ends.items()})
    x = np.array([0.0, 0.5, 0.0, 0.0])
    for seed in range(3):
        mine, other = (way(x, np.random.default_rng(seed))[1] for way in (d.rates, d.means))
        assert mine[6] == pytest.approx(other[6], abs=0.01) and mine[7] == pytest.approx(other[7], abs=0.01)


def test_pools_place_few_pairs_one_by_one(monkeypatch):
    d, size = bayes.Marginal(_counts(200_000, 600)), []
    plain = bayes._chosen
    monkeypatch.setattr(bayes, "_chosen", lambda shares, rows, rng: (size.append(len(rows)), plain(shares, rows, rng))[1])
    d.rates(X, np.random.default_rng(1))
    assert sum(size) < 0.4 * d.n
    monkeypatch.setattr(bayes, "SMALL", 100)
    d.means = None  # not called
    found = list(bayes.walk(d, 5, 60, np.random.default_rng(1), vectors=False, density_too=False))
    assert len(found) == 5 and all(f[0] is None and f[5] is None and 0 < f[6] < 1 and 0 < f[7] < 1 for f in found)


def test_counts_that_hardly_repeat_and_cases_are_drawn_as_before():
    rng = np.random.default_rng(2)
    n = {f"n_{p}": rng.integers(1, 1000, 300) for p in ("prev", "next")}
    counts = n | {f"y_{p}": rng.binomial(n[f"n_{p}"], 0.4) for p in ("prev", "next")}
    for d in (bayes.Marginal(counts), bayes.Marginal(_counts(2500), np.arange(2500) // 5)):
        x = np.append(X, -1.0)[: d.size]
        (tau, mine), (same, other) = d.rates(x, np.random.default_rng(3)), d.means(x, np.random.default_rng(3))
        assert tau == same and mine[1:] == other[1:] and mine[0] is None


@pytest.mark.parametrize("case_effects", [False, True])
def test_guide_gives_the_quadratic_it_was_fitted_as(case_effects):
    d, rng = bayes.Marginal(_counts(300), np.arange(300) // 5 if case_effects else None), np.random.default_rng(5)
    around = np.append(X, -1.0)[: d.size]
    met = [(x, d.value(x)) for x in around + 0.1 * rng.normal(size=(80, d.size))]
    guide = bayes.Guide(d, met)
    for x, _ in met[:10]:
        f = (guide._terms(x) - guide.mean) / guide.sd
        assert guide.value(x) == pytest.approx(guide.level + f @ (guide.line + guide.bend @ f) + d.prior(x), rel=1e-9)
    assert guide.value(guide.high + 1) == -np.inf and guide.path(guide.high + 1, np.zeros((3, d.size)), np.zeros(3))[1] == 0
    to, gain = guide.path(around, 0.05 * rng.normal(size=(40, d.size)), rng.random(40))
    assert gain == pytest.approx(guide.value(to) - guide.value(around), abs=1e-9) and not np.array_equal(to, around)


def test_counts_by_numbers_are_those_by_text(spark, tmp_path):
    spark.sql("""select id % 7 as l_orderkey, if(id % 11 = 0, null, id % 13) as l_suppkey, if(id % 17 = 0, null, cast(id % 3 as int)) as l_linenumber,
        if(id % 2 = 0, 'R', 'N') as l_returnflag, timestamp_ntz'1998-06-01 00:00:00' + make_interval(0, 0, 0, cast(id % 60 as int)) as l_shipdate from range(900)""").write.parquet(f"{tmp_path}/lineitem.parquet")
    mine, text = registry._counts(spark, str(tmp_path)), a.pair_counts(adapters.lineitem(spark, str(tmp_path)))
    assert mine.columns == text.columns and mine.dtypes == text.dtypes
    assert sorted(mine.collect()) == sorted(text.collect()) and mine.count() == 39
    assert "lp" not in registry._model(spark, str(tmp_path), draws=5, warmup=5, chains=1).columns


def _both(spark, summary):
    """The summary of a model beyond SMALL with the draws' density and without it."""
    counts = spark.range(60_000).selectExpr("cast(id as string) as TestCaseId", "'a' as AssertionId", "id * 7 % 6 as y_prev", "5L as n_prev", "(id * 11 + 1) % 5 + 1 as y_next", "5L as n_next")
    assert counts.count() > bayes.SMALL
    return [summary(bayes.sample(spark, counts, 2, 200, 200, vectors=False, density_too=too)).first() for too in (True, False)]


def _same(one, other):
    spread = one["ci_hi"] - one["ci_lo"]
    assert all(other[k] == pytest.approx(one[k], abs=0.4 * spread) for k in ("mean", "ci_lo", "ci_hi")) and spread > 0
    assert other["prob_positive"] == one["prob_positive"] == 1.0


def test_posterior_summary_of_a_large_model_without_density(spark):
    _same(*_both(spark, bayes.scalar_summary))


def test_rate_difference_of_a_large_model_without_density(spark):
    _same(*_both(spark, lambda draws: bayes.rate_difference(bayes.mean_rates(draws))))
