"""Densities and assertion summaries: against SQL on 40 places, and whole against plain Python."""

import math

import pytest
from compare import DATA, same
from pyspark.sql import functions as F

from deltaspan.operators import assertions as a
from deltaspan.operators import cuped, plotdata
from deltaspan.plans import registry
from deltaspan.plans.registry import SUMMARY, _boot_sql, _reps, base_sql, sql, tidy
from deltaspan.sources import adapters

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")


def _kde_sql(from_: str, value: str, group: str) -> str:
    return f"""s_ as (select {group}, stddev_samp({value}) * pow(count(*), -0.2) as h, min({value}) as lo, max({value}) as hi, count(*) as n from {from_} where {value} is not null group by all),
g_ as (select *, i, lo - 3 * h + (hi - lo + 6 * h) * i / 39 as x from s_, range(40) r(i) where h > 0),
kde as (select {", ".join("g_." + g.strip() for g in group.split(","))}, g_.i as i, x, sum(exp(-pow((x - v.{value}) / h, 2) / 2)) / (any_value(h) * any_value(n) * sqrt(2 * pi())) as density
  from g_ join {from_} v using ({group}) where v.{value} is not null group by all)"""


CASES = {
    "assertion_cuped": (lambda s, d: cuped.summary(cuped.per_case(cuped.adjusted(a.as_scores(adapters.lineitem(s, d))))).drop("share_improved"), sql(base_sql("lineitem").replace("obs as (", "raw_ as (", 1).replace("),\nb as", "), obs as (select RunId, TestCaseId, AssertionId as LLMScore, IsTrue::double as Value, Period from raw_),\nb as", 1), SUMMARY, "mean_diff cohens_d percent_change", "LLMScore", "n_cases")),
    "kde_cuped": (lambda s, d: plotdata.kde(cuped.adjusted(adapters.events(s, d)), "Value_CUPED", ["LLMScore", "Period"], 40), sql(f"{base_sql('events')}, {_kde_sql('rows_', 'Value_CUPED', 'LLMScore, Period')}", "from kde", "x density", "LLMScore Period", "i")),
    "kde_bootstrap": (lambda s, d: plotdata.kde(_reps(s, d), "boot_mean", ["LLMScore"], 40), sql(f"{_boot_sql('events')}, {_kde_sql('reps', 'boot_mean', 'LLMScore')}", "from kde", "x density", "LLMScore", "i")),
}


@pytest.mark.parametrize("name", CASES)
def test_matches_sql(spark, name):
    build, twin = CASES[name]
    same(tidy(build(spark, str(DATA))), twin)


@pytest.mark.parametrize("name, value, keys", [("kde_cuped", "Value_CUPED", ["LLMScore", "Period"]), ("kde_bootstrap", "boot_mean", ["LLMScore"])])
def test_whole_grid(spark, name, value, keys):
    rows = (cuped.adjusted(adapters.events(spark, str(DATA))) if name == "kde_cuped" else _reps(spark, str(DATA))).where(F.col(value).isNotNull()).toPandas()
    found = registry.QUERIES[name](spark, str(DATA)).toPandas()
    assert len(found) == 200 * len(rows.groupby(keys))
    for key, part in rows.groupby(keys):
        x = part[value].to_numpy(float)
        h = x.std(ddof=1) * len(x) ** -0.2
        mine = found.set_index(keys).loc[key if len(keys) > 1 else key[0]].sort_values("i")
        assert list(mine.i) == list(range(200))
        for i in (0, 57, 130, 199):
            at = x.min() - 3 * h + (x.max() - x.min() + 6 * h) * i / 199
            want = sum(math.exp(-(((at - v) / h) ** 2) / 2) for v in x) / (h * len(x) * math.sqrt(2 * math.pi))
            assert mine.x.iloc[i] == pytest.approx(at, abs=2e-6) and mine.density.iloc[i] == pytest.approx(want, abs=2e-6)


def test_share_of_improved_assertions(spark):
    diffs = {}
    for r in cuped.per_case(cuped.adjusted(a.as_scores(adapters.lineitem(spark, str(DATA))))).collect():
        if r.Diff is not None:
            diffs.setdefault(r.LLMScore, []).append(r.Diff)
    found = {r.LLMScore: r.share_improved for r in registry.QUERIES["assertion_cuped"](spark, str(DATA)).collect() if r.n_cases}
    assert found == pytest.approx({m: sum(x > 1e-9 for x in d) / len(d) for m, d in diffs.items()}, abs=2e-6)
