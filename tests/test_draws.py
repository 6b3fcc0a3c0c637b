"""Summaries of draws against SQL, on a table of keyed numbers."""

import pytest
from compare import same
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaspan.functions.numeric import uniform
from deltaspan.operators import bayes, plotdata, simulate
from deltaspan.plans.registry import UNIFORM, sql, tidy


def fixed_draws(spark: SparkSession, draws: int = 40, pairs: int = 35) -> DataFrame:
    """A table of draws from keyed numbers, so that summaries have a twin in SQL."""
    each = spark.range(draws).select((F.col("id") % 4).cast("int").alias("chain"), F.floor(F.col("id") / 4).cast("int").alias("draw"), "id")
    vector = lambda name: F.transform(F.sequence(F.lit(1), F.lit(pairs)), lambda p: uniform(name, F.col("id"), p))
    each = each.withColumn("p_prev", vector("prev")).withColumn("p_next", vector("next")).withColumn("delta", F.zip_with("p_next", "p_prev", lambda x, y: x - y))
    return each.withColumn("overall_delta", F.aggregate("delta", F.lit(0.0), lambda s, x: s + x) / pairs).withColumn("tau", uniform("tau", F.col("id")) - 0.3).drop("id")


DRAWS_SQL = f"""draws as (select id % 4 as chain, id // 4 as draw, pair, {UNIFORM.format("'prev|' || id || '|' || pair")} as p, {UNIFORM.format("'next|' || id || '|' || pair")} as q,
  {UNIFORM.format("'tau|' || id")} - 0.3 as tau from range(40) i(id), range(1, 36) r(pair)),
rates as (select chain, draw, avg(p) as mean_prev, avg(q) as mean_next, avg(q - p) as overall_delta, first(tau) as tau from draws group by all)"""
INTERVAL = "avg({0}) as mean, quantile_cont({0}, 0.025) as ci_lo, quantile_cont({0}, 0.975) as ci_hi, avg(({0} > 0)::int) as prob_positive"

CASES = {
    "mean_rates": (lambda s: bayes.mean_rates(fixed_draws(s)), sql(DRAWS_SQL, "from rates", "mean_prev mean_next", "", "chain draw")),
    "melt_rates": (lambda s: bayes.melted(bayes.mean_rates(fixed_draws(s))), sql(DRAWS_SQL, "select chain, draw, 'Previous' as Period, mean_prev as mean_pass_rate from rates union all select chain, draw, 'Next', mean_next from rates", "mean_pass_rate", "Period", "chain draw")),
    "rate_difference": (lambda s: bayes.rate_difference(bayes.mean_rates(fixed_draws(s))), sql(DRAWS_SQL, f"select {INTERVAL.format('(mean_next - mean_prev)')} from rates", "mean ci_lo ci_hi prob_positive")),
    "posterior_summary": (lambda s: bayes.scalar_summary(fixed_draws(s)), sql(DRAWS_SQL, f"select {INTERVAL.format('overall_delta')} from rates", "mean ci_lo ci_hi prob_positive")),
    "posterior_lift": (lambda s: bayes.predictive(fixed_draws(s), 0.3), sql(DRAWS_SQL, f"select {INTERVAL.format('(1 / (1 + exp(-(ln(0.3 / 0.7) + tau))) - 0.3)')} from rates", "mean ci_lo ci_hi prob_positive")),
    "violins": (lambda s: plotdata.violins(bayes.melted(bayes.mean_rates(fixed_draws(s)))), sql(f"{DRAWS_SQL}, m_ as (select 'Previous' as Period, mean_prev as v from rates union all select 'Next', mean_next from rates)", "select Period, quantile_cont(v, 0.25) as q25, quantile_cont(v, 0.5) as q50, quantile_cont(v, 0.75) as q75, min(v) as low, max(v) as high from m_ group by all", "q25 q50 q75 low high", "Period")),
    "top_pairs": (lambda s: plotdata.forest(bayes.pair_summary(fixed_draws(s), simulate.truth(s, simulate.Config(cases=7)).selectExpr("TestCaseId", "AssertionId", "0L as y_prev", "0L as n_prev", "0L as y_next", "0L as n_next")), 10), sql(f"{DRAWS_SQL}, s_ as (select format('TC{{:03d}}', (pair - 1) // 5 + 1) as TestCaseId, format('AS{{:03d}}', (pair - 1) % 5 + 1) as AssertionId, avg(q - p) as delta_mean, quantile_cont(q - p, 0.025) as delta_ci_lo, quantile_cont(q - p, 0.975) as delta_ci_hi, avg((q > p)::int) as prob_improved from draws group by all)", "select *, TestCaseId || '::' || AssertionId as label from s_ order by abs(delta_mean) desc, TestCaseId, AssertionId limit 10", "delta_mean delta_ci_lo delta_ci_hi prob_improved", "TestCaseId AssertionId label")),
}


@pytest.mark.parametrize("name", CASES)
def test_matches_sql(spark, name):
    build, twin = CASES[name]
    same(tidy(build(spark)), twin)
