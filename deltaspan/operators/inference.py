"""Tests and sensitivity of per-case differences (AGG-14 to AGG-16, STAT-10 to STAT-12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaspan.functions.numeric import clip, div, exact_quantiles, t_two_sided
from deltaspan.operators.coverage import case_intersection


def paired_t(cases: DataFrame) -> DataFrame:
    """LLMScore, t_stat, df, p_value_ttest of the mean difference; null below two cases or without spread."""
    d = F.col("Diff")
    m = cases.groupBy("LLMScore").agg(F.count(d).alias("n"), F.avg(d).alias("mean_"), F.stddev_samp(d).alias("sd"))
    t = F.when((F.col("n") >= 2) & (F.col("sd") > 0), div(F.col("mean_"), F.col("sd") / F.sqrt("n")))
    m = m.select("LLMScore", t.alias("t_stat"), F.when(t.isNotNull(), F.col("n") - 1).alias("df"))
    return m.withColumn("p_value_ttest", t_two_sided(F.col("t_stat"), F.col("df")))


def benjamini_hochberg(tests: DataFrame, p: str = "p_value_ttest", name: str = "q_value_bh") -> DataFrame:
    """The rows with q values over all non-null p; one row per metric, so one task holds them."""
    valid = W.partitionBy(F.col(p).isNull())
    rank = F.rank().over(valid.orderBy(p)) + F.count("*").over(valid.orderBy(p).rangeBetween(0, 0)) - 1
    ranked = tests.withColumn("rank_", rank).withColumn("m_", F.count(p).over(valid))
    least = F.min(F.col(p) * F.col("m_") / F.col("rank_")).over(valid.orderBy(F.desc(p)).rangeBetween(W.unboundedPreceding, W.currentRow))
    return ranked.withColumn(name, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), least))).drop("rank_", "m_")


def winsorized(cases: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """The cases with Diff_winsor: Diff cut at its metric's quantiles; null stays null.

    Quantiles are exact; the small table of them joins by metric.
    """
    return _cut(cases, exact_quantiles(cases, ["LLMScore"], "Diff", [low, high], "b_")).drop("b_")


def _cut(cases: DataFrame, bounds: DataFrame) -> DataFrame:
    return cases.join(bounds, "LLMScore", "left").withColumn("Diff_winsor", clip(F.col("Diff"), F.col("b_")[0], F.col("b_")[1]))


def sensitivity(cases: DataFrame, obs: DataFrame) -> DataFrame:
    """Per metric: the mean difference over all cases, cases of both periods, winsorized cases, and the median."""
    both = case_intersection(obs).select("TestCaseId", F.lit(True).alias("both_"))
    rows = _cut(cases, exact_quantiles(cases, ["LLMScore"], "Diff", [0.025, 0.975, 0.5], "b_")).join(both, "TestCaseId", "left")
    d, shared = F.col("Diff"), F.when(F.col("both_"), F.col("Diff"))
    return rows.groupBy("LLMScore").agg(
        F.avg(d).alias("mean_diff"), F.count(d).alias("n_cases"), F.avg(shared).alias("mean_diff_intersection"),
        F.when(F.count("both_") > 0, F.count(shared)).alias("n_cases_intersection"),
        F.avg("Diff_winsor").alias("mean_diff_winsor"), F.max(F.col("b_")[2]).alias("median_diff"),
    )
