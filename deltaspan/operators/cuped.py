"""Variance-reduced comparison of two periods (JOIN-01 to JOIN-05, AGG-05 to AGG-11, STAT-01 to STAT-09).

The covariate X of a row is its case's mean in the previous period. One
aggregation gives each case's moments there; theta and the means come from
those, not from the rows, and X joins the rows by (case, metric). Tables of one
row per metric are small; adaptive execution broadcasts them by measured size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaspan.functions.numeric import div, near_zero
from deltaspan.operators.coverage import previous

KEYS = ["TestCaseId", "LLMScore"]
LOW_CORR = 0.05


def baseline(obs: DataFrame) -> DataFrame:
    """X_baseline per (case, metric)."""
    return obs.where(previous()).dropna(subset=KEYS).groupBy(*KEYS).agg(F.avg("Value").alias("X_baseline"))


def baseline_stats(obs: DataFrame) -> DataFrame:
    """Per metric: mean, std (n - 1) and number of case baselines."""
    return baseline(obs).groupBy("LLMScore").agg(F.avg("X_baseline").alias("mean"), F.stddev_samp("X_baseline").alias("std"), F.count("X_baseline").alias("n_cases"))


def moments(obs: DataFrame) -> DataFrame:
    """Per (case, metric) of the previous period: rows, n (values), X_baseline and spread (population variance)."""
    before = obs.where(previous()).dropna(subset=KEYS)
    return before.groupBy(*KEYS).agg(F.count("*").alias("rows"), F.count("Value").alias("n"), F.avg("Value").alias("X_baseline"), F.var_pop("Value").alias("spread"))


def _theta(cases: DataFrame) -> DataFrame:
    """theta of `moments`. A case's rows share X, their mean, so sums over rows are sums over cases weighted by n."""
    x = F.col("X_baseline")
    centre = cases.groupBy("LLMScore").agg(div(F.sum(x * F.col("n")), F.sum("n")).alias("centre"), F.avg(x).alias("mean_X_baseline"), F.sum("rows").alias("N_rows_prev"))
    off = F.col("n") * F.pow(x - F.col("centre"), 2)
    t = cases.join(centre, "LLMScore").groupBy("LLMScore", "mean_X_baseline", "N_rows_prev").agg(
        F.sum("n").alias("n"), F.sum(off).alias("between"), F.sum(F.col("n") * F.col("spread")).alias("within"),
    )
    var_x, var_y = div(F.col("between"), F.col("n")), div(F.col("between") + F.col("within"), F.col("n"))
    # The covariance of X and Value is the variance of X.
    return t.withColumn("var_X", var_x).withColumn("cov", F.col("var_X")).withColumn("corr_XY", div(F.col("cov"), F.sqrt(F.col("var_X") * var_y)))


def theta(obs: DataFrame) -> DataFrame:
    """Per metric of the previous period: theta, corr_XY, var_X, N_rows_prev, OLS_slope, variance_or_corr_flag."""
    t = _theta(moments(obs))
    flat = near_zero(F.col("var_X"))
    slope = div(F.col("cov"), F.col("var_X"))
    return t.select(
        "LLMScore",
        F.when(flat, 0.0).otherwise(slope).alias("theta"),
        F.when(F.col("N_rows_prev") > 1, F.col("corr_XY")).alias("corr_XY"),
        "var_X",
        "N_rows_prev",
        F.when(~flat, slope).alias("OLS_slope"),
        (flat | F.coalesce((F.col("N_rows_prev") > 1) & (F.abs("corr_XY") < LOW_CORR), F.lit(False))).alias("variance_or_corr_flag"),
    )


def adjusted(obs: DataFrame, impute_missing_baseline: bool = False) -> DataFrame:
    """The rows with X_baseline, mean_X_baseline, theta and Value_CUPED = Value - theta (X - mean X).

    Cases that only the next period has keep a null adjusted value, unless
    `impute_missing_baseline` puts their metric's mean for X. theta is 0 for
    metrics that the previous period lacks.
    """
    cases = moments(obs)
    table = _theta(cases).select("LLMScore", F.when(near_zero(F.col("var_X")), 0.0).otherwise(div(F.col("cov"), F.col("var_X"))).alias("theta"), "mean_X_baseline")
    rows = obs.join(cases.select(*KEYS, "X_baseline"), KEYS, "left").join(table, "LLMScore", "left")
    mean = F.col("mean_X_baseline") if impute_missing_baseline else F.when(F.col("X_baseline").isNotNull(), F.col("mean_X_baseline"))
    rows = rows.withColumn("mean_X_baseline", mean).withColumn("X_baseline", F.coalesce("X_baseline", "mean_X_baseline")).withColumn("theta", F.coalesce("theta", F.lit(0.0)))
    return rows.withColumn("Value_CUPED", F.col("Value") - F.col("theta") * (F.col("X_baseline") - F.col("mean_X_baseline")))


def variance_reduction(rows: DataFrame) -> DataFrame:
    """Per metric, over adjusted rows of both periods: var_raw, var_cuped, variance_reduction_pct."""
    v = rows.where("LLMScore is not null").groupBy("LLMScore").agg(F.var_pop("Value").alias("var_raw"), F.var_pop("Value_CUPED").alias("var_cuped"))
    return v.withColumn("variance_reduction_pct", F.when(F.col("var_raw") > 0, 100 * (1 - div(F.col("var_cuped"), F.col("var_raw")))))


def per_case(rows: DataFrame) -> DataFrame:
    """TestCaseId, LLMScore, Next_CUPED_Mean, Prev_CUPED_Mean, Diff of adjusted rows."""
    mean = lambda period: F.avg(F.when(F.col("Period") == period, F.col("Value_CUPED")))
    wide = rows.dropna(subset=KEYS).groupBy(*KEYS).agg(mean("Next").alias("Next_CUPED_Mean"), mean("Previous").alias("Prev_CUPED_Mean"))
    return wide.withColumn("Diff", F.col("Next_CUPED_Mean") - F.col("Prev_CUPED_Mean"))


def improved(diff) -> F.Column:
    return F.avg(F.when(diff.isNotNull(), (diff > 0).cast("double")))


def summary(cases: DataFrame) -> DataFrame:
    """Per metric: mean_diff, cohens_d, percent_change (a fraction), share_improved, n_cases."""
    d = F.col("Diff")
    sd = F.stddev_samp(d)
    before = F.avg("Prev_CUPED_Mean")
    return cases.groupBy("LLMScore").agg(
        F.avg(d).alias("mean_diff"), F.when(sd > 0, div(F.avg(d), sd)).alias("cohens_d"),
        (div(F.avg("Next_CUPED_Mean"), before) - 1).alias("percent_change"),
        improved(d).alias("share_improved"), F.count(d).alias("n_cases"),
    )
