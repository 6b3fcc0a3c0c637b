"""Paired estimators on per-case means (DOC-01 to DOC-04, DOC-08, DOC-09).

Input has one row per (metric, case) of both periods: D is the difference of raw
means and Z the previous mean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaspan.functions.numeric import corr, div, draw_index
from deltaspan.operators.cuped import KEYS


def pairs(obs: DataFrame) -> DataFrame:
    """TestCaseId, LLMScore, D, Z of cases that both periods have."""
    mean = lambda p: F.avg(F.when(F.col("Period") == p, F.col("Value")))
    wide = obs.dropna(subset=KEYS).groupBy(*KEYS).agg(mean("Previous").alias("Z"), mean("Next").alias("after_"))
    return wide.where("Z is not null and after_ is not null").select(*KEYS, (F.col("after_") - F.col("Z")).alias("D"), "Z")


def paired_theta(p: DataFrame) -> DataFrame:
    """Per metric: theta = cov(D, Z) / var(Z), 0 for a constant Z, and the mean of Z."""
    return p.groupBy("LLMScore").agg(F.coalesce(div(F.covar_samp("D", "Z"), F.var_samp("Z")), F.lit(0.0)).alias("theta"), F.avg("Z").alias("mean_Z"))


def paired_adjusted(p: DataFrame) -> DataFrame:
    """The pairs with D_star = D - theta (Z - mean Z), whose mean is that of D."""
    return p.join(paired_theta(p), "LLMScore").withColumn("D_star", F.col("D") - F.col("theta") * (F.col("Z") - F.col("mean_Z")))


def paired_cuped(p: DataFrame) -> DataFrame:
    """Per metric: delta, se, theta, var_D, var_D_star, variance_reduction, rho, ess_gain = 1 / (1 - rho^2), n."""
    a = paired_adjusted(p).groupBy("LLMScore").agg(
        F.avg("D_star").alias("delta"), F.sqrt(F.var_samp("D_star") / F.count("*")).alias("se"), F.first("theta").alias("theta"),
        F.var_samp("D").alias("var_D"), F.var_samp("D_star").alias("var_D_star"), corr(F.col("D"), F.col("Z")).alias("rho"), F.count("*").alias("n"),
    )
    return a.withColumn("variance_reduction", 1 - div(F.col("var_D_star"), F.col("var_D"))).withColumn("ess_gain", div(F.lit(1.0), 1 - F.col("rho") * F.col("rho")))


def fold(case, folds: int):
    return draw_index(F.lit(folds), "fold", case).cast("int")


def crossfit(p: DataFrame, folds: int = 5) -> DataFrame:
    """Per (metric, fold): theta of all other folds, from their sums, and the fold's cases and adjusted mean."""
    p = p.withColumn("fold", fold(F.col("TestCaseId"), folds)).withColumn("DZ", F.col("D") * F.col("Z")).withColumn("ZZ", F.col("Z") * F.col("Z"))
    own = p.groupBy("LLMScore", "fold").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("D", "Z", "DZ", "ZZ")])
    w = W.partitionBy("LLMScore")
    rest = {c: F.sum(c).over(w) - F.col(c) for c in ("n", "D", "Z", "DZ", "ZZ")}
    out = own.select("LLMScore", "fold", "n", "D", "Z", *[e.alias(f"r_{c}") for c, e in rest.items()])
    theta = div(F.col("r_DZ") - F.col("r_D") * F.col("r_Z") / F.nullif(F.col("r_n"), F.lit(0)), F.col("r_ZZ") - F.col("r_Z") * F.col("r_Z") / F.nullif(F.col("r_n"), F.lit(0)))
    out = out.withColumn("theta", F.coalesce(theta, F.lit(0.0)))
    return out.select("LLMScore", "fold", "n", "theta", (div(F.col("D"), F.col("n")) - F.col("theta") * (div(F.col("Z"), F.col("n")) - div(F.col("r_Z"), F.col("r_n")))).alias("delta_fold"))


def crossfit_delta(p: DataFrame, folds: int = 5) -> DataFrame:
    """Per metric: the case-weighted mean over folds."""
    return crossfit(p, folds).groupBy("LLMScore").agg(div(F.sum(F.col("n") * F.col("delta_fold")), F.sum("n")).alias("delta"), F.sum("n").alias("n"))


def cluster_se(obs: DataFrame) -> DataFrame:
    """Per metric: the difference of row means and its cluster-robust standard error, cases as clusters."""
    means = obs.dropna(subset=KEYS).groupBy("LLMScore", "Period").agg(F.avg("Value").alias("mean_"), F.count("Value").alias("n_"))
    rows = obs.dropna(subset=KEYS).join(means, ["LLMScore", "Period"])
    sign = F.when(F.col("Period") == "Next", 1.0).otherwise(-1.0)
    scores = rows.groupBy(*KEYS).agg(F.sum(sign * (F.col("Value") - F.col("mean_")) / F.col("n_")).alias("u"))
    se = scores.groupBy("LLMScore").agg(F.count("*").alias("clusters"), F.sum(F.col("u") * F.col("u")).alias("uu"))
    delta = means.groupBy("LLMScore").agg((F.sum(F.when(F.col("Period") == "Next", F.col("mean_"))) - F.sum(F.when(F.col("Period") == "Previous", F.col("mean_")))).alias("delta"))
    return delta.join(se, "LLMScore").select("LLMScore", "delta", F.sqrt(F.col("uu") * div(F.col("clusters"), F.col("clusters") - 1)).alias("cluster_se"), "clusters")


def improved_worse(p: DataFrame) -> DataFrame:
    """Per metric: shares of pairs that improved, got worse and stayed."""
    share = lambda c: F.avg(c.cast("double"))
    return p.groupBy("LLMScore").agg(share(F.col("D") > 0).alias("improved"), share(F.col("D") < 0).alias("worse"), share(F.col("D") == 0).alias("same"), F.count("*").alias("n"))


def standardized(obs: DataFrame) -> DataFrame:
    """The rows with Value scaled to 0..1 over their metric; null for a constant one."""
    span = obs.groupBy("LLMScore").agg(F.min("Value").alias("low_"), F.max("Value").alias("high_"))
    return obs.join(span, "LLMScore").withColumn("Value_01", div(F.col("Value") - F.col("low_"), F.col("high_") - F.col("low_"))).drop("low_", "high_")
