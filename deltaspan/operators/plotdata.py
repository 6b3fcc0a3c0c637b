"""Tables behind the plots (PLT-01 to PLT-07): densities on a grid, bars, violins, forests."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaspan.operators.bayes import top_pairs

GRID, CUT = 200, 3.0


def kde(rows: DataFrame, value: str, groups: list[str], points: int = GRID, cut: float = CUT) -> DataFrame:
    """groups, x, density: Gaussian kernel density with Scott's bandwidth sd n^(-1/5), on `points` places.

    The grid reaches `cut` bandwidths beyond the data. Each value contributes to
    each place; contributions are summed ahead in every task. Groups without
    spread have no density.
    """
    v = rows.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("v_"))
    span = v.groupBy(*groups).agg(
        (F.stddev_samp("v_") * F.pow(F.count("*").cast("double"), F.lit(-0.2))).alias("h_"),
        F.min("v_").alias("low_"), F.max("v_").alias("high_"), F.count("*").alias("n_"),
    ).where("h_ > 0")
    low, high = F.col("low_") - cut * F.col("h_"), F.col("high_") + cut * F.col("h_")
    joined = v.join(span, groups) if groups else v.join(F.broadcast(span))
    at = joined.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", low + (high - low) * F.col("i") / (points - 1))
    kernel = F.exp(-F.pow((F.col("x") - F.col("v_")) / F.col("h_"), 2) / 2) / (F.col("h_") * F.col("n_") * math.sqrt(2 * math.pi))
    return at.groupBy(*groups, "i").agg(F.first("x").alias("x"), F.sum(kernel).alias("density"))


def bars(bootstrap: DataFrame) -> DataFrame:
    """Mean differences with lengths of their error bars."""
    return bootstrap.select("LLMScore", "mean_diff", (F.col("mean_diff") - F.col("CI_lo_95")).alias("err_lo"), (F.col("CI_hi_95") - F.col("mean_diff")).alias("err_hi"))


def marks(bootstrap: DataFrame) -> DataFrame:
    """Vertical lines of a bootstrap density: zero, mean and interval."""
    return bootstrap.select("LLMScore", F.lit(0.0).alias("zero"), "mean_diff", "CI_lo_95", "CI_hi_95")


def violins(melted: DataFrame) -> DataFrame:
    """Quartiles of mean pass rates by period."""
    q = F.percentile("mean_pass_rate", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return melted.groupBy("Period").agg(q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"), F.min("mean_pass_rate").alias("low"), F.max("mean_pass_rate").alias("high"))


def violin_density(melted: DataFrame) -> DataFrame:
    """Densities of the violins, cut at the data."""
    return kde(melted, "mean_pass_rate", ["Period"], cut=0.0)


def forest(summary: DataFrame, k: int = 30) -> DataFrame:
    return top_pairs(summary, k)
