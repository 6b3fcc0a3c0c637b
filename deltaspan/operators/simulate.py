"""Synthetic pass/fail observations with known truth (SIM-01 to SIM-06, AGG-23, JOIN-11).

All random numbers are keyed by (seed, pair, stream, run), so the rows don't
depend on partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaspan.functions.numeric import logistic, normal, uniform


@dataclass(frozen=True)
class Config:
    cases: int = 40
    assertions: int = 5
    runs_prev: int = 5
    runs_next: int = 5
    mean: float = 0.0
    sd: float = 1.0
    shift: float = 0.5
    shift_sd: float = 0.2
    heterogeneous: bool = True
    seed: int = 123


def truth(spark: SparkSession, c: Config = Config()) -> DataFrame:
    """TestCaseId, AssertionId, eta_prev, p_prev, tau_j, eta_next, p_next, true_delta, and pair (from 0)."""
    pairs = spark.range(c.cases * c.assertions).withColumnRenamed("id", "pair")
    case, assertion = F.floor(F.col("pair") / c.assertions) + 1, F.col("pair") % c.assertions + 1
    t = pairs.select("pair", F.format_string("TC%03d", case).alias("TestCaseId"), F.format_string("AS%03d", assertion).alias("AssertionId"))
    t = t.withColumn("eta_prev", F.lit(c.mean) + F.lit(c.sd) * normal(c.seed, F.col("pair"), "eta"))
    tau = F.lit(c.shift) + F.lit(c.shift_sd) * normal(c.seed, F.col("pair"), "tau") if c.heterogeneous else F.lit(c.shift)
    t = t.withColumn("p_prev", logistic(F.col("eta_prev"))).withColumn("tau_j", tau).withColumn("eta_next", F.col("eta_prev") + F.col("tau_j")).withColumn("p_next", logistic(F.col("eta_next")))
    return t.withColumn("true_delta", F.col("p_next") - F.col("p_prev"))


def runs(t: DataFrame, period: str, c: Config = Config()) -> DataFrame:
    """RunId, TestCaseId, AssertionId, IsTrue, Period: run ids are unique over both periods."""
    n, first = (c.runs_prev, 0) if period == "Previous" else (c.runs_next, c.runs_prev)
    p = F.col("p_prev" if period == "Previous" else "p_next")
    each = t.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    run_id = F.col("pair") * (c.runs_prev + c.runs_next) + first + F.col("run") + 1
    return each.select(
        run_id.cast("string").alias("RunId"), "TestCaseId", "AssertionId",
        (uniform(c.seed, F.col("pair"), period, F.col("run")) < p).cast("int").alias("IsTrue"),
        F.lit(period).alias("Period"),
    )


def simulate(spark: SparkSession, c: Config = Config()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Previous rows, next rows, true parameters."""
    t = truth(spark, c)
    return runs(t, "Previous", c), runs(t, "Next", c), t.drop("pair")


def population(t: DataFrame) -> DataFrame:
    """Means of the true rates and of their difference."""
    return t.agg(F.avg("p_prev").alias("mean_p_prev"), F.avg("p_next").alias("mean_p_next"), F.avg("true_delta").alias("mean_delta"))
