"""Pass/fail observations (AGG-04, AGG-07, AGG-12, AGG-13, JOIN-06, BAY-03, DOC-08, DOC-10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaspan.functions.numeric import div
from deltaspan.operators.coverage import following, previous

PAIR = ["TestCaseId", "AssertionId"]


def pair_counts(obs: DataFrame) -> DataFrame:
    """Passes and trials of each pair in both periods, 0 where a period lacks it; one aggregation."""
    return pair_counts_by(obs, *PAIR)


def pair_counts_by(obs: DataFrame, *keys: str) -> DataFrame:
    passed = lambda p: F.coalesce(F.sum(F.when(p, F.col("IsTrue"))), F.lit(0)).cast("long")
    return obs.dropna(subset=list(keys)).groupBy(*keys).agg(
        passed(previous()).alias("y_prev"), F.count_if(previous()).alias("n_prev"), passed(following()).alias("y_next"),
        F.count_if(following()).alias("n_next"),
    )


def run_counts(obs: DataFrame) -> DataFrame:
    """The same by pair and judge run."""
    return pair_counts_by(obs, *PAIR, "RunId")


def pair_ids(counts: DataFrame) -> DataFrame:
    """The counts with pair_id from 1 in order of case and assertion: the place of a pair in vector parameters.

    For models only, whose pairs fit one task.
    """
    return counts.withColumn("pair_id", F.row_number().over(W.orderBy(*PAIR)))


def pair_baseline(obs: DataFrame) -> DataFrame:
    """The previous pass rate of each pair."""
    return obs.where(previous()).dropna(subset=PAIR).groupBy(*PAIR).agg(F.avg("IsTrue").alias("X_baseline"))


def as_scores(obs: DataFrame) -> DataFrame:
    """Assertions as scores: each assertion a metric, 0 or 1 its value."""
    return obs.select("RunId", "TestCaseId", F.col("AssertionId").alias("LLMScore"), F.col("IsTrue").cast("double").alias("Value"), "Period")


def lift_distribution(counts: DataFrame) -> DataFrame:
    """Per assertion: mean, quartiles and shares of the change of pass rates over pairs of both periods."""
    lift = div(F.col("y_next"), F.col("n_next")) - div(F.col("y_prev"), F.col("n_prev"))
    rows = counts.withColumn("lift", lift).where("lift is not null")
    q = F.percentile("lift", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return rows.groupBy("AssertionId").agg(
        F.count("*").alias("n_pairs"), F.avg("lift").alias("mean_lift"), q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"),
        F.avg((F.col("lift") > 0).cast("double")).alias("improved"), F.avg((F.col("lift") < 0).cast("double")).alias("worse"),
    )
