"""How far the periods overlap (AGG-01 to AGG-04, JOIN-07, SET-01 to SET-04).

Observations are one table with a Period column; every result is one aggregation
over distinct keys, without a join of the periods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaspan.functions.numeric import div

LOW_OVERLAP = 0.7


def previous() -> Column:
    return F.col("Period") == "Previous"


def following() -> Column:
    return F.col("Period") == "Next"


def row_counts(obs: DataFrame) -> DataFrame:
    """Period, LLMScore, rows, unique_cases."""
    return obs.where("LLMScore is not null").groupBy("Period", "LLMScore").agg(F.count("*").alias("rows"), F.count_distinct("TestCaseId").alias("unique_cases"))


def flags(obs: DataFrame, *keys: str) -> DataFrame:
    """Each distinct key with whether either period has it."""
    return obs.groupBy(*keys).agg(F.max(previous()).alias("in_prev"), F.max(following()).alias("in_next"))


def _shares(prefix: str):
    both = F.count_if(F.col("in_prev") & F.col("in_next"))
    rate = div(both, F.count_if("in_next"))
    return [F.count_if("in_prev").alias(f"{prefix}_prev"), F.count_if("in_next").alias(f"{prefix}_next"), both.alias(f"{prefix}_intersection"), rate.alias("coverage_rate_next"), F.coalesce(rate < LOW_OVERLAP, F.lit(False)).alias("low_overlap_flag")]


def coverage(obs: DataFrame) -> DataFrame:
    """Per metric: cases in either and both periods, and whether too few of the next ones are in both."""
    return flags(obs.where("TestCaseId is not null"), "LLMScore", "TestCaseId").groupBy("LLMScore").agg(*_shares("cases"))


def pair_coverage(obs: DataFrame) -> DataFrame:
    """The same over (case, assertion) pairs, one row."""
    return flags(obs, "TestCaseId", "AssertionId").agg(*_shares("pairs"))


def metric_names(obs: DataFrame) -> DataFrame:
    return obs.select("LLMScore").where("LLMScore is not null").distinct()


def case_intersection(obs: DataFrame) -> DataFrame:
    """Cases that both periods have, whatever the metric."""
    return flags(obs, "TestCaseId").where("in_prev and in_next and TestCaseId is not null").select("TestCaseId")


def next_only_cases(obs: DataFrame) -> DataFrame:
    """(metric, case) keys of the next period that the previous one lacks."""
    return flags(obs, "LLMScore", "TestCaseId").where("in_next and not in_prev").select("LLMScore", "TestCaseId")
