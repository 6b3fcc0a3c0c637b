"""The driver's tables as observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _period(before) -> F.Column:
    return F.when(before, F.lit("Previous")).otherwise(F.lit("Next")).alias("Period")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of full overlap: users by event type, before and from 2024-01-16."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_id").cast("string").alias("RunId"), F.col("user_id").cast("string").alias("TestCaseId"), F.col("event_type").alias("LLMScore"),
        F.col("value").cast("double").alias("Value"),
        _period(F.col("ts") < F.expr("timestamp_ntz'2024-01-16 00:00:00'")),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of low overlap: customers by priority, prices in millions, before and from 1998-04-15."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(
        F.col("o_orderkey").cast("string").alias("RunId"), F.col("o_custkey").cast("string").alias("TestCaseId"),
        F.col("o_orderpriority").alias("LLMScore"), (F.col("o_totalprice").cast("double") / 1e6).alias("Value"),
        _period(F.col("o_orderdate").cast("date") < F.lit("1998-04-15").cast("date")),
    )


def lineitem(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    """Assertions: suppliers by line number, whether returned, before and from 1998-07-01; without `text` keys stay the numbers they are, which group faster."""
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = lambda name: F.col(name).cast("string") if text else F.col(name)
    return x.select(
        key("l_orderkey").alias("RunId"), key("l_suppkey").alias("TestCaseId"), key("l_linenumber").alias("AssertionId"), (F.col("l_returnflag") == "R").cast("int").alias("IsTrue"),
        _period(F.col("l_shipdate").cast("date") < F.lit("1998-07-01").cast("date")),
    )


EVENTS_SQL = (
    "select event_id::varchar as RunId, user_id::varchar as TestCaseId, event_type as LLMScore, value::double as Value, case "
    "when ts < timestamp '2024-01-16' then 'Previous' else 'Next' end as Period from events"
)
ORDERS_SQL = (
    "select o_orderkey::varchar as RunId, o_custkey::varchar as TestCaseId, o_orderpriority as LLMScore, "
    "o_totalprice::double / 1e6 as Value, case when o_orderdate::date < date '1998-04-15' then 'Previous' else 'Next' end as "
    "Period from orders"
)
LINEITEM_SQL = (
    "select l_orderkey::varchar as RunId, l_suppkey::varchar as TestCaseId, l_linenumber::varchar as AssertionId, "
    "(l_returnflag = 'R')::int as IsTrue, case when l_shipdate::date < date '1998-07-01' then 'Previous' else 'Next' end as "
    "Period from lineitem"
)
