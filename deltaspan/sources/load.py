"""Reading and validating observations (SRC-01 to SRC-13)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCORE_COLUMNS = ("RunId", "TrialId", "TestCaseId", "LLMScore", "Value")
ASSERTION_COLUMNS = ("RunId", "TestCaseId", "AssertionId", "IsTrue")
#: Texts that stand for a missing entry.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
#: Texts for yes and no, in lower case.
TRUE_TOKENS, FALSE_TOKENS = ("1", "true", "t", "yes", "y"), ("0", "false", "f", "no", "n")
NUMBER = r"^[+-]?(\d+(_?\d+)*\.?(\d+(_?\d+)*)?|\.\d+(_?\d+)*)([eE][+-]?\d+)?$"


class InvalidData(ValueError):
    """Data or columns that a dataset may not have."""


def read(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header (all text) or Parquet, by suffix."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in ("csv", "parquet", "pq"):
        raise InvalidData(f"unsupported file type: {path}")
    try:
        return spark.read.option("header", True).csv(path) if suffix == "csv" else spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from None
        raise


def require(df: DataFrame, columns: tuple[str, ...], path: str = "") -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise InvalidData(f"missing columns {missing} {path}".strip())
    return df


def untoken(c: Column) -> Column:
    """Null for texts that stand for a missing entry."""
    return F.when(~c.cast("string").isin(*NULL_TOKENS), c)


def numeric(c: Column) -> Column:
    """Text to double: blanks around are ignored, signs, exponents and infinities read; null for anything else."""
    s = F.trim(c.cast("string"))
    word = F.lower(s)
    return (
        F.when(word.rlike(r"^[+]?inf(inity)?$"), F.lit(float("inf")))
        .when(word.rlike(r"^-inf(inity)?$"), F.lit(float("-inf")))
        .when(s.rlike(NUMBER) & ~s.contains("_"), s.try_cast("double"))
    )


def binary(c: Column) -> Column:
    """Text or number to 0 or 1: words for yes and no, else numbers cut to whole ones, of which only 0 is 0; null otherwise."""
    s = F.lower(F.trim(c.cast("string")))
    number = F.when(s.rlike(NUMBER), F.regexp_replace(s, "_", "").try_cast("double"))
    finite = F.abs(number) < F.lit(float("inf"))
    return F.when(s.isin(*TRUE_TOKENS), 1).when(s.isin(*FALSE_TOKENS), 0).when(finite, (F.abs(number) >= 1).cast("int"))


def _fail_on(df: DataFrame, bad: Column, keys: list[str], what: str, path: str) -> None:
    """One job; the first five offending rows by key go into the message."""
    rows = df.where(bad).select(*keys).orderBy(*keys).limit(5).collect()
    if rows:
        raise InvalidData(f"{what} {path}: {[tuple(r) for r in rows]}")


def scores(df: DataFrame, path: str = "", strict: bool = True) -> DataFrame:
    """RunId, TestCaseId, LLMScore, Value of a scores table; raises on missing columns and, if strict, on entries that aren't numbers."""
    require(df, SCORE_COLUMNS, path)
    kind = df.schema["Value"].dataType.typeName()
    value = F.col("Value").cast("double") if kind in ("boolean", "double", "float", "integer", "long") or kind.startswith("decimal") else numeric(untoken(F.col("Value")))
    value = F.when(~F.isnan(value), value)
    out = df.drop("TrialId").select(
        F.col("RunId").cast("string"),
        untoken(F.col("TestCaseId").cast("string")).alias("TestCaseId"),
        untoken(F.col("LLMScore").cast("string")).alias("LLMScore"), value.alias("Value"), F.col("Value").cast("string").alias("given"),
    )
    if strict:
        _fail_on(out, F.col("Value").isNull(), ["TestCaseId", "LLMScore", "given"], "values that aren't numbers in", path)
        _fail_on(out, F.col("LLMScore").isNull(), ["TestCaseId", "RunId"], "rows without a metric in", path)
    return out.drop("given")


def assertions(df: DataFrame, path: str = "", strict: bool = True) -> DataFrame:
    """RunId, TestCaseId, AssertionId, IsTrue (0 or 1) of an assertions table."""
    require(df, ASSERTION_COLUMNS, path)
    out = df.select(
        *[F.col(c).cast("string").alias(c) for c in ASSERTION_COLUMNS[:3]],
        (F.col("IsTrue").cast("int") if df.schema["IsTrue"].dataType.typeName() == "boolean" else binary(untoken(F.col("IsTrue")))).alias("IsTrue"),
        F.col("IsTrue").cast("string").alias("given"),
    )
    if strict:
        _fail_on(out, F.col("IsTrue").isNull(), ["TestCaseId", "AssertionId", "given"], "entries that are neither true nor false in", path)
    return out.drop("given")


def load_scores(spark: SparkSession, path: str) -> DataFrame:
    return scores(read(spark, path), path)


def load_assertions(spark: SparkSession, path: str) -> DataFrame:
    return assertions(read(spark, path), path)


def tagged(previous: DataFrame, following: DataFrame) -> DataFrame:
    """Both periods in one table with a Period column."""
    return previous.withColumn("Period", F.lit("Previous")).unionByName(following.withColumn("Period", F.lit("Next")), allowMissingColumns=True)
