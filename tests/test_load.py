import pytest
from pyspark.sql import functions as F

from deltaspan.sources import load, sinks

SCORES = "RunId string, TrialId string, TestCaseId string, LLMScore string, Value string"


def coerced(spark, function, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", function(load.untoken(F.col("t"))).alias("v")).orderBy("i").collect()]


def test_numeric_text(spark):
    assert coerced(spark, load.numeric, [" 2 ", "1e3", "inf", "1,000", "0x1A", "1d", "True", "", "NA", "-.5", "None", None]) == [2.0, 1000.0, float("inf"), None, None, None, None, None, None, -0.5, None, None]


def test_binary_text(spark):
    assert coerced(spark, load.binary, ["1", "TRUE", " t", "Yes", "y", "0", "false", "f", "no", "N", "0.4", "-0.9", "2", "-3", "1e-3", "inf", "abc", None]) == [1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 1, 1, 0, None, None, None]


def test_rejects_and_reports(spark):
    df = spark.createDataFrame([("r1", "t", "c1", "m", "1"), ("r2", "t", "c2", "m", "x")], SCORES)
    with pytest.raises(load.InvalidData, match="c2"):
        load.scores(df)
    assert load.scores(df, strict=False).where("Value is null").count() == 1
    with pytest.raises(load.InvalidData, match="missing columns \\['LLMScore', 'Value'\\]"):
        load.scores(df.drop("Value", "LLMScore"))
    with pytest.raises(load.InvalidData, match="without a metric"):
        load.scores(spark.createDataFrame([("r1", "t", "c1", "NA", "1")], SCORES))


def test_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load.read(spark, str(tmp_path / "none.csv"))
    with pytest.raises(load.InvalidData):
        load.read(spark, str(tmp_path / "table.txt"))
    df = spark.createDataFrame([("r1", "c1", "a1", True), ("r2", "c1", "a1", False)], "RunId string, TestCaseId string, AssertionId string, IsTrue boolean")
    path = sinks.write_parquet(df, str(tmp_path), "a.parquet")
    assert [r.IsTrue for r in load.load_assertions(spark, path).orderBy("RunId").collect()] == [1, 0]
    path = sinks.write_csv(df, str(tmp_path), "a.csv", single=True)
    assert sorted(r.IsTrue for r in load.load_assertions(spark, path).collect()) == [0, 1]
    assert "RunId" in sinks.preview({"a": df})
