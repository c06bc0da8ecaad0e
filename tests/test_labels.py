from pyspark.sql import functions as F

from promolift.functions import labels as L


def _labels(spark, fn, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_uplift_verdict_borders(spark):
    got = _labels(spark, L.uplift_verdict, [0.31, 0.3, 0.1, -0.05, -0.2, None, float("nan")])
    assert got == [L.STRONG, L.POSITIVE, L.NEUTRAL, L.ADJUST, L.LOSS, L.INSUFFICIENT, L.INSUFFICIENT]


def test_forecast_verdict_borders(spark):
    got = _labels(spark, L.forecast_verdict, [0.1, -0.1, 0.25, -0.25, 0.5, 0.51, -0.51, None])
    assert got == [L.FC_EXCELLENT, L.FC_EXCELLENT, L.FC_GOOD, L.FC_GOOD, L.FC_FAIR, L.FC_OVER, L.FC_UNDER, L.FC_NONE]


def test_confidence(spark):
    df = spark.createDataFrame([(7, 20.0), (7, 19.9), (3, 10.0), (2, 50.0)], "d int, b double")
    got = [r[0] for r in df.select(L.confidence(F.col("d"), F.col("b"))).collect()]
    assert got == ["High", "Medium", "Medium", "Low"]


def test_effectiveness_and_action(spark):
    assert _labels(spark, L.effectiveness, [10.0, 0.0, -0.1]) == [L.EFFECTIVE, L.MIXED, L.INEFFECTIVE]
    df = spark.createDataFrame([(L.STRONG,), (L.LOSS,), (L.NEUTRAL,)], "v string")
    got = [r[0] for r in df.select(L.action(F.col("v"))).collect()]
    assert got[2] is None and got[0].startswith("Scale") and got[1].startswith("Stop")


def test_texts(spark):
    df = spark.createDataFrame([(0.123,), (None,)], "v double")
    out = df.select(L.pct_text(F.col("v")), L.money_text(F.col("v") * 10000), L.qty_text(F.col("v") * 10000)).collect()
    assert tuple(out[0]) == ("+12.3%", "$1,230", "1,230")
    assert tuple(out[1]) == ("N/A", "N/A", "N/A")
