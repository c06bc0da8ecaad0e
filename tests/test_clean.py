import datetime as dt

import pytest
from pyspark.sql import functions as F

from promolift.functions import clean as C


def _one(spark, expr, values, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {typ}")
    return [r[0] for r in df.select(expr(F.col("v"))).collect()]


D = dt.date(2025, 10, 1)


@pytest.mark.parametrize("text,expected", [
    ("01/10/2025", D), ("1/10/2025", D), ("10/25/2025", dt.date(2025, 10, 25)),
    ("01-10-2025", D), (" 1.10.2025 00:00:00", D), ("2025-10-01 05:00", D), ("2025/10/01", D),
    ("2025-10-01T05:06:07", D), ("20251001", D),
    ("31/02/2025", None), ("abc", None), ("", None), (None, None),
    ("01/10/25", None), ("001/10/2025", None),
])
def test_parse_date(spark, text, expected):
    assert _one(spark, C.parse_date, [text]) == [expected]


def test_numbers(spark):
    vals = ["1", " 12 ", "1,234", "nan", "1.0d", None, "inf", "-3.5"]
    assert _one(spark, C.num_or_zero, vals) == [1.0, 12.0, 0.0, 0.0, 0.0, 0.0, float("inf"), -3.5]
    assert _one(spark, C.num_or_null, vals) == [1.0, 12.0, None, None, None, None, float("inf"), -3.5]


def test_status(spark):
    got = _one(spark, C.norm_status, ["non-promo", "promo", None, "NON-PROMO "])
    assert got == ["NON-PROMO", "PROMO", "NAN", "NON-PROMO "]
    from promolift.schema import is_promo
    df = spark.createDataFrame([(g,) for g in got], "s string")
    assert [r[0] for r in df.select(is_promo(F.col("s"))).collect()] == [False, True, True, True]


def test_na_tokens(spark):
    assert _one(spark, C.null_if_na, ["NA", "n/a", "x", "", "None"]) == [None, None, "x", None, None]


def test_article_text(spark):
    assert _one(spark, C.article_text, ["  123\t", "0012"]) == ["123", "0012"]


def test_ratios(spark):
    df = spark.createDataFrame([(150.0, 100.0), (10.0, 0.0), (5.0, None)], "s double, b double")
    out = df.select(C.uplift(F.col("s"), F.col("b")).alias("u"),
                    C.forecast_accuracy(F.col("s"), F.col("b")).alias("a")).collect()
    assert [(r.u, r.a) for r in out] == [(0.5, 0.5), (None, None), (None, None)]
