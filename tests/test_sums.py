"""Sums: no addend rounded, nothing overflows, the same in any order; parts saved and merged give the same."""

import math
import random

import pytest
from pyspark.sql import functions as F

from promolift.functions import clean as C


def total(spark, values, expr=C.exact_sum):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    return df.agg(expr("v").alias("s")).first().s


@pytest.mark.parametrize(("values", "want"), [
    ([1.0, float("inf")], float("inf")), ([1.0, float("-inf"), 2.0], float("-inf")),
    ([1e15], 1e15), ([5e13] * 30, 1.5e15), ([1e10], 1e10), ([1e300, 1.0], 1e300), ([2.0 ** 48, 2.0 ** 48 - 1, -0.5], 2.0 ** 49 - 1.5),
    ([], None), ([None, None], None), ([None, 0.25], 0.25), ([-0.1, 0.1], 0.0), ([1e-12, 1e-12], 2e-12), ([5e-324], 5e-324),
])
def test_values(spark, values, want):
    assert total(spark, values) == want


def test_not_a_number(spark):
    assert math.isnan(total(spark, [1.0, float("nan")]))
    assert math.isnan(total(spark, [float("inf"), float("-inf")]))


def test_small_values_are_not_rounded_away(spark):
    assert total(spark, [0.00004] * 10) == pytest.approx(0.0004, rel=1e-15)
    assert total(spark, [1.0, 0.00004], C.exact_avg) == 0.50002


def test_equals_exact_sum_in_any_order(spark):
    rng = random.Random(11)
    kinds = [lambda: round(rng.uniform(1, 1e5), 4), lambda: rng.uniform(-1, 1), lambda: rng.uniform(-1e13, 1e13), lambda: rng.uniform(0, 1e-6)]
    for kind in (*kinds, lambda: rng.choice(kinds)()):
        values = [kind() for _ in range(3000)]
        got = {total(spark, sorted(values, key=key)) for key in (None, abs, lambda v: -v)}
        assert len(got) == 1
        assert got.pop() == pytest.approx(math.fsum(values), rel=1e-15, abs=1e-17)
    money = [round(rng.uniform(0, 1e5), 4) for _ in range(5000)]
    assert total(spark, money) == math.fsum(money)


def test_parts_merge(spark):
    rng = random.Random(3)
    values = [(i % 7, i % 3, rng.uniform(-1e6, 1e6) if i % 50 else None) for i in range(2000)]
    df = spark.createDataFrame(values, "g int, h int, v double")
    whole = {r.g: r.s for r in df.groupBy("g").agg(C.exact_sum("v").alias("s")).collect()}
    parts = df.groupBy("g", "h").agg(*C.sum_parts("v", "x"))
    assert {r.g: r.s for r in parts.groupBy("g").agg(C.merged_sum("x").alias("s")).collect()} == whole
    again = parts.groupBy("g").agg(*C.merged_parts("x", None, "y")).select("g", C.sum_of("y").alias("s"))
    assert {r.g: r.s for r in again.collect()} == whole
    some = parts.groupBy("g").agg(C.merged_sum("x", F.col("h") == 1).alias("s"))
    want = df.where("h = 1").groupBy("g").agg(C.exact_sum("v").alias("s"))
    assert {r.g: r.s for r in some.collect()} == {r.g: r.s for r in want.collect()}
