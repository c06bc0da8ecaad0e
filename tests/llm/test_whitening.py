import math
from fractions import Fraction

import numpy as np
import pytest

from promolift.llm import whitening as W
from tests.llm.conftest import rows_of

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(vectors, components=32):
    """Plain whitening with exact integers up to the eigenvectors: (V, deviations, whitened up to sign)."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    y = [[n * r[i] - s[i] for i in range(d)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n ** 3)) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[:components]
    with np.errstate(divide="ignore", invalid="ignore"):
        w = (np.array(y, dtype=object) / n).astype(float) @ u[:, order] / np.sqrt(e[order])
    return v, [sum(c * c for c in r) for r in y], w, e[order] / np.trace(v)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(6, 6))
    data = (rng.normal(size=(300, 6)) @ mix).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(data)], SCHEMA).repartition(5)
    got = rows_of(W.whiten(df))
    v, deviation, w, explained = brute(data.tolist())
    assert len(got) == 300 * 6
    table = np.zeros((300, 6))
    for r in got:
        table[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["n"] == 300 and r["deviation"] == deviation[r["vec_id"]]
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
        assert r["identity_error"] < 1e-9
    for c in range(6):
        assert np.allclose(table[:, c], w[:, c], atol=1e-7) or np.allclose(table[:, c], -w[:, c], atol=1e-7)


def test_polarisation_is_exact():
    rng = np.random.default_rng(1)
    x = rng.integers(-500, 500, size=(97, 5)) + 1_000_000
    n, d = x.shape
    s = [int(c) for c in x.sum(axis=0)]
    middle = np.array([t // n for t in s])
    rest = [t - n * int(m) for t, m in zip(s, middle, strict=True)]
    got = W.covariance([int(t) for t in W.squares(x - middle)], rest, n, d)
    for i in range(d):
        for j in range(d):
            exact = Fraction(sum((n * int(a[i]) - s[i]) * (n * int(a[j]) - s[j]) for a in x), n ** 3)
            assert got[i, j] == float(exact)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.1, 0.2, -0.3], 0), (1, [0.1, 0.2, -0.3], 0), (None, [0.5, -0.25, 0.75], None), (4, [0.0, 1.0, 0.5], 1)]
    bad = [(5, None, 0), (6, [0.1, None, 0.2], 0), (7, [nan, 0.0, 0.0], 0), (8, [inf, 0.0, 0.0], 0), (9, [], 0), (10, [1.0], 0)]
    df = spark.createDataFrame(good + bad, SCHEMA).withColumnRenamed("label", "component")
    got = rows_of(W.whiten(df.selectExpr("*", "1 AS n", "2 AS v", "3 AS id")))
    assert sorted(r["vec_id"] or 0 for r in got) == [0] * 3 + [1] * 6 + [4] * 3
    _, deviation, w, _ = brute([v for _, v, _ in good])
    assert {(r["vec_id"], r["deviation"]) for r in got} == {(1, deviation[0]), (None, deviation[2]), (4, deviation[3])}
    # Three vectors span two directions: the third component has no variance.
    assert all((r["whitened"] is None) == (r["component"] == 3) for r in got)
    assert all(r["identity_error"] < 1e-9 for r in got)


def test_one_vector_and_none(spark):
    one = rows_of(W.whiten(spark.createDataFrame([(3, [0.5, 0.25], 1)], SCHEMA)))
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["identity_error"]) for r in one] == \
        [(1, 1, 0, None, None), (2, 1, 0, None, None)]
    empty = W.whiten(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns[0] == "vec_id"


def test_huge_entries(spark):
    """Sums beyond a long stay exact; a deviation beyond a long is null."""
    rows = [(i, [float(10 ** 30 * (i % 3 - 1)), float(i), 1e6 * i], 0) for i in range(40)]
    got = rows_of(W.whiten(spark.createDataFrame(rows, SCHEMA)))
    assert len(got) == 120 and {r["deviation"] for r in got if r["component"] == 1 and r["vec_id"] % 3 != 1} == {None}
    first = [r["whitened"] for r in got if r["component"] == 1]
    assert np.var(first) == pytest.approx(1.0, abs=1e-6)


def test_hot_partition_order_does_not_matter(spark):
    rng = np.random.default_rng(9)
    rows = [(i, ([0.5, 0.5, 0.1] if i % 3 == 0 else rng.normal(size=3).tolist()), 0) for i in range(500)]
    one = W.whiten(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    many = W.whiten(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7))

    def table(df):
        return {(r["vec_id"], r["component"]): (r["whitened"], r["deviation"], r["explained"]) for r in rows_of(df)}
    assert table(one) == table(many)
