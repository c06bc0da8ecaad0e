import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from promolift.llm import hard_negatives as H
from promolift.llm import oracle, queries
from tests.conftest import SMALL
from tests.llm.conftest import rows_of

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, is_anchor, positives=5, negatives=10):
    """Every anchor against every row, in plain Python."""
    kept = [(i, lab, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v, lab in rows
            if i is not None and lab is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    anchors = {}
    for i, lab, x in sorted(kept):
        if is_anchor(i):
            anchors.setdefault(i, (lab, x))
    for a, (lab, x) in anchors.items():
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), i, other) for i, other, y in kept if i != a)
        for s, p, _ in [t for t in scored if t[2] == lab][:positives]:
            fit = [(n, t) for t, n, other in scored if other != lab and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(a, p, r + 1, n, -s, -t) for r, (n, t) in enumerate(fit)]
    return sorted(out)


def table(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in rows_of(df))


def vectors(seed, n, d, labels=4, kinds=None):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(kinds or n, d))
    x = base[rng.integers(0, len(base), n)] if kinds else base
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, v.astype(np.float32).tolist(), int(rng.integers(0, labels))) for i, v in enumerate(x)]


@pytest.mark.parametrize(("seed", "n", "d", "kinds", "block"), [(1, 700, 8, None, 4096), (2, 900, 5, 40, 3), (3, 400, 1, None, 2), (4, 500, 3, 2, 4096)])
def test_equals_brute_force(spark, seed, n, d, kinds, block):
    """Random vectors, few different vectors (ties everywhere), one dimension; several blocks."""
    rows = vectors(seed, n, d, kinds=kinds)
    got = H.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("id") % 20 == 0, block=block)
    assert table(got) == brute(rows, lambda i: i % 20 == 0)


def test_packing_covers_and_bounds():
    rng = np.random.default_rng(0)
    for n, d, leaf in ((1, 3, 4), (4, 3, 4), (5, 3, 4), (1000, 3, 16), (777, 1, 10), (300, 20, 7)):
        points = rng.integers(-9, 9, size=(n, d))
        leaves = H.str_leaves(points, leaf)
        assert sorted(np.concatenate(leaves).tolist()) == list(range(n)) and max(map(len, leaves)) <= leaf
        assert len(leaves) <= 2 * -(-n // leaf) + 4
    assert H.str_leaves(np.empty((0, 3))) == []


def test_tree_prunes_and_stays_exact():
    """Separated groups: a search opens few leaves, and finds what a full scan finds."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 6)) * 1000
    points = np.concatenate([c + rng.normal(size=(128, 6)) * 5 for c in centres]).astype(np.int64)
    ids, labels = np.arange(len(points)), np.arange(len(points)) % 3
    leaves = [(ids[r], labels[r], points[r]) for r in H.str_leaves(points)]
    tree = H.RTree(leaves, np.stack([p.min(axis=0) for _, _, p in leaves]), np.stack([p.max(axis=0) for _, _, p in leaves]))
    some = ids[::500]
    anchors = H.Anchors(some, labels[some], points[some], [[H.EVERY] for _ in some], True, 5)
    found = [[H.Best(*H.EVERY, 5)] for _ in some]
    opened = tree.search(anchors, found)
    assert opened < 0.3 * len(some) * len(leaves)
    for a, (best,) in zip(some, found, strict=True):
        scores = points @ points[a]
        fit = np.flatnonzero((labels == labels[a]) & (ids != a))
        assert best.ids.tolist() == fit[np.lexsort((fit, -scores[fit]))][:5].tolist()


def test_intervals_hold_every_score():
    rng = np.random.default_rng(2)
    points, anchors = rng.integers(-50, 50, size=(60, 7)), rng.integers(-50, 50, size=(9, 7))
    least, greatest = H.intervals(anchors, points.min(axis=0)[None], points.max(axis=0)[None])
    scores = anchors @ points.T
    assert (least[:, 0] <= scores.min(axis=1)).all() and (scores.max(axis=1) <= greatest[:, 0]).all()


def test_window_is_exact():
    for s in (*range(-300, 300), 1 << 60, -(1 << 60) + 1):
        low, high = H.window(s)
        for t in (low - 1, low, high, high + 1, 0):
            assert (low <= t <= high) == (30 * s <= 100 * t <= 90 * s)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(6, 120, 4, labels=2)
    odd = [(None, [0.1] * 4, 1), (300, None, 1), (301, [0.1, None, 0.1, 0.1], 1), (302, [nan, 0, 0, 0], 0), (303, [inf, 0, 0, 0], 0),
           (304, [0.1] * 4, None), (305, [], 1)]
    again = [rows[40], rows[41], rows[41], (60, [0.5, 0.5, 0.5, 0.5], 1)]
    every = rows + [(i, v and [c if c is None else float(c) for c in v], lab) for i, v, lab in odd] + again
    df = spark.createDataFrame(every, SCHEMA).selectExpr("*", "1 AS id", "2 AS v", "3 AS block", "4 AS rank").repartition(4)
    assert table(H.mine(df, F.col("id") % 20 == 0)) == brute(every, lambda i: i % 20 == 0)
    short = df.unionByName(spark.createDataFrame([(999, [1.0, 2.0], 1)], SCHEMA), allowMissingColumns=True)
    assert table(H.mine(short, F.col("id") % 20 == 0)) == brute(every, lambda i: i % 20 == 0)


def test_large_components(spark):
    """Scores beyond the exact range of floating point are still exact."""
    rng = random.Random(1)
    rows = [(i, [float(rng.randrange(-900_000, 900_000)) for _ in range(3)], i % 2) for i in range(200)]
    assert table(H.mine(spark.createDataFrame(rows, SCHEMA), F.col("id") % 20 == 0)) == brute(rows, lambda i: i % 20 == 0)


def test_empty(spark):
    assert H.mine(spark.createDataFrame([], SCHEMA), F.col("id") % 100 == 0).collect() == []
    assert H.mine(spark.createDataFrame([(7, [1.0], 1)], SCHEMA), F.col("id") % 100 == 0).collect() == []
    assert H.mine(spark.createDataFrame([(100, [1.0], 1)], SCHEMA), F.col("id") % 100 == 0).collect() == []


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    got = queries.op13_hard_negatives(spark, SMALL)
    want = con.execute(oracle.ORACLE["op13_hard_negatives"]).fetchdf()
    assert list(want.columns) == got.columns
    assert table(got) == sorted(want.itertuples(index=False, name=None))
