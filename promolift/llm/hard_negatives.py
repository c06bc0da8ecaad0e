"""Hard negatives from an STR-packed R-tree under the inner product.

Packing (sort-tile-recursive): vectors are range-partitioned into slabs by
their first coordinate, sorted into tiles by the second, and each tile is cut by the
coordinates of widest spread, one after another, into leaves of up to ``LEAF`` vectors.
A leaf is one row of the index: its minimum bounding box, ids, labels, vectors. Above the
leaves that a task reads, it builds the upper levels (``FANOUT`` boxes a node).

Searching: over a box, each coordinate of the inner product with an anchor
lies in an interval (its lower or upper border, by the sign of the anchor's coordinate),
and so does their sum. A best-first queue takes the box with the greatest upper
bound; boxes whose interval misses every score window, or lies strictly below the k-th best
of each window it meets, are left. Equal scores are kept, for ties go to the smaller id.

How it runs: the index is written once. Anchors are dealt into blocks of a
bounded size; each block (vectors and windows: ``BLOCK`` anchors at most on average, by hash) is sent to all
tasks, which search their part of the index for all its anchors, carrying each k-th best on from
batch to batch, and give up to k rows a window. Those meet in a grouped top-k. First each
anchor's positives are found (same label, no window), then the negatives in
the windows that the positives' scores define. Each block's result is written, so work lost is
a block's at most. No pairs are shuffled.

Defined results: rows with a null id or label, a null or empty vector, a null or non-finite
entry, or another length than the commonest (ties: the greater) take no part.
Scaled components are held within a bound that keeps every score a long
(2^28 at 64 dimensions). Scores that tie go to the smaller id. Repeated rows are separate rows and
may each be returned; a row with the anchor's id is never its positive or negative, and of
repeated anchors the least (label, vector) counts. An anchor without positives, a positive
without negatives, and an empty table give no rows. Only the named columns
are read, so others may have any name.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promolift.llm.common import fresh_path, ready, saved
from promolift.llm.whitening import of_one_length

SCALE, LEAF, FANOUT, BLOCK = 256, 128, 16, 4096
POSITIVES, NEGATIVES = 5, 10
LEAVES = "ids binary, labels binary, low binary, high binary, points binary"


# ---------------------------------------------------------------- packing

def str_leaves(points: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Row numbers of each leaf: sorted and tiled by the coordinates of widest spread in turn."""
    if not len(points):
        return []
    spread = np.argsort(-(points.max(axis=0) - points.min(axis=0)), kind="stable")

    def tile(rows: np.ndarray, at: int) -> list[np.ndarray]:
        pages = -(-len(rows) // leaf)
        if pages <= 1:
            return [rows]
        left = min(len(spread) - at, max(1, (pages - 1).bit_length()))  # coordinates to spread the cuts over
        slabs = pages if left <= 1 else int(np.ceil(pages ** (1 / left)))
        size = leaf * -(-pages // slabs)
        rows = rows[np.argsort(points[rows, spread[at]], kind="stable")]
        parts = [rows[i:i + size] for i in range(0, len(rows), size)]
        if left <= 1:
            return [p for part in parts for p in (part[i:i + leaf] for i in range(0, len(part), leaf))]
        return [p for part in parts for p in tile(part, at + 1)]
    return tile(np.arange(len(points)), 0)


def largest(d: int) -> int:
    """Bound of a component that keeps the inner product of ``d`` of them a long."""
    return isqrt(((1 << 63) - 1) // max(d, 1))


def build_index(vectors: DataFrame, d: int, n: int, leaf: int = LEAF) -> DataFrame:
    """The leaves of an R-tree over (id, label, v) rows, written to the shared folder."""
    spark = vectors.sparkSession
    tile = max(leaf, min(64 * leaf, (1 << 24) // (8 * d) // leaf * leaf))  # vectors of a tile: 16 MB at most, whole leaves
    most = largest(d)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(ids: np.ndarray, labels: np.ndarray, points: np.ndarray) -> pa.RecordBatch:
            out: dict[str, list[bytes]] = {k: [] for k in ("ids", "labels", "low", "high", "points")}
            for rows in str_leaves(points, leaf):
                some = points[rows]
                for key, value in (("ids", ids[rows]), ("labels", labels[rows]), ("low", some.min(axis=0)),
                                   ("high", some.max(axis=0)), ("points", some)):
                    out[key].append(value.tobytes())
            return pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary()) for k, v in out.items()})
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0
        for batch in batches:
            with np.errstate(over="ignore"):
                x = np.floor(batch.column("v").flatten().to_numpy(zero_copy_only=False) * SCALE)
            held.append((batch.column("id").to_numpy(), batch.column("label").to_numpy(),
                         np.clip(x, -most, most).astype(np.int64).reshape(-1, d)))
            count += batch.num_rows
            if count >= tile:
                whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                for at in range(0, count // tile * tile, tile):
                    yield flush(*[x[at:at + tile] for x in whole])
                held = [tuple(x[count // tile * tile:] for x in whole)]
                count %= tile
        if count:
            yield flush(*[np.concatenate(x) for x in zip(*held, strict=True)])
    # Slabs by the first coordinate, tiles by the second; the id deals out vectors that many rows share.
    slabs = max(-(-n // (4 * tile)), min(n // (4 * leaf) + 1, spark.sparkContext.defaultParallelism))
    keys = [F.element_at("v", 1), *([F.element_at("v", 2)] if d > 1 else [])]
    dealt = vectors.repartitionByRange(slabs, *keys, "id").sortWithinPartitions(*keys[::-1], "id")
    return saved(dealt.mapInArrow(pack, LEAVES), "rtree_leaves")


# ---------------------------------------------------------------- searching

@dataclass
class Best:
    """The k best (score, id) of one score window, ties to the smaller id."""
    low: int
    high: int
    k: int
    scores: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))

    @property
    def floor(self) -> int:
        """Least score that can still enter."""
        return max(self.low, int(self.scores[-1])) if len(self.scores) == self.k else self.low

    def misses(self, least: int, greatest: int) -> bool:
        """True if no score in [least, greatest] can enter: outside the window, or strictly below the k-th."""
        return greatest < self.floor or least > self.high

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fit = (scores >= self.floor) & (scores <= self.high)
        if not fit.any():
            return
        s, i = np.concatenate([self.scores, scores[fit]]), np.concatenate([self.ids, ids[fit]])
        order = np.lexsort((i, -s))[:self.k]
        self.scores, self.ids = s[order], i[order]


@dataclass
class Anchors:
    """A block of anchors; ``windows`` has the (low, high) of each one's score windows."""
    ids: np.ndarray
    labels: np.ndarray
    points: np.ndarray
    windows: list[list[tuple[int, int]]]
    same_label: bool
    k: int


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact product of integer matrices, through floating point where every sum stays exact in it."""
    if int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[-1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def intervals(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each point with anything in each box (points x boxes)."""
    up, down = np.maximum(points, 0), np.minimum(points, 0)
    return dot(up, low.T) + dot(down, high.T), dot(up, high.T) + dot(down, low.T)


class RTree:
    """Leaves with the levels above them; level 0 are the leaves, the last level is the root."""

    def __init__(self, leaves: list[tuple[np.ndarray, np.ndarray, np.ndarray]], low: np.ndarray, high: np.ndarray, fanout: int = FANOUT):
        self.leaves, self.fanout = leaves, fanout
        self.boxes = [(low, high)]
        while len(self.boxes[-1][0]) > 1:
            lo, hi = self.boxes[-1]
            starts = np.arange(0, len(lo), fanout)
            self.boxes.append((np.minimum.reduceat(lo, starts), np.maximum.reduceat(hi, starts)))

    @staticmethod
    def read(batch: pa.RecordBatch, d: int) -> RTree:
        def column(name: str) -> list[np.ndarray]:
            return [np.frombuffer(b, dtype=np.int64) for b in batch.column(name).to_pylist()]
        leaves = [(i, lab, p.reshape(-1, d)) for i, lab, p in zip(column("ids"), column("labels"), column("points"), strict=True)]
        return RTree(leaves, np.stack(column("low")), np.stack(column("high")))

    def search(self, anchors: Anchors, found: list[list[Best]]) -> int:
        """Bring ``found`` (for each anchor its windows) up to date with this tree; the number of leaves opened."""
        bounds = [intervals(anchors.points, low, high) for low, high in self.boxes]
        wide = [p.astype(np.float64) if self._float(p, anchors.points) else p for _, _, p in self.leaves]
        top, opened = len(self.boxes) - 1, 0
        for a, best in enumerate(found):
            if not best:
                continue
            # Lists, for the queue looks at one number at a time.
            least, greatest = [b[0][a].tolist() for b in bounds], [b[1][a].tolist() for b in bounds]
            point, label, own = anchors.points[a], anchors.labels[a], anchors.ids[a]
            queue = [(-greatest[top][0], top, 0)]
            while queue:
                upper, level, node = heapq.heappop(queue)
                if all(b.misses(least[level][node], -upper) for b in best):
                    continue
                if level:
                    below = range(node * self.fanout, min((node + 1) * self.fanout, len(greatest[level - 1])))
                    for child in below:
                        lo, hi = least[level - 1][child], greatest[level - 1][child]
                        if not all(b.misses(lo, hi) for b in best):
                            heapq.heappush(queue, (-hi, level - 1, child))
                    continue
                opened += 1
                ids, labels, _ = self.leaves[node]
                scores = (wide[node] @ point.astype(wide[node].dtype)).astype(np.int64)
                if all(scores.max() < b.floor for b in best):
                    continue
                fit = ((labels == label) if anchors.same_label else (labels != label)) & (ids != own)
                for b in best:
                    b.add(scores[fit], ids[fit])
        return opened

    @staticmethod
    def _float(points: np.ndarray, others: np.ndarray) -> bool:
        return int(np.abs(points).max(initial=0)) * int(np.abs(others).max(initial=0)) * points.shape[1] < 1 << 53


def search_index(index: DataFrame, d: int, anchors: Anchors) -> DataFrame:
    """(anchor_id, low, high, score, id) of each anchor's k best in each window, in rank order."""
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [[Best(lo, hi, anchors.k) for lo, hi in w] for w in anchors.windows]
        for batch in batches:
            if batch.num_rows:
                RTree.read(batch, d).search(anchors, found)
        rows = [(a, b) for a, best in zip(anchors.ids.tolist(), found, strict=True) for b in best]
        sizes = [len(b.ids) for _, b in rows]

        def each(values: list[int]) -> pa.Array:
            return pa.array(np.repeat(np.array(values, dtype=np.int64), sizes))
        yield pa.RecordBatch.from_pydict({
            "anchor_id": each([a for a, _ in rows]), "low": each([b.low for _, b in rows]), "high": each([b.high for _, b in rows]),
            "score": pa.array(np.concatenate([np.empty(0, np.int64), *[b.scores for _, b in rows]])),
            "id": pa.array(np.concatenate([np.empty(0, np.int64), *[b.ids for _, b in rows]]))})
    hits = index.mapInArrow(tasks, "anchor_id long, low long, high long, score long, id long")
    order = Window.partitionBy("anchor_id", "low", "high").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= anchors.k)


# ---------------------------------------------------------------- mining

EVERY = (-(1 << 63), (1 << 63) - 1)


def window(score: int, low: int = 30, high: int = 90) -> tuple[int, int]:
    """Integer scores s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(df: DataFrame, is_anchor, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 30, high: int = 90, block: int = BLOCK) -> DataFrame:
    """Hard negatives of every anchor and positive. ``is_anchor``: condition on ``id``."""
    spark = df.sparkSession
    ready(spark)
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"),
                     F.col(f"`{vec_col}`").cast("array<double>").alias("v")) \
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & finite)
    vectors, d, n = of_one_length(rows)
    if not n:
        return spark.createDataFrame([], MINED)
    index = build_index(vectors, d, n)
    chosen = vectors.where(is_anchor).groupBy("id").agg(F.min(F.struct("label", "v")).alias("a")).select("id", "a.label", "a.v")
    dealt = _in_blocks(spark, chosen, block)
    base = fresh_path(spark, "hard_negatives")
    for b in range(dealt[1]):
        anchors = _block(dealt[0].where(F.col("block") == b), d, positives)
        if not len(anchors.ids):
            continue
        got = search_index(index, d, anchors).select("anchor_id", "id", "score").collect()  # at most BLOCK times ``positives``
        _by_positive(spark, index, d, anchors, got, negatives, low, high).write.parquet(f"{base}/block={b}")
    if not dealt[1]:
        return spark.createDataFrame([], MINED)
    return spark.read.schema(MINED + ", block int").parquet(base).drop("block")


def _in_blocks(spark: SparkSession, anchors: DataFrame, block: int) -> tuple[DataFrame, int]:
    """The anchors with a block number, written by block, and the number of blocks."""
    kept = saved(anchors, "rtree_anchors")
    blocks = -(-kept.count() // block)
    path = fresh_path(spark, "rtree_blocks")
    numbered = kept.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, blocks))).cast("int"))
    numbered.repartition("block").write.partitionBy("block").parquet(path)
    return spark.read.schema("id long, label long, v array<double>, block int").parquet(path), blocks


def _block(rows: DataFrame, d: int, positives: int) -> Anchors:
    got = rows.select("id", "label", "v").orderBy("id").collect()
    most = largest(d)
    with np.errstate(over="ignore"):
        x = np.floor(np.array([r["v"] for r in got], dtype=np.float64).reshape(-1, d) * SCALE)
    return Anchors(np.array([r["id"] for r in got], dtype=np.int64), np.array([r["label"] for r in got], dtype=np.int64),
                   np.clip(x, -most, most).astype(np.int64), [[EVERY] for _ in got], True, positives)


def _by_positive(spark: SparkSession, index: DataFrame, d: int, anchors: Anchors, got: list, negatives: int, low: int, high: int) -> DataFrame:
    """Negatives in the windows of the positives found (anchor_id, id, score)."""
    windows: dict[int, set[tuple[int, int]]] = {}
    known = []
    for r in got:
        lo, hi = window(r["score"], low, high)
        known.append((r["anchor_id"], r["id"], r["score"], lo, hi))
        if lo <= hi:  # positives with equal windows share one
            windows.setdefault(r["anchor_id"], set()).add((lo, hi))
    anchors = Anchors(anchors.ids, anchors.labels, anchors.points, [sorted(windows.get(a, ())) for a in anchors.ids.tolist()], False, negatives)
    hits = search_index(index, d, anchors)
    pairs = spark.createDataFrame(known, "anchor_id long, positive_id long, positive_score long, low long, high long")
    return hits.join(F.broadcast(pairs), ["anchor_id", "low", "high"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
