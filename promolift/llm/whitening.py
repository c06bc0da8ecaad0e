"""Whitening of embeddings from a covariance found by polarisation.

Every entry becomes an integer x, so sums of squares are exact. For each
dimension i and each pair (i, j) the tasks add up the squares of the centred
values z_i and of the centred pair sums z_i + z_j; differences of these variances give
the cross-covariances,

    cov(i, j) = (var(i + j) - var(i) - var(j)) / 2,

exactly, as ratios of integers, and the matrix goes to ``eigh`` on the driver.

Values are centred before they are multiplied: z = x - m with m the whole part
of the mean, and the rest of the mean (r / n, r = S - n m, under 1) is taken off
exactly afterwards: the sum of (n x - S)^2 is n^2 sum(z^2) - n r^2.

How it runs: narrow passes over the vectors (sums; pair sums; covariance of the
whitened values; output), each task giving one number for every dimension
pair, which are added up by a grouped aggregation. What reaches the driver is d (d + 1) / 2 numbers for
vectors of d dimensions, however many vectors there are. Sums travel as
four 40-bit parts, so no sum overflows.

Defined results: vectors that are null, empty, or hold a null or non-finite
entry are dropped, as are those of another length than the commonest (ties:
the greater). Scaled entries beyond +-2^61 are held there. Repeated rows count
each; a null id is kept. ``deviation`` is null where the exact value is beyond a
long. A component without variance (a flat or repeated direction, a single vector)
has null whitened values and takes no part in ``identity_error``, which
is null if no component has any. Equal eigenvalues come in the order ``eigh`` gives.
An empty table gives an empty result. Only the id and the vector are
read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolift.llm.common import ready

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Scaled entries are held within this.
LARGEST = 1 << 61
_PART = 40  # bits of a part of a sum
_PARTS = 4


def valid_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v) of the rows whose vector is there, not empty and finite throughout."""
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v")) \
        .where((F.size("v") > 0) & finite)


def of_one_length(vectors: DataFrame) -> tuple[DataFrame, int, int]:
    """The vectors of the commonest length, that length and their number."""
    top = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d, n = (int(top[0]["d"]), int(top[0]["count"])) if top else (0, 0)
    return vectors.where(F.size("v") == d), d, n


def entries(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """Integer entries (rows x d) of a batch."""
    with np.errstate(over="ignore"):
        scaled = np.floor(batch.column("v").flatten().to_numpy(zero_copy_only=False) * SCALE)
    return np.clip(scaled, -LARGEST, LARGEST).astype(np.int64).reshape(-1, d) + SHIFT


def _safe(a: np.ndarray, most: int) -> np.ndarray:
    """``a`` as it is if ``most``, a bound of every sum to be made of it, fits a long; else as Python integers."""
    return a if most < 1 << 62 else a.astype(object)


def pair_index(d: int) -> np.ndarray:
    """Place of each pair (i <= j) in the list of sums."""
    at = np.zeros((d, d), dtype=np.int64)
    i, j = np.triu_indices(d)
    at[i, j] = at[j, i] = np.arange(len(i))
    return at


def squares(z: np.ndarray) -> np.ndarray:
    """Sums over the rows of z_i^2 (i = j) and (z_i + z_j)^2 (i < j), pairs row by row."""
    z = _safe(z, 4 * int(np.abs(z).max(initial=0)) ** 2 * len(z))
    out = []
    for i in range(z.shape[1]):
        t = z[:, i:] + z[:, i:i + 1]
        t[:, 0] = z[:, i]
        out.append((t * t).sum(axis=0))
    return np.concatenate(out)


def exact_totals(vectors: DataFrame, d: int, size: int, measure: Callable[[np.ndarray], np.ndarray]) -> list[int]:
    """Sums of ``measure`` (``size`` integers of a matrix of entries) over all vectors, as Python integers."""
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=object)
        for batch in batches:
            if batch.num_rows:
                total = total + measure(entries(batch, d)).astype(object)
        parts = {"k": pa.array(np.arange(size), pa.int64())}
        for p in range(_PARTS):
            last = p == _PARTS - 1
            parts[f"p{p}"] = pa.array([int(t) >> _PART * p if last else (int(t) >> _PART * p) & ((1 << _PART) - 1) for t in total], pa.int64())
        yield pa.RecordBatch.from_pydict(parts)
    names = [f"p{p}" for p in range(_PARTS)]
    rows = vectors.select("v").mapInArrow(tasks, "k long, " + ", ".join(f"{p} long" for p in names))
    found = rows.groupBy("k").agg(*[F.sum(p).alias(p) for p in names]).collect()  # ``size`` rows, whatever the input
    out = [0] * size
    for r in found:
        out[r["k"]] = sum(r[name] << _PART * p for p, name in enumerate(names))
    return out


@dataclass
class Whitener:
    d: int
    n: int
    middle: np.ndarray       # whole part of each mean
    rest: list[int]          # S - n * middle
    components: np.ndarray   # d x k, unit eigenvectors, falling eigenvalue
    values: np.ndarray       # k eigenvalues
    explained: np.ndarray    # k shares of the trace
    identity_error: float | None = None

    @property
    def alive(self) -> np.ndarray:
        """Components with variance beyond rounding."""
        return self.values > self.values[:1].max(initial=0.0) * self.d * np.finfo(float).eps

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Whitened values (rows x k); NaN for components without variance."""
        centred = (x - self.middle) - np.array([r / self.n for r in self.rest])
        scale = np.where(self.alive, np.sqrt(np.where(self.alive, self.values, 1.0)), np.nan)
        return centred @ self.components / scale

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; None beyond a long."""
        z = x - self.middle
        z = _safe(z, self.d * (self.n * (int(np.abs(z).max(initial=0)) + 1)) ** 2)
        y = z * self.n - np.array(self.rest, dtype=z.dtype)
        return [v if v < 1 << 63 else None for v in map(int, (y * y).sum(axis=1))]


def covariance(totals: list[int], rest: list[int], n: int, d: int) -> np.ndarray:
    """V from the sums of squares: exact integers up to one division each."""
    at = pair_index(d)
    own = [n * n * totals[at[i, i]] - n * rest[i] ** 2 for i in range(d)]  # sum of (n x_i - S_i)^2
    v = np.zeros((d, d))
    for i in range(d):
        v[i, i] = own[i] / n ** 3
        for j in range(i + 1, d):
            both = n * n * totals[at[i, j]] - n * (rest[i] + rest[j]) ** 2
            v[i, j] = v[j, i] = (both - own[i] - own[j]) / (2 * n ** 3)
    return v


def fit(vectors: DataFrame, d: int, n: int, components: int = COMPONENTS) -> Whitener:
    """Mean, covariance by polarisation and eigenvectors of all ``n`` vectors of ``d`` entries."""
    sums = exact_totals(vectors, d, d, lambda x: _safe(x, (LARGEST + SHIFT) * len(x) if np.abs(x).max() > 1 << 40 else 0).sum(axis=0))
    whole = [s // n for s in sums]
    rest = [s - n * m for s, m in zip(sums, whole, strict=True)]
    middle = np.array(whole, dtype=np.int64)
    v = covariance(exact_totals(vectors, d, d * (d + 1) // 2, lambda x: squares(x - middle)), rest, n, d)
    values, vectors_ = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    trace = float(np.trace(v))
    values = np.maximum(values[order], 0.0)
    return Whitener(d, n, middle, rest, vectors_[:, order], values, values / trace if trace else np.zeros(len(order)))


def identity_error(vectors: DataFrame, model: Whitener) -> float | None:
    """Largest absolute entry of the whitened values' covariance minus the identity, measured over all vectors."""
    alive = np.flatnonzero(model.alive)
    k, d = len(alive), model.d
    if not k:
        return None
    i, j = np.triu_indices(k)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = model.whiten(entries(batch, d))[:, alive]  # centred already
                first += w.sum(axis=0)
                second += w.T @ w
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(np.concatenate([np.arange(k), i]), pa.int64()),
            "j": pa.array(np.concatenate([np.full(k, -1), j]), pa.int64()),
            "s": pa.array(np.concatenate([first, second[i, j]]))})
    found = vectors.select("v").mapInArrow(tasks, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    mean, cov = np.zeros(k), np.zeros((k, k))
    for r in found:
        if r["j"] < 0:
            mean[r["i"]] = r["s"] / model.n
        else:
            cov[r["i"], r["j"]] = r["s"] / model.n
    cov -= np.triu(np.outer(mean, mean))  # what rounding left of the mean
    return float(np.abs(cov - np.eye(k)).max())


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def transform(vectors: DataFrame, model: Whitener) -> DataFrame:
    """One row for each vector and component."""
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            x = entries(batch, model.d)
            w = model.whiten(x).reshape(-1)
            each = np.repeat(np.arange(rows), k)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("id").take(pa.array(each)),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                "n": pa.array(np.full(rows * k, model.n, dtype=np.int64)),
                "deviation": pa.array(model.deviation(x), pa.int64()).take(pa.array(each)),
                "whitened": pa.array(w, mask=np.isnan(w)),
                "explained": pa.array(np.tile(model.explained, rows)),
                "identity_error": pa.array([model.identity_error] * (rows * k), pa.float64())})
    return vectors.mapInArrow(tasks, WHITENED)


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened values of every valid vector, fitted on all of them."""
    spark = df.sparkSession
    ready(spark)
    vectors, d, n = of_one_length(valid_vectors(df, id_col, vec_col))
    if not n:
        return spark.createDataFrame([], WHITENED)
    model = fit(vectors, d, n, components)
    model.identity_error = identity_error(vectors, model)
    return transform(vectors, model)
