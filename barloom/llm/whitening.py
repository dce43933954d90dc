"""Whitening of embeddings: the leading components of their covariance, each scaled to unit variance.

Entries become whole numbers first, so that sums, and how far a vector is from the mean, are exact. Sums and centred
products are added up in tasks and merged by row of the matrix; the driver holds one matrix of dimensions squared, brings it
to tridiagonal form by Householder reflections, finds the leading eigenvalues by bisection on Sturm counts, and their
vectors by inverse iteration, orthogonal to earlier ones of a cluster. What tasks get back is the few components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches

COMPONENTS = 4
#: An entry c counts as floor(SCALE * c).
SCALE = 256
#: Eigenvalues closer than this share of the greatest are a cluster; those below NOTHING of it, times the dimensions, are 0.
CLUSTER, NOTHING = 1e-3, 4 * np.finfo(float).eps


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflectors) of the tridiagonal matrix similar to symmetric a, by Householder reflections."""
    a, d = a.copy(), len(a)
    reflectors = []
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        v[0] += size if v[0] >= 0 else -size
        length = np.linalg.norm(v)
        if length > 0:
            v /= length
            # (1 - 2vv') A (1 - 2vv') = A - 2(vw' + wv') with w = Av - (v'Av)v.
            w = a[k + 1 :, k + 1 :] @ v
            w -= (v @ w) * v
            a[k + 1 :, k + 1 :] -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1, k] = a[k, k + 1] = -size if a[k + 1, k] >= 0 else size
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def below(diagonal: np.ndarray, squares: np.ndarray, x: np.ndarray, tiny: float) -> np.ndarray:
    """How many eigenvalues of a tridiagonal matrix are less than each of x: the sign changes of its Sturm sequence."""
    count, q = np.zeros(len(x), int), np.ones(len(x))
    for k in range(len(diagonal)):
        q = diagonal[k] - x - (squares[k - 1] / q if k else 0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k greatest eigenvalues, falling, by bisection to the last bit that doubles tell apart."""
    reach = np.abs(np.concatenate(([0], off))) + np.abs(np.concatenate((off, [0])))
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    tiny = np.finfo(float).tiny / np.finfo(float).eps * max(1.0, float((off * off).max(initial=0)))
    wanted = len(diagonal) - np.arange(k)  # the j-th greatest has fewer than this many below it
    while True:
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            return high
        less = below(diagonal, off * off, middle, tiny) < wanted
        low, high = np.where(less, middle, low), np.where(less, high, middle)


def _solved(diagonal: np.ndarray, off: np.ndarray, shift: float, y: np.ndarray, least: float) -> np.ndarray:
    """The solution of (T - shift) z = y by elimination with row exchanges; pivots are `least` in size at least."""
    d, n = (diagonal - shift).tolist(), len(diagonal)
    below_, above = off.tolist(), [*off.tolist(), 0.0]
    second, y = [0.0] * n, y.tolist()
    for k in range(n - 1):
        if abs(d[k]) < abs(below_[k]):
            d[k], below_[k] = below_[k], d[k]
            above[k], d[k + 1] = d[k + 1], above[k]
            second[k], above[k + 1] = above[k + 1], 0.0
            y[k], y[k + 1] = y[k + 1], y[k]
        if abs(d[k]) < least:
            d[k] = least
        m = below_[k] / d[k]
        d[k + 1] -= m * above[k]
        above[k + 1] -= m * second[k]
        y[k + 1] -= m * y[k]
    if abs(d[-1]) < least:
        d[-1] = least
    z = [0.0] * (n + 2)
    for k in range(n - 1, -1, -1):
        z[k] = (y[k] - above[k] * z[k + 1] - second[k] * z[k + 2]) / d[k]
    return np.array(z[:n])


def leading_pairs(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, unit vectors as rows) of the k greatest eigenvalues of symmetric a, falling.

    Inverse iteration starts from a fixed vector; within a cluster of eigenvalues each vector is kept orthogonal to those
    before it at every step. Vectors of equal eigenvalues are one of many bases.
    """
    k, scale = min(k, len(a)), float(np.abs(a).max(initial=0))
    if scale == 0:
        return np.zeros(k), np.eye(k, len(a))
    diagonal, off, reflectors = tridiagonal(a / scale)
    values = leading_values(diagonal, off, k)
    size = float(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0))
    eps = np.finfo(float).eps
    found: list[np.ndarray] = []
    start = np.random.default_rng(7)
    for j, value in enumerate(values):
        alike = [found[i] for i in range(j) if values[i] - value < CLUSTER * size]
        z = start.standard_normal(len(a))
        for _ in range(5):
            for _ in range(2):
                for other in alike:
                    z -= (other @ z) * other
            z /= np.linalg.norm(z)
            z = _solved(diagonal, off, value + eps * size * (len(alike) + 1), z, eps * size)
        for _ in range(2):
            for other in alike:
                z -= (other @ z) * other
            z /= np.linalg.norm(z)
        found.append(z)
    out = np.array(found).reshape(k, len(a))
    for at in range(len(reflectors) - 1, -1, -1):
        v = reflectors[at]
        out[:, at + 1 :] -= 2 * np.outer(out[:, at + 1 :] @ v, v)
    return values * scale, out / np.linalg.norm(out, axis=1)[:, None]


@dataclass
class Whitening:
    """What is learned: n fit vectors, their exact sums, the components' variances and unit vectors, and the whole variance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows of x, whole numbers, on each component."""
        return (x - self.mean) @ self.vectors.T / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """For each row the sum over dimensions of (n x - sum)^2, exact; None where it is no 64-bit number."""
        most = max([abs(s) for s in self.sums] + [self.n * int(np.abs(x).max(initial=0))])
        if most < 1 << 61 and len(self.sums) * (2 * most) ** 2 < 1 << 63:
            off = self.n * x - np.array(self.sums, np.int64)
            return (off * off).sum(axis=1).tolist()
        rows = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [r if r < 1 << 63 else None for r in rows]


def whole(vector: Column) -> Column:
    """The vector's entries as whole numbers; null where it is null, empty, or has a null or non-finite entry."""
    fine = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    return F.when((F.size(vector) > 0) & fine, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE)))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, d)


def _added(rows: DataFrame, d: int) -> DataFrame:
    """(i, row): the sum of all rows with each i, arrays of d doubles."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            values = np.asarray(batch.column("row").flatten(), float).reshape(-1, d)
            for i, row in zip(batch.column("i").to_pylist(), values, strict=True):
                total[i] = total[i] + row if i in total else row.copy()
        if total:
            yield pa.RecordBatch.from_pylist([{"i": i, "row": r.tolist()} for i, r in sorted(total.items())], pa.schema([("i", pa.int32()), ("row", pa.list_(pa.float64()))]))

    return map_batches(rows.repartition("i"), add, "i int, row array<double>")


def _summed(fit: DataFrame, d: int, of) -> np.ndarray:
    """The sum over all batches of fit of the matrices `of` makes from a batch's vectors: one for each task, merged by row."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                made = of(_matrix(batch.column("x"), d))
                total = made if total is None else total + made
        if total is not None:
            width = total.shape[1]
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1) * width, pa.int32()), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), rows], names=["i", "row"])

    parts = map_batches(fit, part, "i int, row array<double>")
    width = len(of(np.zeros((1, d), np.int64))[0])
    return np.array([r["row"] for r in _added(parts, width).orderBy("i").collect()])


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of a column, as whole numbers; None where there is none.

    Vectors have one length: that of most distinct vectors, the shorter on ties; others take no part. Components whose
    variance is nothing but rounding aren't there, so fewer than asked for may come. The driver gets sums and the matrix of
    products, whose size hangs on the dimensions alone.
    """
    distinct = cut(vectors.select(whole(F.col(column)).alias("x")).where("x is not null").distinct(), "whole-vectors")
    first = distinct.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if first is None:
        return None
    d, n = first["d"], first["n"]
    rows = distinct.where(F.size("x") == d)

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            high, low = high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array(high), pa.array(low)], names=["i", "high", "low"])

    # Whole numbers add up in two halves, which longs hold for two billion vectors.
    halved = map_batches(rows, halves, "i int, high long, low long").groupBy("i").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    sums = [r["high"] * (1 << 32) + r["low"] for r in halved.orderBy("i").collect()]
    mean = np.array([s / n for s in sums])

    def centred(x: np.ndarray) -> np.ndarray:
        z = x - mean
        return z.T @ z

    covariance = _summed(rows, d, centred) / n
    trace = float(np.trace(covariance))
    values, units = leading_pairs(covariance, components)
    some = values > NOTHING * d * max(trace, np.finfo(float).tiny)
    found = Whitening(n, sums, values[some], units[some], trace)
    if some.any():

        def measured(x: np.ndarray) -> np.ndarray:
            w = found.whitened(x)
            return np.vstack((w.T @ w, w.sum(axis=0)))

        k = int(some.sum())
        totals = _summed(rows, d, measured) / n
        found.identity_error = float(np.abs(totals[:k] - np.outer(totals[k], totals[k]) - np.eye(k)).max())
    return found


def project(vectors: DataFrame, whitening: Whitening | None, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained, identity_error for each vector and component.

    Vectors that are null or empty, of another length or with a null or non-finite entry have no row; every other row has,
    repeats too. deviation is null where it is no 64-bit number. Other columns take no part.
    """
    rows = vectors.select(F.col(key).alias("key"), whole(F.col(column)).alias("x"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if whitening is None or not len(whitening.values):
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    d, k = len(whitening.sums), len(whitening.values)
    shared = rows.sparkSession.sparkContext.broadcast(whitening)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            each = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), w.n)),
                    pa.array(w.deviations(x), pa.int64()).take(pa.array(each)),
                    pa.array(w.whitened(x).ravel()),
                    pa.array(np.tile(w.values / w.trace, len(x))),
                    pa.array(np.full(len(each), w.identity_error)),
                ],
                names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return map_batches(rows.where(F.size("x") == d), task, schema).withColumnRenamed("key", key)


def whiten(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """The vectors of a table, whitened by what that table says; see `fit` and `project`. No rows: none."""
    return project(vectors, fit(vectors, column, components), column, key)
