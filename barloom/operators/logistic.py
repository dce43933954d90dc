"""Many logistic regressions at once, by Newton steps.

Every row says which fits it belongs to. A pass over the rows adds up, for all fits together, the loss, its gradient and its
second derivatives where each fit stands; the sums of tasks meet by fit, and the driver solves one small system for each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..functions.sums import summed_arrays

#: Passes over the rows at most; ten are many where every step counts.
PASSES = 100
#: A fit is done when no part of its gradient is greater.
TOLERANCE = 1e-10


@dataclass
class LogisticFit:
    """A fit's rows and positives, and its coefficients and constant on features as they are."""

    n: int
    pos: int
    mean: np.ndarray
    scale: np.ndarray
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = 0.0
    passes: int = 0
    converged: bool = False


def balanced(n: int, pos: int) -> tuple[float, float]:
    """Weights of negatives and positives that give both classes half of all weight."""
    return n / (2 * (n - pos)), n / (2 * pos)


def positives_up(n: int, pos: int) -> tuple[float, float]:
    """Positives weigh negatives / positives, 1 at least."""
    return 1.0, max(1.0, (n - pos) / max(pos, 1))


def _by_fit(rows: DataFrame, ids: list[int], of: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """For each fit the sum over its rows of what `of` makes of a batch's features and labels."""
    ship(rows.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column("x").flatten(), float).reshape(batch.num_rows, -1)
            y = np.asarray(batch.column("label"), float)
            member = batch.column("fits")
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(member.value_lengths().fill_null(0), np.int64))
            fit = np.asarray(member.flatten(), np.int64)
            order = np.argsort(fit, kind="stable")
            fit, owner = fit[order], owner[order]
            begins = np.flatnonzero(np.concatenate(([True], fit[1:] != fit[:-1]))) if len(fit) else []
            for f, some in zip(fit[begins].tolist(), np.split(owner, begins[1:]), strict=True) if len(fit) else ():
                if f in wanted:
                    part = of(f, x[some], y[some])
                    totals[f] = totals[f] + part if f in totals else part
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(list(totals.values()), pa.list_(pa.float64()))], names=["fit", "sums"])

    wanted = set(ids)
    parts = rows.select("x", F.col("label").cast("double").alias("label"), F.col("fits").cast("array<int>").alias("fits")).mapInArrow(task, "fit int, sums array<double>")
    return {r["fit"]: np.array(r["sums"]) for r in summed_arrays(parts, ["fit"], "sums").collect()}


def fit_many(rows: DataFrame, penalties: dict[int, float], weigh: Callable[[int, int], tuple[float, float]] = balanced, passes: int = PASSES) -> dict[int, LogisticFit]:
    """Fits of label (0 or 1) on x (array of doubles without nulls) by id: each on the rows whose array `fits` names it.

    A fit minimises the weighted mean of its log losses plus penalty / 2 times the squares of its coefficients, features
    scaled by its own rows' mean and population deviation, the constant without penalty. Rows are read once for the scale
    and once a pass, so they should be a table. A fit of one class, or of no rows, has no result. What comes to the driver
    is one matrix of the features for each fit, whatever the number of rows.
    """
    first = rows.select("x").first()
    if first is None:
        return {}
    zero, k = np.array(first["x"], float), len(first["x"])

    def moments(f: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.concatenate(([len(x), y.sum()], (x - zero).sum(axis=0), ((x - zero) ** 2).sum(axis=0)))

    fits: dict[int, LogisticFit] = {}
    for f, m in _by_fit(rows, list(penalties), moments).items():
        n, pos = int(m[0]), int(m[1])
        if 0 < pos < n:
            off = m[2 : 2 + k] / n
            variance = np.maximum(m[2 + k :] / n - off * off, 0)
            flat = variance <= 1e-14 * np.maximum(m[2 + k :] / n, 1e-300)
            fits[f] = LogisticFit(n, pos, zero + off, np.where(flat, 1.0, np.sqrt(np.where(flat, 1.0, variance))))
    weights = {f: weigh(fit.n, fit.pos) for f, fit in fits.items()}
    whole = {f: (fit.n - fit.pos) * weights[f][0] + fit.pos * weights[f][1] for f, fit in fits.items()}
    at = {f: np.zeros(k + 1) for f in fits}  # the constant last
    stood: dict[int, tuple[np.ndarray, float, np.ndarray]] = {}  # where a step began, its loss, and the step
    upper = np.triu_indices(k + 1)

    def pass_of(f: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = np.column_stack(((x - fits[f].mean) / fits[f].scale, np.ones(len(x))))
        eta = z @ at[f]
        w = np.where(y > 0, weights[f][1], weights[f][0]) / whole[f]
        p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
        loss = w @ (np.logaddexp(0, eta) - y * eta)
        return np.concatenate(([loss], z.T @ (w * (p - y)), (z.T @ (z * (w * p * (1 - p))[:, None]))[upper]))

    open_ = set(fits)
    for _ in range(passes):
        if not open_:
            break
        for f, s in _by_fit(rows, sorted(open_), pass_of).items():
            beta, ridge = at[f], np.append(np.full(k, float(penalties[f])), 0.0)
            loss = s[0] + (ridge * beta * beta).sum() / 2
            gradient = s[1 : k + 2] + ridge * beta
            fits[f].passes += 1
            if f in stood and loss > stood[f][1] + 1e-12 * abs(stood[f][1]) and np.abs(stood[f][2]).max() > 1e-12:
                begin, before, step = stood[f]  # too far: half the way
                stood[f] = begin, before, step / 2
                at[f] = begin + step / 2
                continue
            if np.abs(gradient).max() <= TOLERANCE:
                fits[f].converged = True
                open_.discard(f)
                continue
            second = np.zeros((k + 1, k + 1))
            second[upper] = s[k + 2 :]
            second = second + np.triu(second, 1).T + np.diag(ridge)
            step = -np.linalg.lstsq(second, gradient, rcond=1e-14)[0]
            stood[f] = beta, loss, step
            at[f] = beta + step
    for f, fit in fits.items():
        fit.coefficients = at[f][:k] / fit.scale
        fit.intercept = float(at[f][k] - fit.coefficients @ fit.mean)
    return fits


def table(rows: DataFrame, fits: dict[int, LogisticFit]) -> DataFrame:
    """fit, intercept, coefficients as a DataFrame of rows' session."""
    made = [(f, fit.intercept, fit.coefficients.tolist()) for f, fit in sorted(fits.items())]
    return rows.sparkSession.createDataFrame(made, "fit int, intercept double, coefficients array<double>")


def probability(x: Column | str = "x", coefficients: Column | str = "coefficients", intercept: Column | str = "intercept") -> Column:
    """What a fit says of the features x."""
    c = lambda v: F.col(v) if isinstance(v, str) else v
    eta = F.aggregate(F.zip_with(c(x), c(coefficients), lambda a, b: a * b), c(intercept), lambda s, v: s + v)
    return 1 / (1 + F.exp(-eta))
