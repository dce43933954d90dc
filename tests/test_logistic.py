"""Batched logistic regressions against Spark ML, one fit after another."""

import datetime

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from barloom.functions.sums import summed_arrays
from barloom.operators import blends
from barloom.operators import logistic as log


def by_spark(rows, penalty, weigh):
    """Coefficients and constant of Spark ML on features scaled by the population."""
    x = np.array([r["x"] for r in rows.collect()])
    y = np.array([r["label"] for r in rows.collect()])
    mean, scale = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    w0, w1 = weigh(len(y), int(y.sum()))
    scaled = rows.sparkSession.createDataFrame([(((a - mean) / scale).tolist(), float(b), float(w1 if b else w0)) for a, b in zip(x, y, strict=True)], "x array<double>, label double, w double")
    model = LogisticRegression(weightCol="w", regParam=penalty, standardization=False, maxIter=500, tol=1e-14).fit(scaled.withColumn("features", array_to_vector("x")))
    beta = model.coefficients.toArray() / scale
    return beta, model.intercept - beta @ mean


def test_fits_equal_those_of_spark_ml(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 3)) * [1, 100, 0.01] + [0, 5000, 3]
    x = np.column_stack((x, x[:, 0] + x[:, 1] / 100, np.full(600, 7.0)))  # one that others make up, one without variance
    y = (x[:, 0] + (x[:, 1] - 5000) / 100 + rng.normal(size=600) > 1).astype(int)
    fits = [[k for k in (0, 1, 2, 9) if i % (k + 2) or k == 9] for i in range(600)]
    df = spark.createDataFrame([(a.tolist(), int(b), f) for a, b, f in zip(x, y, fits, strict=True)], "x array<double>, label int, fits array<int>").repartition(5).cache()
    penalties = {0: 1e-3, 1: 0.5, 2: 1 / 400, 5: 1.0, 9: 1e-4}
    for weigh in (log.balanced, log.positives_up):
        found = log.fit_many(df, penalties, weigh)
        assert set(found) == {0, 1, 2, 9}
        for k, fit in found.items():
            own = df.where(F.array_contains("fits", k))
            beta, constant = by_spark(own, penalties[k], weigh)
            assert fit.converged and fit.passes <= 12 and fit.n == own.count()
            got = np.array([r["p"] for r in own.withColumn("p", log.probability("x", F.array(*map(F.lit, fit.coefficients.tolist())), F.lit(fit.intercept))).collect()])
            want = 1 / (1 + np.exp(-(np.array([r["x"] for r in own.collect()]) @ beta + constant)))
            assert np.abs(got - want).max() < 1e-6


def test_one_class_no_rows_and_separable_rows(spark):
    schema = "x array<double>, label int, fits array<int>"
    rows = [([float(i)], int(i > 4), [0, 1]) for i in range(10)] + [([1.0], 1, [2]), ([0.5], 0, None)]
    found = log.fit_many(spark.createDataFrame(rows, schema), {0: 1e-6, 1: 0.1, 2: 0.1})
    assert set(found) == {0, 1} and all(f.converged for f in found.values())
    assert found[0].coefficients[0] > found[1].coefficients[0] > 0
    assert log.fit_many(spark.createDataFrame([], schema), {0: 1.0}) == {}


def test_sums_of_arrays(spark):
    rows = [("a", 1, [1.0, 2.0]), ("a", 1, [3.0, 4.0]), ("b", 1, None), ("a", 2, [5.0]), (None, None, [1.0]), (None, None, [2.0]), ("a", 1, None)]
    out = summed_arrays(spark.createDataFrame(rows, "k string, `a b` int, v array<double>").repartition(5), ["k", "a b"], "v").collect()
    assert sorted(map(tuple, out), key=str) == sorted([("a", 1, [4.0, 6.0]), ("b", 1, []), ("a", 2, [5.0]), (None, None, [3.0])], key=str)


@pytest.mark.parametrize("gate", [40, 10_000])
def test_stacking_by_hand(spark, gate):
    """Later folds win, gates hold, other dates keep the mean, later dates get the fit on all."""
    rng, day = np.random.default_rng(6), datetime.date(2024, 1, 1)
    dates = [day + datetime.timedelta(days=k) for k in range(14)]
    rows, truth = [], {}
    for target in ("up", "down"):
        for d in dates:
            for t in range(8):
                p = rng.random(3).round(3)
                label = int(p[0] + rng.random() > (1.0 if target == "up" else 0.7))
                truth[d, f"t{t}", target] = p, label
                rows += [(d, f"t{t}", target, m, float(v), label) for m, v in zip(("m1", "m2", "m3"), p, strict=True)]
    df = spark.createDataFrame(rows, "dt date, ticker string, target string, model string, p double, label int")
    parts = [(0, "train", d) for d in dates[:4]] + [(0, "test", d) for d in dates[6:9]] + [(1, "train", d) for d in dates[:6]] + [(1, "test", d) for d in dates[8:11]]
    folds = spark.createDataFrame(parts, "fold int, role string, dt date")
    known, later = df.where(F.col("dt") < dates[12]), df.where(F.col("dt") >= dates[12])
    out = {(r["dt"], r["ticker"], r["target"]): r["p"] for r in blends.stack_lr(known, folds, min_rows=gate, min_pos=5, min_neg=5, apply=later).collect()}
    assert set(out) == set(truth)

    def described(p):
        return [*p, p.mean(), p.std(), p.min(), p.max(), p.max() - p.min(), (p >= 0.5).sum(), *(p - p.mean())]

    for target in ("up", "down"):
        used = {None: (dates[:12], dates[12:])}
        if gate == 40:  # 32 rows are too few for fold 0
            used[1] = dates[:6], dates[8:11]
        left = set(dates[:12])
        for train, test in used.values():
            x = np.array([described(p) for (d, _, t), (p, _) in truth.items() if t == target and d in train])
            y = np.array([y for (d, _, t), (_, y) in truth.items() if t == target and d in train])
            one = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y, strict=True)], "x array<double>, label int")
            beta, constant = by_spark(one, 1 / len(y), log.balanced)
            for (d, ticker, t), (p, _) in truth.items():
                if t == target and d in test:
                    assert out[d, ticker, t] == pytest.approx(1 / (1 + np.exp(-(np.array(described(p)) @ beta + constant))), abs=1e-6)
            left -= set(test)
        for (d, ticker, t), (p, _) in truth.items():
            if t == target and d in left:
                assert out[d, ticker, t] == pytest.approx(p.mean(), abs=1e-9)
