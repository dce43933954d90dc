"""Hand-made frames for the rules that data rarely shows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.windows import with_emas
from barloom.operators import blends, fill, labels, metrics, quality, reduction, report, splits
from barloom.operators.indicators import kama
from barloom.operators.path_indicators import psar


def bars(spark, rows):
    """(day, high, low, close) rows of one ticker."""
    return spark.createDataFrame([("A", f"2024-01-{d:02d}", *map(float, (c, h, lo, c)), 1.0) for d, h, lo, c in rows], "ticker string, d string, open double, high double, low double, close double, volume double").withColumn("dt", F.to_date("d")).drop("d")


def test_first_hit_same_row_and_truncation(spark):
    b = bars(spark, [(1, 10, 10, 10), (2, 13, 8, 10), (3, 13, 10, 10), (4, 10, 10, 10), (5, 10, 10, 10)])
    got = [r["target_first_hit"] for r in labels.first_hit(b, 2, 0.2, -0.1).orderBy("dt").collect()]
    assert got == [0, 1, -1, -1, -1]
    assert [r["target_path"] for r in labels.path_aware(b, 2, 0.2, -0.1).orderBy("dt").collect()] == [0, 1, 0, 0, 0]
    cut = labels.targets(b, 3, 0.2, -0.1, truncate=False).orderBy("dt").collect()
    assert [r["target_up"] for r in cut] == [1, 1, None, None, None]


def test_fill_orders(spark):
    df = spark.createDataFrame([("A", 1, None), ("A", 2, float("inf")), ("A", 3, 2.0), ("A", 4, None), ("B", 1, None)], "ticker string, dt int, x double")
    get = lambda back: [r["x"] for r in fill.fill_gaps(df, ["x"], back).orderBy("ticker", "dt").collect()]
    assert get(True) == [2.0, 2.0, 2.0, 2.0, 0.0]
    assert get(False) == [0.0, 0.0, 2.0, 2.0, 0.0]


@pytest.mark.parametrize("span", [1, 2, 12, 50, 200, 3000])
def test_ema_against_a_full_recursion(spark, span):
    rng = np.random.default_rng(0)
    x = rng.normal(size=9000).cumsum() * 1e5
    gone = rng.random(9000) < 0.1
    gone[:4] = True
    df = spark.createDataFrame([("A", i, None if gone[i] else float(v)) for i, v in enumerate(x)], "ticker string, dt int, close double")
    got = [r["e"] for r in with_emas(df, {"e": ("close", 2 / (span + 1))}).orderBy("dt").collect()]
    want, e = [], None
    for v, g in zip(x, gone, strict=True):
        e = e if g else v if e is None else e + 2 / (span + 1) * (v - e)
        want.append(e)
    assert got[:4] == [None] * 4 and np.allclose(got[4:], want[4:], rtol=1e-11, atol=1e-6)


def test_average_precision_ties_and_one_class(spark):
    rows = [("a", 0.9, 1), ("a", 0.5, 0), ("a", 0.5, 1), ("a", 0.1, 0), ("b", 0.3, 0), ("b", 0.2, 0)]
    df = spark.createDataFrame(rows, "k string, p double, label int")
    ap = {r["k"]: r["ap"] for r in metrics.average_precision(df, ["k"]).collect()}
    assert ap == pytest.approx({"a": 0.5 * 1 + 0.5 * 2 / 3, "b": 0.0})
    auc = {r["k"]: r["auc"] for r in metrics.roc_auc(df, ["k"]).collect()}
    assert auc == {"a": pytest.approx(0.875), "b": None}
    best = {r["k"]: (r["threshold"], r["f1"]) for r in metrics.threshold_f1(df, ["k"]).collect()}
    assert best["a"] == (0.5, pytest.approx(0.8)) and best["b"] == (0.2, 0.0)


def test_isotonic_pools_violators():
    blocks = blends._pooled([(1.0, 0.0, 0.1, 0.1), (1.0, 1.0, 0.2, 0.2), (3.0, 0.0, 0.3, 0.3), (1.0, 1.0, 0.4, 0.4)])
    assert blocks == [[1.0, 0.0, 0.1, 0.1], [4.0, 1.0, 0.2, 0.3], [1.0, 1.0, 0.4, 0.4]]


def test_isotonic_overwrite_and_coverage(spark):
    rows = [(d, f"t{i}", "up", "m", round(i / 40, 3), int(i * 7 % 40 > 20)) for d in range(6) for i in range(40)]
    scores = spark.createDataFrame(rows, "dt int, ticker string, target string, model string, p double, label int")
    folds = spark.createDataFrame([(0, "train", 0), (0, "train", 1), (0, "test", 3), (0, "test", 4), (1, "train", 2), (1, "test", 4)], "fold int, role string, dt int")
    got = blends.isotonic_oof(scores, folds, 40, 2, 2)
    assert got.count() == len(rows)
    assert {r["dt"] for r in got.where("covered").select("dt").distinct().collect()} == {3, 4}
    assert got.where("not covered and p <> raw").count() == 0
    assert got.where("covered and (p < 0 or p > 1)").count() == 0


def test_trimmed_mean_of_few_models(spark):
    df = spark.createDataFrame([(1, "a", "up", m, p, 1) for m, p in (("x", 0.2), ("y", 0.4))], "dt int, ticker string, target string, model string, p double, label int")
    assert blends.blend_trimmed(df).first()["p"] == pytest.approx(0.3)


def test_weights_and_selection(spark):
    w = blends.random_weights(spark, ["a", "b"], 5)
    assert [round(r["s"], 12) for r in w.groupBy("trial").agg(F.sum("w").alias("s")).collect()] == [1.0] * 5
    rows = [(d, f"t{i}", "up", m, (i / 20 if m == "good" else (i * 7 % 20) / 20), int(i > 12)) for d in range(4) for i in range(20) for m in ("bad", "good")]
    scores = spark.createDataFrame(rows, "dt int, ticker string, target string, model string, p double, label int")
    folds = spark.createDataFrame([(0, "test", 1), (1, "test", 2)], "fold int, role string, dt int")
    assert blends.selection(scores, folds, "up") == {"bad": 0.0, "good": 1.0}


def test_calibration_rules(spark):
    rows = [("A", "t", "few", 1.0, 1.0), ("A", "t", "few", 2.0, 1.0)] + [("A", "t", "flat", float(i), 0.5) for i in range(4)] + [("A", "t", "steep", 5.0 * i, float(i)) for i in range(4)]
    df = spark.createDataFrame(rows, "ticker string, target string, model string, y double, pred double")
    got = {r["model"]: (r["slope"], round(r["intercept"], 9)) for r in quality.linear_calibration(df).collect()}
    assert got == {"few": (1.0, 0.0), "flat": (1.0, 1.0), "steep": (1.8, 0.0)}


def test_quality_reasons(spark):
    rows = [("^X", "t", "low", 0.001, 0.5)] * 3 + [("A.SA", "t", "bad", float(i), 9.0 - i) for i in range(10)]
    got = {r["model"]: r for r in quality.model_quality(spark.createDataFrame(rows, "ticker string, target string, model string, y double, pred double")).collect()}
    assert (got["low"]["quality_score"], got["low"]["is_valid"], got["low"]["reasons"]) == (0.8, True, "low variance")
    assert got["bad"]["reasons"] == "r2,rmse,mae" and got["bad"]["quality_score"] == 0.0 and not got["bad"]["is_valid"]


def test_splits_are_apart(spark):
    days = spark.range(400).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("dt"))
    calendar = splits.purged_split(days)
    guards = splits.split_guards(calendar).first()
    assert guards["enough_history"] and guards["ordered"]
    edge = calendar.groupBy("split").agg(F.min("pos").alias("a"), F.max("pos").alias("b")).collect()
    edge = {r["split"]: (r["a"], r["b"]) for r in edge}
    assert edge["valid"][0] - edge["train"][1] == 31 and edge["apply"] == (395, 399)
    folds = splits.purged_folds(days.limit(60))
    assert folds.groupBy("fold").agg(F.max(F.when(F.col("role") == "train", F.col("dt"))).alias("a"), F.min(F.when(F.col("role") == "test", F.col("dt"))).alias("b")).where("datediff(b, a) < 31").count() == 0
    assert splits.purged_folds(days.limit(20)).where("role = 'test'").count() == 15


def test_decorrelation_keeps_the_first_and_pads(spark):
    ranked = spark.createDataFrame([("A", f, i + 1) for i, f in enumerate("abcd")], "ticker string, feature string, rank int")
    cors = spark.createDataFrame([("A", "a", "b", 0.99), ("A", "b", "c", 0.99), ("A", "a", "d", float("nan"))], "ticker string, a string, b string, r double")
    keep = lambda n: sorted(r["feature"] for r in reduction.decorrelated(ranked, cors.where("not isnan(r)"), 0.9, n).where("kept").collect())
    assert keep(0) == ["a", "c", "d"] and keep(4) == ["a", "b", "c", "d"]


def test_best_model_passes_over_nan(spark):
    df = spark.createDataFrame([("A", "t", "x", 1.0, float("nan"), 0.0), ("A", "t", "z", 1.0, 2.0, 0.0), ("A", "t", "y", 1.0, 2.0, 0.0)], "ticker string, target string, model string, mae double, rmse double, r2 double")
    assert [r["model"] for r in report.best_model_per_ticker(df).collect()] == ["y"]


def test_path_indicators(spark):
    b = bars(spark, [(d, 10.0 + d, 9.0 + d, 9.5 + d) for d in range(1, 21)])
    assert kama(b).where("kama is not null").count() == 11
    assert psar(b).where("psar_up is null").count() == 0 and psar(b.limit(0)).count() == 0


def test_stack_lr_fits_the_last_dates(spark):
    rows = [(d, f"t{i}", "up", m, (i + 0.5) / 20 if m == "good" else (i * 7 % 20 + 0.5) / 20, int(i > 12 or (i + d) % 9 == 0)) for d in range(8) for i in range(20) for m in ("bad", "good")]
    scores = spark.createDataFrame(rows, "dt int, ticker string, target string, model string, p double, label int")
    folds = spark.createDataFrame([(0, "train", 0), (0, "train", 1), (0, "test", 3)], "fold int, role string, dt int")
    past, last = scores.where("dt < 6"), scores.where("dt >= 6").withColumn("label", F.lit(0))
    got = {(r["dt"], r["ticker"]): r["p"] for r in blends.stack_lr(past, folds, min_rows=40, min_pos=5, min_neg=5, apply=last).collect()}
    assert len(got) == 160 and {d for d, _ in got} == set(range(8))
    mean = {(d, t): p for d, t, p in scores.groupBy("dt", "ticker").agg(F.avg("p")).collect()}
    assert all(abs(got[k] - mean[k]) < 1e-9 for k in got if k[0] in (0, 1, 2, 4, 5))
    assert sum(abs(got[k] - mean[k]) > 1e-3 for k in got if k[0] in (3, 6, 7)) > 50
    assert min(got[6, f"t{i}"] for i in range(15, 20)) > 0.5 > max(got[6, f"t{i}"] for i in range(5))
    flat = blends.stack_lr(past.withColumn("label", F.lit(0)), folds, apply=last).where("dt >= 6").collect()
    assert len(flat) == 40 and all(abs(r["p"] - mean[r["dt"], r["ticker"]]) < 1e-9 for r in flat)


def test_stack_query_has_both_targets_and_the_last_dates(spark, sf):
    from barloom.plans import QUERIES
    from barloom.plans.blending import apply_scores, valid_scores

    want = valid_scores(spark, sf).unionByName(apply_scores(spark, sf)).select("dt", "ticker", "target").distinct()
    got = QUERIES["blend_stack_lr"](spark, sf).cache()
    assert {r["target"] for r in got.select("target").distinct().collect()} == {"down", "up"}
    assert got.count() == want.count() and want.join(got, ["dt", "ticker", "target"], "left_anti").count() == 0


def test_isotonic_fit_of_all_rows_for_the_last_dates(spark):
    rows = [(d, f"t{i}", "up", m, round(i / 40, 3), int(m == "m" and i >= 20)) for d in range(3) for i in range(40) for m in ("m", "none")]
    scores = spark.createDataFrame(rows, "dt int, ticker string, target string, model string, p double, label int")
    folds = spark.createDataFrame([(0, "train", 0), (0, "test", 2)], "fold int, role string, dt int")
    got = blends.isotonic_oof(scores.where("dt < 2"), folds, apply=scores.where("dt = 2")).collect()
    assert len(got) == len(rows)
    assert all(r["p"] == (float(r["raw"] >= 0.5) if r["dt"] == 2 and r["model"] == "m" else r["raw"]) for r in got)
    assert {(r["dt"], r["model"]) for r in got if r["covered"]} == {(2, "m")}


def test_scratch_tables_are_deleted(spark):
    from barloom.functions import scratch

    before = spark.conf.get("spark.checkpoint.dir", None)
    one, two = (scratch.cut(spark.range(3), x) for x in ("one", "two"))
    assert one.count() == two.count() == 3 and spark.conf.get("spark.checkpoint.dir", None) == before
    scratch.discard(one, one, spark.range(1))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(one._scratch_path)
    path = two._scratch_path
    scratch.release(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
