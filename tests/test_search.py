"""First hits, isotonic fits and the weight search against plain loops."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import blends, labels


@pytest.mark.parametrize("horizon", [1, 30, 90, 1000])
def test_first_hits(spark, horizon):
    rng, day = np.random.default_rng(horizon), datetime.date(2000, 1, 1)
    rows = []
    for ticker, n in (("a", 2500), ("b", 1), ("c", 40), (None, 5)):
        close = np.exp(np.cumsum(rng.normal(size=n) / 20))
        high, low = close * (1 + rng.random(n) / 50), close * (1 - rng.random(n) / 50)
        rows += [(ticker, day + datetime.timedelta(days=i), float(h) if i % 37 else None, float(x), float(c) if i % 41 else None, "x") for i, (h, x, c) in enumerate(zip(high, low, close, strict=True))]
    df = spark.createDataFrame(rows, "ticker string, dt date, high double, low double, close double, extra string").repartition(3)
    want = {}
    for t in ("a", "b", "c", None):
        own = [r for r in rows if r[0] == t]
        for i, r in enumerate(own):
            ahead = own[i + 1 : i + 1 + horizon]
            up = next((k + 1 for k, x in enumerate(ahead) if r[4] and x[2] and x[2] >= r[4] * 1.1), 0)
            want[t, r[1]] = up, next((k + 1 for k, x in enumerate(ahead) if r[4] and x[3] <= r[4] * 0.95), 0)
    got = labels.hit_rows(df, horizon, 0.1, -0.05)
    assert got.columns == [*df.columns, "up_row", "down_row"]
    assert {(r["ticker"], r["dt"]): (r["up_row"], r["down_row"]) for r in got.collect()} == want
    assert labels.hit_rows(df.limit(0), horizon, 0.1, -0.05).collect() == []


def minimax(p, n, pos):
    """The isotonic fit by its formula."""
    c, d = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(pos)))
    mean = lambda a, b: (d[b + 1] - d[a]) / (c[b + 1] - c[a])
    return [max(min(mean(a, b) for b in range(i, len(p))) for a in range(i + 1)) for i in range(len(p))]


def test_isotonic_fits_by_ranges(spark):
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for g in ("one", "two", "flat", "single"):
        p = np.sort(rng.choice(2000, size={"single": 1}.get(g, 70), replace=False)) / 2000
        n = rng.integers(1, 4, size=len(p))
        pos = np.array([rng.binomial(k, q if g != "flat" else 0.5) for k, q in zip(n, p, strict=True)])
        rows += [(g, float(a), int(b), int(c)) for a, b, c in zip(p, n, pos, strict=True)]
        want[g] = p, np.array(minimax(p, n, pos))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        points = spark.createDataFrame(rows, "g string, p double, n int, pos int").repartition(5)
        fits = blends.isotonic_fits(points, ["g"]).cache()
        asked = [(g, float(x)) for g in (*want, "absent") for x in [*rng.random(60), *want.get(g, ([], 0))[0], -1.0, 2.0]]
        got = blends.isotonic_values(fits, spark.createDataFrame(asked, "g string, p double"), ["g"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r["g"] for r in got} == set(want) and len(got) == len({x for x in asked if x[0] != "absent"})
    for r in got:
        p, value = want[r["g"]]
        assert r["fitted"] == pytest.approx(float(np.interp(r["p"], p, value)), abs=1e-12)
    assert blends.isotonic_fits(points.limit(0), ["g"]).collect() == []


def test_precisions_with_ties():
    rng = np.random.default_rng(1)
    p, y, w = rng.integers(0, 6, size=(40, 7)) / 5, rng.integers(0, 2, size=40).astype(float), rng.random(40)
    for weight in (np.ones(40), w):
        want = []
        for k in range(7):
            total, seen, good = (weight * y).sum(), 0.0, 0.0
            ap = 0.0
            for s in sorted(set(p[:, k]), reverse=True):
                here = p[:, k] == s
                seen, gain = seen + weight[here].sum(), (weight * y)[here].sum()
                good += gain
                ap += gain / total * good / seen
            want.append(ap)
        assert blends.precisions(p, y, weight) == pytest.approx(want, abs=1e-12)
    assert blends.precisions(p, np.zeros(40), w).tolist() == [0.0] * 7


def test_search_doesnt_hang_on_block_size(spark, monkeypatch):
    rng, day = np.random.default_rng(2), datetime.date(2024, 1, 1)
    rows = [(day + datetime.timedelta(days=d), f"t{t}", "up", m, float(np.round(rng.uniform(0.01, 0.99), 2)), int((t + d) % 3 == 0)) for d in range(6) for t in range(12) for m in ("a", "b")]
    df = spark.createDataFrame(rows, "dt date, ticker string, target string, model string, p double, label int")
    folds = spark.createDataFrame([(f, "test", day + datetime.timedelta(days=d)) for f in range(3) for d in range(f, f + 3)], "fold int, role string, dt date")
    found = []
    for cells in (1, 1 << 22):
        monkeypatch.setattr(blends, "CELLS", cells)
        found.append(sorted(map(tuple, blends.weight_search(df, folds, 25).collect())))
    assert found[0] == found[1] and len(found[0]) == 2
    assert blends.weight_search(df.where(F.col("p") > 2), folds, 5).collect() == []


def test_ranges_follow_the_scores(spark):
    """Scores crowded below 1e-4 are dealt evenly, and the sums are those of one window."""
    from barloom.operators import metrics

    rng = np.random.default_rng(5)
    rows = [("a", float(x) * 1e-4, int(y)) for x, y in zip(rng.random(8000), rng.random(8000) < 0.1, strict=True)] + [("a", 0.9, 1), ("b", 1e-7, 0), ("b", 2e-7, 1)]
    df = spark.createDataFrame(rows, "k string, p double, label int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        points = metrics._ranged(df.groupBy("k", "p").agg(F.count("*").alias("w"), F.sum("label").alias("wp")), ["k"])
        sizes = [r["count"] for r in points.groupBy("_r").count().collect()]
        assert len(sizes) >= 4 and max(sizes) < 2 * 8003 / len(sizes)
        one, other = (sorted(map(tuple, metrics._curve(df, ["k"], None, whole).select("k", "p", "w", "wp", "cw", "cp", "n", "pos").collect())) for whole in (False, True))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert one == other and len(one) == len({r[:2] for r in rows})
