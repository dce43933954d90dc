import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators import reduction as red


def rows(spark, n=700, seed=3):
    rng = np.random.default_rng(seed)
    kinds = {"flat": np.zeros(n), "ties": rng.integers(0, 5, n).astype(float), "fine": rng.normal(size=n), "tiny": rng.normal(size=n) * 1e-300, "x_pattern": rng.integers(-1, 2, n).astype(float)}
    out = [(t, k, f, float(v)) for t in ("a", "b") for f, values in kinds.items() for k, v in enumerate(values)]
    out += [("a", n + k, "fine", v) for k, v in enumerate([None, None, float("nan"), float("inf"), -0.0, 0.0])] + [("c", 0, "fine", 2.0)]
    days = spark.createDataFrame([(t, k, int(rng.random() < 0.3), int(k % 2)) for t in ("a", "b", "c") for k in range(0, n, 1 if t != "c" else n)], "ticker string, dt int, y int, z int")
    return spark.createDataFrame(out, "ticker string, dt int, feature string, value double"), days


def ranked(long, bins):
    """Bins by a full sort of each feature's rows."""
    place = F.percent_rank().over(W.partitionBy("ticker", "feature").orderBy("value"))
    return long.withColumn("x", F.when(red.discrete(F.col("feature")), F.col("value")).otherwise(F.floor(place * bins).cast("double")))


@pytest.mark.parametrize("bins", [1, 8])
def test_bins_equal_those_of_a_full_sort(spark, bins):
    long, _ = rows(spark)
    key = lambda df: sorted(map(str, df.select("ticker", "dt", "feature", "x").collect()))
    assert key(red.binned(long, red.bin_edges(long, bins))) == key(ranked(long, bins))
    assert red.bin_edges(long, bins).groupBy("ticker", "feature").count().agg(F.max("count")).first()[0] <= bins + 1


def test_mutual_information_by_hand(spark):
    long, days = rows(spark)
    found = {(r["ticker"], r["feature"]): r["mi"] for r in red.mutual_info(long, days, ["y", "z"]).collect()}
    table = ranked(long, 8).join(days, ["ticker", "dt"]).toPandas()
    assert set(found) == {(t, f) for t, f in zip(table["ticker"], table["feature"], strict=True)}
    for (t, f), mi in found.items():
        part, most = table[(table["ticker"] == t) & (table["feature"] == f)], 0.0
        for y in ("y", "z"):
            joint = part.groupby(["x", y], dropna=False).size() / len(part)
            x, l = joint.groupby(level=0).sum(), joint.groupby(level=1).sum()  # noqa: E741
            most = max(most, sum(p * np.log(p / (x[i] * l[j])) for (i, j), p in joint.items()))
        assert abs(mi - most) < 1e-8


def test_empty_tables(spark):
    long, days = rows(spark, 5)
    assert red.mutual_info(long.limit(0), days, ["y"]).collect() == []
    assert red.mutual_info(long, days.limit(0), ["y"]).collect() == []
    assert red.bin_edges(long.limit(0)).collect() == []
