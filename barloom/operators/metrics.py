"""Metrics of scores and forecasts, grouped by any key; ties between scores count together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scratch import cut


def confusion(scores: DataFrame, by: list[str], threshold: float | Column = 0.5) -> DataFrame:
    """by, tn, fp, fn, tp at p >= threshold."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    hit, y = F.col("p") >= t, F.col("label") == 1
    return scores.groupBy(*by).agg(F.count_if(~hit & ~y).alias("tn"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(hit & y).alias("tp"))


def rates(table: DataFrame) -> DataFrame:
    """table with precision, recall, f1, balanced accuracy; 0 where a denominator is 0."""
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return table.withColumns(
        {"precision": over(tp, tp + fp), "recall": over(tp, tp + fn), "f1": over(2 * tp, 2 * tp + fp + fn), "balanced_acc": (over(tp, tp + fn) + over(tn, tn + fp)) / 2}
    )


def _curve(scores: DataFrame, by: list[str], weight: str | None, whole: bool = False) -> DataFrame:
    """by, p, w, wp and their sums from the greatest p down: one row per distinct score; n and pos, their totals.

    The running sum goes within a range of scores, over the totals of the ranges above: no task needs all of a group. Ranges
    are cut where the distinct scores of all groups are, so that each holds about as many of them wherever they lie. With
    `whole` the sum goes over the group itself, which suits many groups of few rows.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    points = scores.groupBy(*by, "p").agg(F.sum(w).alias("w"), F.sum(w * F.col("label")).alias("wp"))
    if whole:
        down, every = W.partitionBy(*by).orderBy(F.desc("p")).rowsBetween(W.unboundedPreceding, 0), W.partitionBy(*by)
        return points.withColumns({"cw": F.sum("w").over(down), "cp": F.sum("wp").over(down), "n": F.sum("w").over(every), "pos": F.sum("wp").over(every)})
    points = _ranged(points, by)
    ranges = points.groupBy(*by, "_r").agg(F.sum("w").alias("_w"), F.sum("wp").alias("_wp"))
    above = W.partitionBy(*by).orderBy(F.desc("_r")).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(*by)
    ranges = ranges.select(
        *(F.col(c).alias(f"_{c}") for c in by), F.col("_r").alias("_of"), *(F.coalesce(F.sum(c).over(above), F.lit(0.0)).alias(f"{c}0") for c in ("_w", "_wp")), F.sum("_w").over(every).alias("n"), F.sum("_wp").over(every).alias("pos")
    )
    down = W.partitionBy(*by, "_r").orderBy(F.desc("p")).rowsBetween(W.unboundedPreceding, 0)
    points = points.withColumns({"cw": F.sum("w").over(down), "cp": F.sum("wp").over(down)})
    same = [points[c].eqNullSafe(ranges[f"_{c}"]) for c in by]
    joined = points.join(ranges, [*same, points["_r"] == ranges["_of"]])
    return joined.select(*by, "p", "w", "wp", (F.col("cw") + F.col("_w0")).alias("cw"), (F.col("cp") + F.col("_wp0")).alias("cp"), "n", "pos")


def _ranged(points: DataFrame, by: list[str]) -> DataFrame:
    """points (by, p, w, wp), one for each distinct score of a group, with the number _r of the range they are in, rising with p."""
    return cut(points.repartitionByRange(*by, "p").withColumn("_r", F.spark_partition_id()), "score-ranges")


def average_precision(scores: DataFrame, by: list[str], weight: str | None = None, whole: bool = False) -> DataFrame:
    """by, ap: the sum over distinct scores of the recall gained times the precision there; 0 without positives."""
    gained = F.when(F.col("pos") > 0, F.col("wp") / F.col("pos") * F.col("cp") / F.col("cw")).otherwise(0.0)
    return _curve(scores, by, weight, whole).groupBy(*by).agg(F.sum(gained).alias("ap"))


def roc_auc(scores: DataFrame, by: list[str]) -> DataFrame:
    """by, auc: the rank statistic with ties at their mean rank; null for one class alone."""
    points = _curve(scores, by, None)
    neg = F.col("w") - F.col("wp")
    below = F.col("cw") - F.col("cp") - neg  # negatives with a greater score
    parts = points.groupBy(*by).agg(F.sum(F.col("wp") * (below + neg / 2)).alias("lost"), F.sum("wp").alias("pos"), F.sum(neg).alias("neg"))
    return parts.select(*by, F.when((F.col("pos") > 0) & (F.col("neg") > 0), 1 - F.col("lost") / (F.col("pos") * F.col("neg"))).alias("auc"))


def threshold_f1(scores: DataFrame, by: list[str]) -> DataFrame:
    """by, threshold, f1: the distinct score with the best F1, the least on ties."""
    f1 = F.when(F.col("cw") + F.col("pos") > 0, 2 * F.col("cp") / (F.col("cw") + F.col("pos"))).otherwise(0.0)
    best = _curve(scores, by, None).groupBy(*by).agg(F.max(F.struct(f1.alias("f1"), (-F.col("p")).alias("q"))).alias("best"))
    return best.select(*by, (-F.col("best.q")).alias("threshold"), F.col("best.f1").alias("f1"))


def threshold_quantile_f1(scores: DataFrame, by: list[str], grid: int = 199, whole: bool = False) -> DataFrame:
    """by, threshold: the best F1 among quantiles from .01 to .99, the first on ties; 0.5 where all scores are equal.

    A quantile lies between the scores at two neighbouring ranks. Every distinct score knows the ranks that it holds, so it
    knows which quantiles it bounds from below or above, and what its threshold would pick.
    """
    place = lambda k: F.lit(0.01) + F.lit(0.98) * k / (grid - 1)
    rows = _curve(scores, by, None, whole).withColumns({"a": F.col("n") - F.col("cw"), "b": F.col("n") - F.col("cw") + F.col("w") - 1})
    # The quantiles whose place among the ranks, down or up to a whole one, may lie within [a, b].
    span = F.greatest(F.col("n") - 1, F.lit(1.0))
    first = F.greatest(F.floor(((F.col("a") - 1) / span - 0.01) / 0.98 * (grid - 1)).cast("int") - 1, F.lit(0))
    last = F.least(F.ceil(((F.col("b") + 1) / span - 0.01) / 0.98 * (grid - 1)).cast("int") + 1, F.lit(grid - 1))
    near = F.when(first <= last, F.sequence(first, last))
    rows = rows.select(*by, "p", "cw", "cp", "n", "pos", "a", "b", F.explode(near).alias("k")).withColumn("at", place(F.col("k")) * (F.col("n") - 1))
    held = F.struct("p", "cw", "cp")
    low, high = (F.max(F.when((f("at") >= F.col("a")) & (f("at") <= F.col("b")), held)).alias(c) for f, c in ((F.floor, "low"), (F.ceil, "high")))
    marks = rows.groupBy(*by, "k").agg(low, high, F.max("at").alias("at"), F.max("pos").alias("pos"))
    marks = marks.where("low is not null and high is not null")
    t = F.round(F.col("low.p") + (F.col("high.p") - F.col("low.p")) * (F.col("at") - F.floor("at")), 9)
    marks = marks.withColumn("threshold", t).withColumn("met", F.when(F.col("threshold") <= F.col("low.p"), F.col("low")).otherwise(F.col("high")))
    f1 = F.when(F.col("met.cw") + F.col("pos") > 0, 2 * F.col("met.cp") / (F.col("met.cw") + F.col("pos"))).otherwise(0.0)
    best = marks.groupBy(*by).agg(F.max(F.struct(f1.alias("f1"), (-F.col("threshold")).alias("q"))).alias("best"))
    flat = scores.groupBy(*by).agg((F.min("p") == F.max("p")).alias("flat"))
    return best.join(flat, by).select(*by, F.when(F.col("flat"), 0.5).otherwise(-F.col("best.q")).alias("threshold"))


def regression_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, n, mae, rmse, r2 (0 where y hardly varies) of y and pred."""
    e = F.col("y") - F.col("pred")
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop("y").alias("v"))
    r2 = F.when(F.col("v") * F.col("n") > 1e-12, 1 - F.col("mse") / F.col("v")).otherwise(0.0)
    return sums.select(*by, "n", "mae", F.sqrt("mse").alias("rmse"), r2.alias("r2"))


def metrics_table(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """target, model and every metric, by target and falling average precision."""
    by = ["target", "model"]
    table = rates(confusion(scores, by, threshold)).join(average_precision(scores, by), by).join(roc_auc(scores, by), by)
    return table.withColumn("threshold", F.lit(threshold)).orderBy("target", F.desc("ap"), "model")
