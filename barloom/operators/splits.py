"""Time splits with purged gaps, rolling folds, deterministic sampling and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered_dates(df: DataFrame) -> DataFrame:
    """dt, pos (from 0), n: the distinct dates in order. The one global window here runs over dates, not rows."""
    return df.select("dt").distinct().select("dt", (F.row_number().over(W.orderBy("dt")) - 1).alias("pos"), F.count("*").over(W.partitionBy(F.lit(1))).cast("int").alias("n"))


def purged_split(df: DataFrame, apply: int = 5, valid: int = 90, position: float = 0.90, purge: int = 30, min_train: int = 0) -> DataFrame:
    """dt, pos, split: apply for the last dates, valid around `position` of the others, train up to `purge` dates before it, else purged."""
    dates = numbered_dates(df)
    n, floor = F.col("n") - apply, F.lit(purge + min_train)
    centre = F.bround(F.lit(position) * (n - 1)).cast("int")
    end = F.least(n, F.greatest(floor, centre - valid // 2) + valid)
    start = F.greatest(floor, end - valid)
    pos = F.col("pos")
    split = F.when(pos >= n, "apply").when((pos >= start) & (pos < end), "valid").when(pos < start - purge, "train").otherwise("purged")
    return dates.select("dt", "pos", split.alias("split"))


def split_guards(calendar: DataFrame, apply: int = 5, valid: int = 90, purge: int = 30) -> DataFrame:
    """One row: enough_history, and ordered (train before valid before apply)."""
    last, first = (lambda s, f=f: f(F.when(F.col("split") == s, F.col("dt"))) for f in (F.max, F.min))
    ordered = F.coalesce(last("train") < first("valid"), F.lit(True)) & (last("valid") < first("apply"))
    return calendar.agg((F.count("*") >= apply + valid + purge + 5).alias("enough_history"), ordered.alias("ordered"))


def purged_folds(dates: DataFrame, test: int = 15, step: int = 3, purge: int = 30) -> DataFrame:
    """fold, role (train/test), dt: test windows of `test` dates every `step`, each with all dates up to `purge` before it."""
    rows = numbered_dates(dates)
    n = F.col("n")
    last = F.greatest(F.lit(purge + 1), n - test + 1) - 1
    starts = F.when(n <= purge + 5, F.array(F.greatest(F.lit(0), n - test))).otherwise(F.sequence(F.lit(purge), last, F.lit(step)))
    size = F.when(n <= purge + 5, n).otherwise(F.lit(test))
    each = rows.select("dt", "pos", size.alias("size"), F.posexplode(starts).alias("fold", "start"))
    role = F.when((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + F.col("size")), "test").when(F.col("pos") < F.col("start") - purge, "train")
    return each.select("fold", role.alias("role"), "dt").where("role is not null")


#: Hexadecimal digits of a draw by which rows are counted before any are ranked: 65,536 ranges of draws.
DIGITS = 4


def _first_drawn(rows: DataFrame, by: str, allowed: DataFrame) -> DataFrame:
    """rows whose _draw is among the first `allowed` (by, most) of their class; null most keeps all.

    Counts by range of draws find the range where a class fills up; only that range's rows are ranked.
    """
    rows = rows.withColumn("_range", F.substring("_draw", 1, DIGITS))
    counts = rows.groupBy(by, "_range").agg(F.count("*").alias("_k"))
    before = W.partitionBy(by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_k").over(before), F.lit(0)))
    full = counts.join(allowed, by).where("_before <= most and _before + _k > most").select(F.col(by).alias("_of"), F.col("_range").alias("_last"), (F.col("most") - F.col("_before")).alias("_left"))
    marked = rows.join(F.broadcast(full), F.col(by) == F.col("_of"), "left")  # a row for each class
    inside = marked.where("_last is null or _range < _last")
    edge = marked.where("_range = _last").withColumn("_nth", F.row_number().over(W.partitionBy(by, "_range").orderBy("_draw"))).where("_nth <= _left").drop("_nth")
    return inside.unionByName(edge).drop("_range", "_of", "_last", "_left")


def undersample(df: DataFrame, label: str, keys: list[str], max_rows: int, max_pos: int, ratio: float, seed: int = 42) -> DataFrame:
    """At most max_pos positives and ratio negatives to each positive, then max_rows, by MD5 of keys and seed; only if there are more than max_rows."""
    sizes = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col(label)), F.lit(0)).alias("pos")).first()
    if sizes["n"] <= max_rows:
        return df
    draw = F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.lit(str(seed))))
    keep_pos = min(int(sizes["pos"]), max_pos)
    limits = [(1, keep_pos), (0, max(1, int(ratio * max(keep_pos, 1))))]
    spark = df.sparkSession
    kept = _first_drawn(df.withColumns({"_draw": draw, "_class": F.col(label).cast("int")}), "_class", spark.createDataFrame(limits, "_class int, most long"))
    kept = _first_drawn(kept.withColumn("_class", F.lit(0)), "_class", spark.createDataFrame([(0, max_rows)], "_class int, most long"))
    return kept.drop("_draw", "_class")


def row_gate(df: DataFrame, calendar: DataFrame, keys: list[str], min_train: int = 500, min_valid: int = 50) -> DataFrame:
    """keys, n_train, n_valid of the groups with enough rows in both."""
    rows = df.join(F.broadcast(calendar.select("dt", "split")), "dt")
    counts = rows.groupBy(*keys).agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "valid").alias("n_valid"))
    return counts.where((F.col("n_train") >= min_train) & (F.col("n_valid") >= min_valid))


def recency_weights(dates: DataFrame, alpha: float = 3.0) -> DataFrame:
    """dt, weight = exp(alpha * i / (n - 1)) over the distinct dates."""
    return numbered_dates(dates).select("dt", F.exp(F.lit(alpha) * F.col("pos") / (F.col("n") - 1 + 1e-9)).alias("weight"))


def with_class_weight(df: DataFrame, label: str, by: list[str], name: str = "weight") -> DataFrame:
    """df with n / (2 * n of the row's class) within each group: counts by group and class, joined back."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("_k"))
    counts = counts.withColumn("_n", F.sum("_k").over(W.partitionBy(*by)))
    counts = counts.select(*(F.col(c).alias(f"_{c}") for c in (*by, label)), (F.col("_n") / (2 * F.col("_k"))).alias(name))
    same = [df[c].eqNullSafe(counts[f"_{c}"]) for c in (*by, label)]
    return df.join(counts, same).select(*df.columns, name)
