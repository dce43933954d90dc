"""Feature reduction per ticker on the long form (ticker, dt, feature, value): one shuffle for all tickers and features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scratch import cut
from ..functions.sums import summed_products

BY = ["ticker", "feature"]
#: Prefixes of features that are always kept.
ANCHORS = ("pct_change", "sma_", "tri_", "sr_")


def feature_stats(long: DataFrame) -> DataFrame:
    """BY, kinds (null is one), variance."""
    kinds = F.countDistinct("value") + F.max(F.col("value").isNull().cast("int"))
    return long.groupBy(*BY).agg(kinds.alias("kinds"), F.var_samp("value").alias("variance"))


def drop_constant(stats: DataFrame) -> DataFrame:
    return stats.where("kinds > 1")


def drop_low_variance(stats: DataFrame, least: float) -> DataFrame:
    return stats.where(F.col("variance") > least)


def discrete(feature: Column) -> Column:
    return feature.startswith("cross_") | feature.endswith("pattern")


def histogram(long: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """BY, value, labels, m: the rows of each distinct value of a feature, by the labels of their day; labels is null without any."""
    days = labels.select("ticker", "dt", F.struct(*names).alias("labels"))
    return long.join(days, ["ticker", "dt"], "left").groupBy(*BY, "value", "labels").agg(F.count("*").alias("m"))


def _below(values: DataFrame) -> DataFrame:
    """values (BY, value, m: rows of each distinct value) with `below` and `all`: the feature's rows of smaller values, and all of its rows.

    Counts roll within ranges of values, over the totals of the ranges before: no task needs all values of a feature.
    Ranges are cut where the distinct values are. Null comes first, NaN last.
    """
    points = cut(values.repartitionByRange(*BY, "value").withColumn("_r", F.spark_partition_id()), "value-ranges")
    ranges = points.groupBy(*BY, "_r").agg(F.sum("m").alias("_m"))
    of = W.partitionBy(*BY)
    before = F.coalesce(F.sum("_m").over(of.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(*BY, "_r", before.alias("_before"), F.sum("_m").over(of).alias("all"))
    within = W.partitionBy(*BY, "_r").orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    points = points.withColumn("_in", F.coalesce(F.sum("m").over(within), F.lit(0)))
    return points.join(ranges, [*BY, "_r"]).select(*BY, "value", "m", (F.col("_before") + F.col("_in")).alias("below"), "all")


def bin_edges(long: DataFrame, bins: int = 8) -> DataFrame:
    """BY, x, low: the least value of each quantile bin that has rows, for features that aren't discrete.

    A value's bin is floor(percent rank * bins) among all rows of its ticker and feature, so equal values share one.
    """
    return _edges(long.where(~discrete(F.col("feature"))).groupBy(*BY, "value").agg(F.count("*").alias("m")), bins)


def _edges(values: DataFrame, bins: int) -> DataFrame:
    # As percent_rank has it: one division, then the product.
    place = F.when(F.col("all") > 1, F.col("below").cast("double") / (F.col("all") - 1)).otherwise(0.0)
    x = F.floor(place * bins).cast("double")
    return _below(values).groupBy(*BY, x.alias("x")).agg(F.min(F.struct("value")).alias("low")).select(*BY, "x", "low.value")


def binned(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows (BY, value, ...) with x: the value itself where discrete, else the bin whose edge is the last at or below it.

    Edges are at most one a bin, so a feature's are one short array; null and NaN go where the order puts them.
    """
    # A rank for null before all numbers, so that structs compare as the windows sort.
    spot = lambda v: F.struct(v.isNotNull().alias("some"), v.alias("value"))
    short = edges.groupBy(*BY).agg(F.sort_array(F.collect_list(F.struct(spot(F.col("value")).alias("low"), "x"))).alias("_edges"))
    at = F.filter("_edges", lambda e: e["low"] <= spot(F.col("value")))
    x = F.when(discrete(F.col("feature")), F.col("value")).otherwise(F.element_at(at, -1)["x"])
    return rows.join(short, BY, "left").withColumn("x", x).drop("_edges")


def mutual_info(long: DataFrame, labels: DataFrame, names: list[str], bins: int = 8) -> DataFrame:
    """BY, mi: the greater plug-in mutual information, in nats, of the binned feature with each label; 0 for a label of one class.

    Rows meet once, in a histogram of distinct values by labels. Bins and cells are all made from it.
    """
    seen = cut(histogram(long, labels, names), "histogram")
    values = seen.where(~discrete(F.col("feature"))).groupBy(*BY, "value").agg(F.sum("m").alias("m"))
    rows = binned(seen.where("labels is not null"), _edges(values, bins)).groupBy(*BY, "x", "labels").agg(F.sum("m").alias("m"))
    pairs = rows.select(*BY, "x", "m", F.explode(F.array(*(F.struct(F.lit(n).alias("label"), F.col("labels")[n].alias("y")) for n in names))).alias("l")).select(*BY, "x", "m", "l.label", "l.y")
    cells = pairs.groupBy(*BY, "label", "x", "y").agg(F.sum("m").alias("n"))
    of = lambda *c: F.sum("n").over(W.partitionBy(*BY, "label", *c))
    cells = cells.withColumns({"nx": of("x"), "ny": of("y"), "all": of()})
    mi = cells.groupBy(*BY, "label").agg(F.sum(F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("nx") * F.col("ny")))).alias("mi"))
    return mi.groupBy(*BY).agg(F.round(F.greatest(F.max("mi"), F.lit(0.0)), 9).alias("mi"))


def rank_top(scored: DataFrame, score: str, fraction: float, least: int) -> DataFrame:
    """scored with rank, for the first max(least, ceil(n * fraction)) features of each ticker by score, then name."""
    order = W.partitionBy("ticker").orderBy(F.desc(score), "feature")
    rows = scored.withColumns({"rank": F.row_number().over(order), "_n": F.count("*").over(W.partitionBy("ticker"))})
    return rows.where(F.col("rank") <= F.least("_n", F.greatest(F.lit(least), F.ceil(F.col("_n") * fraction)))).drop("_n")


def with_anchors(ranked: DataFrame, stats: DataFrame, prefixes: tuple[str, ...] = ANCHORS) -> DataFrame:
    """ticker, feature, rank: the ranked features, then those with a protected prefix that aren't among them, by name."""
    keep = F.lit(False)
    for p in prefixes:
        keep = keep | F.col("feature").startswith(p)
    extra = stats.where(keep).select(*BY).join(ranked.select(*BY), BY, "left_anti")
    last = ranked.groupBy("ticker").agg(F.max("rank").alias("_last"))
    nth = F.row_number().over(W.partitionBy("ticker").orderBy("feature"))
    extra = extra.join(last, "ticker", "left").select(*BY, (F.coalesce("_last", F.lit(0)) + nth).alias("rank"))
    return ranked.select(*BY, "rank").unionByName(extra)


def variance_fallback(mi: DataFrame, stats: DataFrame) -> DataFrame:
    """BY, score, by_variance: mi, or the variance for tickers whose mi is 0 throughout or missing."""
    rows = stats.join(mi, BY, "left")
    flat = F.coalesce(F.max("mi").over(W.partitionBy("ticker")), F.lit(0.0)) <= 0
    return rows.select(*BY, F.when(flat, F.coalesce("variance", F.lit(0.0))).otherwise(F.coalesce("mi", F.lit(0.0))).alias("score"), flat.alias("by_variance"))


def _pearson(batches: Iterator[pd.DataFrame], features: list[str]) -> Iterator[pd.DataFrame]:
    first, second = np.triu_indices(len(features), 1)
    a, b = np.array(features, object)[first], np.array(features, object)[second]
    for batch in batches:
        for r in batch.to_dict("records"):
            k = len(features)
            n, s = r["sums"][0], np.array(r["sums"][1 : k + 1], float)
            xx = np.zeros((k, k))
            xx[np.triu_indices(k)] = r["sums"][k + 1 :]
            cov = xx / n - np.outer(s, s) / n**2
            var = np.diag(cov).copy()
            var[var <= 1e-12 * np.maximum(np.diag(xx) / n, 1e-300)] = 0.0
            with np.errstate(divide="ignore", invalid="ignore"):
                value = cov[first, second] / np.sqrt(var[first] * var[second]) * n / (n - 1)
            yield pd.DataFrame({"ticker": r["ticker"], "a": a, "b": b, "r": np.where(np.isfinite(value), value, np.nan)})


def correlations(wide: DataFrame, features: list[str]) -> DataFrame:
    """ticker, a, b, r for each two features (a before b in the list); null where one of them doesn't vary.

    Values are standardised by the population and divided by n - 1, so r is Pearson's times n / (n - 1). Tasks add up a
    matrix of products for each ticker, and those meet element by element, one at a time. Null counts as 0.
    """
    x = cut(wide.select("ticker", *(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features)), "correlated")
    # Products about any fixed point give the same covariance; about a row of the data they lose no digits.
    zero = x.groupBy("ticker").agg(F.min(F.struct(*features)).alias("z")).withColumnRenamed("ticker", "_t")
    about = x.join(zero, x["ticker"].eqNullSafe(F.col("_t"))).select("ticker", *((x[f] - F.col("z")[f]).alias(f) for f in features))
    sums = summed_products(about, ["ticker"], features)
    rows = sums.mapInPandas(lambda b: _pearson(b, features), "ticker string, a string, b string, r double")
    return rows.withColumn("r", F.when(~F.isnan("r"), F.col("r")))


def decorrelated(ranked: DataFrame, cors: DataFrame, limit: float = 0.9995, least: int = 0) -> DataFrame:
    """ticker, feature, rank, kept: in order of rank, a feature stays if its |r| with all kept before is below limit.

    Where fewer than `least` stay, the best dropped ones are taken back. A correlation that is no number keeps a feature.
    The fold runs over one short array of features per ticker.
    """
    both = cors.select("ticker", "a", "b", "r").unionByName(cors.select("ticker", F.col("b").alias("a"), F.col("a").alias("b"), "r"))
    high = both.where(F.abs("r") >= limit).groupBy("ticker", F.col("a").alias("feature")).agg(F.collect_set("b").alias("like"))
    rows = ranked.join(high, BY, "left").groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("rank", "feature", F.coalesce("like", F.array().cast("array<string>")).alias("like")))).alias("all"))
    start = F.array().cast("array<string>")
    kept = F.aggregate("all", start, lambda k, f: F.when(F.arrays_overlap(k, f["like"]), k).otherwise(F.concat(k, F.array(f["feature"]))))
    rows = rows.withColumn("kept", kept)
    dropped = F.transform(F.filter("all", lambda f: ~F.array_contains("kept", f["feature"])), lambda f: f["feature"])
    padded = F.concat("kept", F.slice(dropped, F.lit(1), F.greatest(F.lit(least) - F.size("kept"), F.lit(0))))
    return rows.withColumn("kept", padded).select("ticker", F.explode("all").alias("f"), "kept").select("ticker", "f.feature", "f.rank", F.array_contains("kept", F.col("f.feature")).alias("kept"))


def reduction_report(kept: DataFrame, stats: DataFrame) -> DataFrame:
    """One row: features, kept, pct, and the least, median and most kept per ticker."""
    per = kept.groupBy("ticker").agg(F.count("*").alias("n"))
    out = per.agg(F.sum("n").alias("kept"), F.min("n").alias("least"), F.expr("percentile(n, 0.5)").alias("median"), F.max("n").alias("most"))
    return out.join(F.broadcast(stats.agg(F.count("*").alias("features"))), F.lit(True)).withColumn("pct", F.round(100 * F.col("kept") / F.col("features"), 4))
