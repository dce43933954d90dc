"""Calibration and blending of model scores (dt, ticker, target, model, p, label), fold by fold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scratch import cut, discard
from ..functions.shipping import ship
from .logistic import balanced, fit_many, probability
from .logistic import table as fit_table
from .metrics import average_precision

KEY = ["dt", "ticker", "target"]
#: Decimals kept of a blended score, so that scores equal but for rounding tie.
DIGITS = 9


def _pooled(blocks: Iterator[tuple[float, float, float, float]]) -> list[list[float]]:
    """(weight, positives, first score, last score) of the blocks left when neighbours that fall are pooled."""
    stack: list[list[float]] = []
    for block in blocks:
        stack.append(list(block))
        while len(stack) > 1 and stack[-2][1] * stack[-1][0] >= stack[-1][1] * stack[-2][0]:
            w, pos, _, end = stack.pop()
            stack[-1][0] += w
            stack[-1][1] += pos
            stack[-1][3] = end
    return stack


def _pool_sorted(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, n, pos, low, high: what pooling leaves of rows that come sorted by `by` and low, within each partition."""
    ship(rows.sparkSession)
    kinds = [rows.schema[c].dataType.simpleString() for c in by]

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, schema = None, [], None

        def made() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            keys = [pa.array([k] * len(held), schema.field(c).type) for k, c in zip(key, by, strict=True)]
            return pa.RecordBatch.from_arrays([*keys, *(pa.array(c, pa.float64()) for c in columns)], names=[*by, "n", "pos", "low", "high"])

        for batch in batches:
            schema = batch.schema
            keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
            values = list(zip(*(batch.column(c).to_pylist() for c in ("n", "pos", "low", "high")), strict=True))
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b:
                    if held and keys[a] != key:
                        yield made()
                        held = []
                    key, held = keys[a], _pooled([*held, *values[a:b]])
        if held:
            yield made()

    columns = [*by, *(F.col(c).cast("double").alias(c) for c in ("n", "pos", "low", "high"))]
    return rows.select(*columns).mapInArrow(pool, ", ".join(f"{c} {k}" for c, k in zip(by, kinds, strict=True)) + ", n double, pos double, low double, high double")


def isotonic_fits(points: DataFrame, by: list[str]) -> DataFrame:
    """by, low, high, value: the isotonic fit of pos / n on p for each group of points (by, p, n, pos), as blocks of one value.

    Violators are pooled inside ranges of the scores of all groups, cut so that each holds about as many, and then what
    stacks the ranges of a group have left are merged in order. A range's task sees its scores alone; the merging task
    sees blocks, which are far fewer than scores (of n labels, at most in the order of n to the power 2/3).
    """
    rows = points.select(*by, "n", "pos", F.col("p").alias("low"), F.col("p").alias("high"))
    ranges = _pool_sorted(rows.repartitionByRange(*by, "low").sortWithinPartitions(*by, "low"), by)
    whole = _pool_sorted(ranges.repartition(*by).sortWithinPartitions(*by, "low"), by)
    return whole.select(*by, "low", "high", (F.col("pos") / F.col("n")).alias("value"))


def isotonic_values(fits: DataFrame, scores: DataFrame, by: list[str]) -> DataFrame:
    """by, p, fitted for distinct scores (by, p): the value of the block that p lies in, a line between two blocks, the end block's outside."""
    known = fits.select(*by, F.col("low").alias("p"), F.struct("low", "high", "value").alias("block"))
    rows = known.unionByName(scores.select(*by, "p").distinct().withColumn("block", F.lit(None).cast(known.schema["block"].dataType)))
    here = W.partitionBy(*by).orderBy("p", F.col("block").isNull())
    before = F.last("block", ignorenulls=True).over(here.rowsBetween(W.unboundedPreceding, 0))
    # What follows comes from a descending window, so that neither keeps a group's rows.
    there = W.partitionBy(*by).orderBy(F.desc("p"), F.col("block").isNotNull())
    rows = rows.withColumn("a", before).withColumn("b", F.last("block", ignorenulls=True).over(there.rowsBetween(W.unboundedPreceding, -1)))
    line = F.col("a.value") + (F.col("b.value") - F.col("a.value")) * (F.col("p") - F.col("a.high")) / (F.col("b.low") - F.col("a.high"))
    fitted = F.when(F.col("a").isNull(), F.col("b.value")).when((F.col("p") <= F.col("a.high")) | F.col("b").isNull(), F.col("a.value")).otherwise(line)
    return rows.where("block is null").select(*by, "p", fitted.alias("fitted")).where("fitted is not null")


def isotonic_oof(scores: DataFrame, folds: DataFrame, min_rows: int = 2000, min_pos: int = 20, min_neg: int = 20, apply: DataFrame | None = None) -> DataFrame:
    """scores with raw, covered and p calibrated out of fold: fitted on a fold's training dates, applied to its test dates.

    Where test windows overlap, the last fold that may be fitted counts; rows that none covers keep their raw score.
    Training rows are reduced to their distinct scores before they meet. Rows of apply (scores of later dates) follow,
    calibrated by one fit on all of scores for each target and model, or raw where those are of one class.
    """
    by = ["target", "model", "fold"]
    rows = scores.join(F.broadcast(folds), "dt")
    points = rows.where("role = 'train'").groupBy(*by, "p").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    enough = points.groupBy(*by).agg(F.sum("n").alias("rows"), F.sum("pos").alias("hits"))
    enough = enough.where((F.col("rows") >= min_rows) & (F.col("hits") >= min_pos) & (F.col("rows") - F.col("hits") >= min_neg)).select(*by)
    tested = rows.where("role = 'test'").select(*KEY, "model", "fold", "p")
    fits = isotonic_fits(points.join(enough, by, "left_semi"), by)
    fitted = isotonic_values(fits, tested, by).withColumnsRenamed({c: f"_{c}" for c in (*by, "p")})  # names of their own, since both sides come from one table
    latest = tested.join(fitted, [tested[c] == fitted[f"_{c}"] for c in (*by, "p")]).groupBy(*KEY, "model").agg(F.max_by("fitted", "fold").alias("fitted"))
    columns = [*KEY, "model", F.col("p").alias("raw"), F.coalesce("fitted", "p").alias("p"), "label", F.col("fitted").isNotNull().alias("covered")]
    out = scores.join(latest, [*KEY, "model"], "left").select(*columns)
    if apply is None:
        return out
    by = ["target", "model"]
    points = scores.groupBy(*by, "p").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    both = points.groupBy(*by).agg(F.sum("n").alias("rows"), F.sum("pos").alias("hits")).where("hits > 0 and hits < rows").select(*by)
    full = isotonic_values(isotonic_fits(points.join(both, by, "left_semi"), by), apply, by)
    return out.unionByName(apply.join(full, [*by, "p"], "left").select(*columns))


def blend_equal(scores: DataFrame) -> DataFrame:
    return scores.groupBy(*KEY).agg(F.round(F.avg("p"), DIGITS).alias("p"), F.first("label").alias("label"))


def random_weights(spark: SparkSession, models: list[str], trials: int, seed: int = 42) -> DataFrame:
    """trial, model, w: points spread evenly over the simplex, from MD5 of trial, model and seed."""
    rows = spark.range(trials).select(F.col("id").cast("int").alias("trial"), F.explode(F.array(*map(F.lit, models))).alias("model"))
    text = F.concat_ws("|", F.col("trial").cast("string"), "model", F.lit(str(seed)))
    e = -F.log((F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + 1) / F.lit(float(1 << 52)))
    return rows.withColumn("e", e).select("trial", "model", (F.col("e") / F.sum("e").over(W.partitionBy("trial"))).alias("w"))


def blended(scores: DataFrame, weights: DataFrame, extra: list[str] = [], logit: bool = False) -> DataFrame:  # noqa: B006
    """KEY, extra, p, label: the weighted sum of the models' scores, or of their logits through a sigmoid."""
    x = F.log(F.col("p") / (1 - F.col("p"))) if logit else F.col("p")
    on = [c for c in ("target", "model") if c in weights.columns]
    total = F.sum(F.round(F.col("w") * x, 12))
    p = 1 / (1 + F.exp(-total)) if logit else total
    return scores.join(F.broadcast(weights), on).groupBy(*KEY, *extra).agg(F.round(p, DIGITS).alias("p"), F.first("label").alias("label"))


#: Cells of scores times weight sets that a task blends at once.
CELLS = 1 << 22


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """x to so many decimals, halves away from zero."""
    return np.copysign(np.floor(np.abs(x) * 10.0**digits + 0.5) / 10.0**digits, x)


def precisions(p: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The average precision of each column of scores p; equal scores count together, and it is 0 without positives."""
    order = np.argsort(-p, axis=0, kind="stable")
    w, wp = weight[order], (weight * label)[order]
    ranked, all_, good = np.take_along_axis(p, order, axis=0), np.cumsum(w, axis=0), np.cumsum(wp, axis=0)
    out = np.zeros(p.shape[1])
    for k in range(p.shape[1]):
        ends = np.append(np.flatnonzero(ranked[1:, k] != ranked[:-1, k]), len(p) - 1)
        if good[-1, k] > 0:
            out[k] = (np.diff(good[ends, k], prepend=0.0) * good[ends, k] / all_[ends, k]).sum() / good[-1, k]
    return out


def weight_search(scores: DataFrame, folds: DataFrame, trials: int = 300, seed: int = 42, recency: DataFrame | None = None, logit: bool = False) -> DataFrame:
    """target, trial, score, model, w: the weights with the best mean average precision over the folds' test dates.

    A key's scores meet in one row, and rows once for each target and fold: there a product with all weight sets, some at a
    time, blends them, and only precisions leave. What is shuffled doesn't depend on the number of trials. A group holds a
    fold's test dates, so it grows with the tickers of a few days alone; weight sets, a parameter, go to every task. The
    first trial wins ties.
    """
    spark = scores.sparkSession
    models = sorted(r["model"] for r in scores.select("model").distinct().collect())
    weights = random_weights(spark, models, trials, seed)
    tests = folds.where("role = 'test'").groupBy("dt").agg(F.collect_list("fold").alias("folds"))
    x = F.log(F.col("p") / (1 - F.col("p"))) if logit else F.col("p")
    xs = [f"x{k}" for k in range(len(models))]
    wide = scores.join(F.broadcast(tests), "dt").groupBy(*KEY).agg(F.first("folds").alias("folds"), F.first("label").cast("double").alias("label"), *(F.max(F.when(F.col("model") == m, x)).alias(c) for m, c in zip(models, xs, strict=True)))
    wide = wide.join(F.broadcast(recency), "dt") if recency is not None else wide.withColumn("weight", F.lit(1.0))
    sets = np.zeros((len(models), trials))
    for r in weights.collect():  # models times trials, both bounded
        sets[models.index(r["model"]), r["trial"]] = r["w"]

    def search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found, block = [], max(1, CELLS // len(rows))
        for a in range(0, trials, block):
            p = np.zeros((len(rows), min(block, trials - a)))
            for c, w in zip(xs, sets[:, a : a + block], strict=True):  # a model without a score for the key counts for nothing
                p += np.nan_to_num(_rounded(np.outer(rows[c].to_numpy(float), w), 12))
            p = 1 / (1 + np.exp(-p)) if logit else p
            found.append(precisions(_rounded(p, DIGITS), rows["label"].to_numpy(float), rows["weight"].to_numpy(float)))
        return pd.DataFrame({"target": key[0], "trial": np.arange(trials, dtype=np.int32), "ap": np.concatenate(found)})

    ship(spark)
    by_fold = wide.select("target", F.explode("folds").alias("fold"), "label", "weight", *xs).groupBy("target", "fold").applyInPandas(search, "target string, trial int, ap double")
    means = by_fold.groupBy("target", "trial").agg(F.round(F.avg("ap"), 9).alias("score"))
    best = means.groupBy("target").agg(F.max(F.struct("score", (-F.col("trial")).alias("t"))).alias("b")).select("target", (-F.col("b.t")).alias("trial"), F.col("b.score").alias("score"))
    return best.join(weights, "trial").select("target", "trial", "score", "model", "w")


def blend_trimmed(scores: DataFrame, k: int = 1) -> DataFrame:
    """The mean without the k least and k greatest models, or of all where there are at most 2k."""
    ordered = F.array_sort(F.collect_list("p"))
    rows = scores.groupBy(*KEY).agg(ordered.alias("ps"), F.first("label").alias("label"))
    some = F.when(F.size("ps") > 2 * k, F.slice("ps", F.lit(k + 1), F.greatest(F.size("ps") - 2 * k, F.lit(1)))).otherwise(F.col("ps"))
    return rows.select(*KEY, F.round(F.aggregate(some, F.lit(0.0), lambda a, x: a + x) / F.size(some), DIGITS).alias("p"), "label")


def meta_features(scores: DataFrame, models: list[str]) -> DataFrame:
    """KEY, a column per model, mean, std (of the population), min, max, range, n_high (p of .5 or more), and centred scores."""
    wide = scores.groupBy(*KEY).pivot("model", models).agg(F.first("p")).join(scores.groupBy(*KEY).agg(F.first("label").alias("label")), KEY)
    ps = [F.col(m) for m in models]
    mean = sum(ps[1:], ps[0]) / len(ps)
    std = F.sqrt(sum(((x - mean) * (x - mean) for x in ps[1:]), (ps[0] - mean) * (ps[0] - mean)) / len(ps))
    high = sum(((x >= 0.5).cast("int") for x in ps[1:]), (ps[0] >= 0.5).cast("int"))
    return wide.select(
        *KEY, "label", *models, mean.alias("mean"), std.alias("std"), F.least(*ps).alias("min"), F.greatest(*ps).alias("max"), (F.greatest(*ps) - F.least(*ps)).alias("range"), high.alias("n_high"), *((x - mean).alias(f"{m}_c") for m, x in zip(models, ps, strict=True))
    )


def selection(scores: DataFrame, folds: DataFrame, target: str, steps: int = 32, tolerance: float = 1e-4) -> dict[str, float]:
    """Weights of one target by greedy forward selection with repetition on mean average precision.

    Every step scores all candidates in one job; only their means come back. A candidate must beat the running best, in
    the order of names.
    """
    wide = scores.where(F.col("target") == target)
    models = sorted(r["model"] for r in wide.select("model").distinct().collect())
    tests = folds.where("role = 'test'").select("fold", "dt")
    rows = wide.groupBy("dt", "ticker").pivot("model", models).agg(F.first("p")).join(wide.groupBy("dt", "ticker").agg(F.first("label").alias("label")), ["dt", "ticker"])
    rows = cut(rows.join(F.broadcast(tests), "dt"), "selection-rows")
    counts, best = dict.fromkeys(models, 0), -1.0
    for step in range(steps):
        current = sum((F.col(m) * (counts[m] / max(1, step)) for m in models[1:]), F.col(models[0]) * (counts[models[0]] / max(1, step)))
        trials = F.array(*(F.named_struct(F.lit("model"), F.lit(m), F.lit("p"), F.round(current * (step / (step + 1)) + F.col(m) / (step + 1), DIGITS)) for m in models))
        tried = rows.select("fold", "label", F.explode(trials).alias("t")).select("fold", "label", "t.*")
        means = {r["model"]: r["ap"] for r in average_precision(tried, ["model", "fold"], whole=True).groupBy("model").agg(F.avg("ap").alias("ap")).collect()}
        chosen = None
        for m in models:
            if m in means and means[m] > best + tolerance:
                best, chosen = means[m], m
        if chosen is None:
            break
        counts[chosen] += 1
    discard(rows)
    total = sum(counts.values())
    return {m: (counts[m] / total if total else 1 / len(models)) for m in models}


def stack_lr(scores: DataFrame, folds: DataFrame, c: float = 1.0, min_rows: int = 2000, min_pos: int = 20, min_neg: int = 20, apply: DataFrame | None = None) -> DataFrame:
    """KEY, label, p: balanced logistic regressions on meta features, out of fold with the same gates; the mean elsewhere.

    One for each target and fold, fitted on the fold's training dates and applied to its test dates; where test windows
    overlap, the last fold that passes the gates counts. Rows of apply (scores of later dates) are scored by one fit on all
    of a target's scores, or get the mean where those are of one class. All fits of all targets go together, features scaled by the population;
    the number of fits is bounded by targets and folds.
    """
    models = sorted(r["model"] for r in scores.select("model").distinct().collect())

    def described(rows: DataFrame) -> DataFrame:
        meta = meta_features(rows, models)
        features = [F.col(x).cast("double") for x in meta.columns if x not in (*KEY, "label")]
        return meta.select(*KEY, "label", "mean", F.array(*features).alias("x"))

    meta = cut(described(scores), "meta-features")
    roles = folds.select("fold", "role", F.col("dt").alias("_dt"))
    enough = (F.col("n") >= min_rows) & (F.col("pos") >= min_pos) & (F.col("n") - F.col("pos") >= min_neg)
    daily = meta.groupBy("target", "dt").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    gates = daily.join(F.broadcast(roles.where("role = 'train'")), F.col("dt") == F.col("_dt")).groupBy("target", "fold").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    wanted = [(r["target"], r["fold"]) for r in gates.where(enough).orderBy("target", "fold").collect()]
    sizes = {(r["target"], None): int(r["n"]) for r in daily.groupBy("target").agg(F.sum("n").alias("n")).collect()}
    if apply is not None:
        wanted += sorted(sizes, key=str)
    sizes |= {(r["target"], r["fold"]): int(r["n"]) for r in gates.collect()}
    ids = scores.sparkSession.createDataFrame([(k, *w) for k, w in enumerate(wanted)], "fit int, target string, of int")
    # A row's fits hang on its target and date alone.
    trained = ids.join(roles.where("role = 'train'"), F.col("of") == F.col("fold")).select("target", F.col("_dt").alias("dt"), "fit")
    trained = trained.unionByName(ids.where("of is null").join(daily.select("target", "dt"), "target").select("target", "dt", "fit"))
    member = trained.groupBy("target", "dt").agg(F.sort_array(F.collect_list("fit")).alias("fits"))
    rows = cut(meta.join(member, ["target", "dt"]).select("x", "label", "fits"), "stack-rows")
    fits = fit_many(rows, {k: 1 / (c * sizes[w]) for k, w in enumerate(wanted)}, balanced)
    discard(rows)
    found = fit_table(scores, fits).join(ids, "fit")
    tested = found.join(roles.where("role = 'test'"), F.col("of") == F.col("fold")).groupBy("target", F.col("_dt").alias("dt"))
    tested = tested.agg(F.max_by(F.struct("intercept", "coefficients"), "of").alias("m"))
    p = probability("x", F.col("m.coefficients"), F.col("m.intercept"))
    out = meta.join(tested, ["target", "dt"], "left").select(*KEY, "label", F.coalesce(p, "mean").alias("p"))
    if apply is None:
        return out
    last = found.where("of is null").select("target", F.struct("intercept", "coefficients").alias("m"))
    return out.unionByName(described(apply).join(last, "target", "left").select(*KEY, "label", F.coalesce(p, "mean").alias("p")))


def best_by_precision(metrics: DataFrame, min_recall: Column | float = 0.0, prefix: str = "ens_") -> DataFrame:
    """The best blend of each target by precision, F1, then AUC, among those with enough recall, or all if none has."""
    rows = metrics.where(F.col("model").startswith(prefix))
    enough = (F.col("recall") >= min_recall) | F.col("recall").isNull()
    some = F.max(enough.cast("int")).over(W.partitionBy("target"))
    order = [F.desc_nulls_last(c) for c in ("precision", "f1", "auc")] + [F.asc("model")]
    ranked = rows.withColumn("_ok", enough | (some == 0)).where("_ok").withColumn("_n", F.row_number().over(W.partitionBy("target").orderBy(*order)))
    return ranked.where("_n = 1").drop("_ok", "_n")


def artifacts(best: DataFrame) -> DataFrame:
    """target, artifact: the best blend's strategy, and all that best says of it (threshold, metrics, when it was made) as JSON."""
    return best.select("target", F.to_json(F.struct(F.col("model").alias("strategy"), *(c for c in best.columns if c not in ("target", "model")))).alias("artifact"))
