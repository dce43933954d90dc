"""Training and scoring with Spark ML, many small regressions in one shuffle, and a registry of what is trained."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scratch import cut, discard
from ..functions.shipping import ship
from ..functions.sums import summed_products
from .logistic import fit_many, positives_up, probability
from .logistic import table as fit_table
from .metrics import average_precision, regression_metrics, threshold_quantile_f1
from .quality import blend_with_fallback, fallback_values, linear_calibration, model_quality, smart_fallback_rows
from .splits import undersample

#: Trials of each kind of classifier: the tuning budget for one target.
TRIALS = {"gbt": 12, "logistic": 10, "forest": 8, "tree": 8}
#: Rows that tuning sees at most; the fit that is kept sees all.
TUNING_ROWS = 180_000
#: Fits that run at a time, each a chain of distributed jobs.
AT_ONCE = 8
#: Rows of the tuning sample in a partition: tuning fits are many and small, so each has few tasks.
PART_ROWS = 60_000
#: Boosting rounds at most, and the share of the loss on valid rows that a round must take off; iterations of logistic regressions.
ROUNDS, GAIN, ITERATIONS = 100, 0.01, 100
#: Tuning grows one in so many of a forest's trees. Boosting trials race: after so many rounds so many of them go on.
THINNED, START, FINALISTS = 6, 5, 2
CLIP = 1e-6


def param_samples(groups: DataFrame, trials: dict[str, int] | None = None, seed: int = 42) -> DataFrame:
    """groups' columns, model, trial and random settings for each group (target, n) of rows to tune on and each trial.

    Settings come from MD5 draws over target, model and trial, log-uniform where scales matter. A leaf has 5 to 80 rows,
    but no more than a twentieth of the group's.
    """
    kinds = F.array(*(F.struct(F.lit(m).alias("model"), F.sequence(F.lit(0), F.lit(k - 1)).alias("trials")) for m, k in (trials or TRIALS).items()))
    rows = groups.select(*groups.columns, F.explode(kinds).alias("k")).select(*groups.columns, "k.model", F.explode("k.trials").alias("trial"))
    draw = lambda name: F.conv(F.substring(F.md5(F.concat_ws("|", "target", "model", F.col("trial").cast("string"), F.lit(f"{name}:{seed}"))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    spread = lambda u, low, high: F.exp(F.log(F.lit(low)) + u * (F.log(F.lit(high)) - F.log(F.lit(low))))
    return rows.select(
        *groups.columns,
        "model",
        "trial",
        F.when(F.col("model") == "gbt", 3 + F.floor(draw("depth") * 3)).otherwise(6 + F.floor(draw("depth") * 4)).cast("int").alias("depth"),
        F.when(F.col("model") == "gbt", ROUNDS).otherwise(120 + 60 * F.floor(draw("trees") * 3)).cast("int").alias("trees"),
        F.round(spread(draw("step"), 0.03, 0.3), 6).alias("step"),
        F.round(0.6 + 0.4 * draw("subsample"), 6).alias("subsample"),
        F.greatest(F.lit(1), F.least(F.floor(F.col("n") / 20), F.floor(spread(draw("leaf"), 5.0, 80.0)))).cast("int").alias("min_leaf"),
        F.round(spread(draw("reg"), 1e-4, 1.0), 8).alias("reg"),
    )


def _estimator(p: dict, tuning: bool):
    """What settings p ask for; rows with `held` tell boosting when to stop while tuning, and a final fit has as many rounds as that took."""
    if p["model"] == "gbt":
        stop = {"validationIndicatorCol": "held", "validationTol": GAIN} if tuning else {}
        return GBTClassifier(weightCol="weight", maxDepth=p["depth"], maxIter=p.get("rounds", p["trees"]), stepSize=p["step"], subsamplingRate=p["subsample"], minInstancesPerNode=p["min_leaf"], maxMemoryInMB=512, seed=42, **stop)
    if p["model"] == "forest":
        trees = max(1, p["trees"] // THINNED) if tuning else p["trees"]
        return RandomForestClassifier(weightCol="weight", maxDepth=p["depth"], numTrees=trees, subsamplingRate=p["subsample"], minInstancesPerNode=p["min_leaf"], featureSubsetStrategy="sqrt", maxMemoryInMB=512, seed=42)
    if p["model"] == "tree":
        return DecisionTreeClassifier(weightCol="weight", maxDepth=p["depth"], minInstancesPerNode=p["min_leaf"], maxMemoryInMB=512, seed=42)
    return LogisticRegression(weightCol="weight", regParam=p["reg"], maxIter=ITERATIONS)


def _weighted(rows: DataFrame, n: int, pos: int) -> DataFrame:
    """rows, of which n and pos positive, with weight: the positives' is negatives / positives, 1 at least."""
    return rows.withColumn("weight", F.when(F.col("label") == 1, positives_up(n, pos)[1]).otherwise(1.0))


def _positive() -> Column:
    return F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), vector_to_array("probability")[1]))


def score_classifier(model: PipelineModel, rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, p (clipped away from 0 and 1), label if there is one."""
    return model.transform(rows).select(*keys, _positive().alias("p"), *(["label"] if "label" in rows.columns else []))


def _tried(some: DataFrame, valid: DataFrame, weighted: Callable[[bool], DataFrame], params: list[dict], n: int, pos: int, pool: ThreadPoolExecutor, short: bool = False) -> tuple[list[dict], dict]:
    """(params of one kind with valid_ap, and rounds for boosting; the trials' models, but for logistic regressions).

    Trees are grown side by side; logistic regressions are fitted all at once. Boosting trials start with START rounds; only
    the FINALISTS best go on until rounds gain no more, and the others keep what they had. `weighted` gives the rows to grow
    on, with valid's beside them or without. `short` says that valid has no more rows than a partition.
    """
    kind = params[0]["model"]
    if kind == "logistic":
        penalties = {k: float(p["reg"]) for k, p in enumerate(params)}
        many = some.repartition(some.sparkSession.sparkContext.defaultParallelism)
        many = cut(many.select(vector_to_array("features").alias("x"), "label", F.array(*map(F.lit, penalties)).alias("fits")), "logistic-rows")
        found = fit_table(some, fit_many(many, penalties, positives_up)).withColumnRenamed("fit", "trial")
        discard(many)
        p = F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), probability()))
        rows = valid.select(vector_to_array("features").alias("x"), "label").join(F.broadcast(found), F.lit(True)).select("trial", p.alias("p"), "label")  # a row a trial
        precision = {r["trial"]: r["ap"] for r in average_precision(rows, ["trial"], whole=short).collect()}
        return [p | {"valid_ap": precision[k]} for k, p in enumerate(params)], {}

    share, data = inheritable_thread_target(some.sparkSession), weighted(kind == "gbt")
    models: dict[int, object] = {}

    def measured(wanted: list[int], rounds: int | None = None) -> dict[int, float]:
        fit = lambda k: _estimator(params[k] | ({"rounds": rounds} if rounds else {}), True).fit(data)
        models.update(zip(wanted, pool.map(share(fit), wanted), strict=True))
        rows = None
        for k in wanted:
            part = models[k].transform(valid).select(F.lit(k).alias("trial"), _positive().alias("p"), "label")
            rows = part if rows is None else rows.unionByName(part)
        return {r["trial"]: r["ap"] for r in average_precision(rows, ["trial"], whole=short).collect()}

    every = list(range(len(params)))
    precision = measured(every, START if kind == "gbt" else None)
    if kind == "gbt":
        precision |= measured(sorted(every, key=lambda k: (-precision[k], k))[:FINALISTS])
    return [p | {"valid_ap": precision[k]} | ({"rounds": models[k].getNumTrees} if kind == "gbt" else {}) for k, p in enumerate(params)], models


def fit_classifiers(train: DataFrame, valid: DataFrame, features: list[str], params: list[dict], keys: list[str], refit: bool = True, before: dict[str, PipelineModel] | None = None) -> dict[str, tuple[PipelineModel, dict]]:
    """For each kind of model, the trial with the best average precision on valid, fitted again on both sets.

    Its info holds that precision, the first of the best trials' settings, and the threshold with the best F1 on valid, asked
    of a fit on the trials' rows. Features become vectors in one table that all fits read. Trials see TUNING_ROWS at
    most, by a hash of keys. The kinds train beside each other, AT_ONCE fits of a kind together, and a kind's last fit starts
    as soon as its own trials are done, its threshold being found meanwhile. No trial can be fitted on one class. `before`, if given, is filled with the models of
    each kind that were asked for the threshold and haven't seen valid.
    """
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    both = train.withColumn("held", F.lit(False)).unionByName(valid.withColumn("held", F.lit(True)))
    both = cut(assembler.transform(both).select(*keys, F.col("label").cast("double").alias("label"), "held", "features"), "vectors")
    sizes = {r["held"]: (r["n"], int(r["pos"])) for r in both.groupBy("held").agg(F.count("*").alias("n"), F.sum("label").alias("pos")).collect()}
    if len(sizes) < 2 or not 0 < sizes[False][1] < sizes[False][0]:
        discard(both)
        return {}
    of = lambda df: df.select("features", "label")
    known = both.where("not held")
    some = of(undersample(known, "label", keys, TUNING_ROWS, TUNING_ROWS, 4.0)).persist()
    n, pos = some.agg(F.count("*"), F.sum("label")).first()
    few = lambda df, rows: df.coalesce(max(1, -(-rows // PART_ROWS))).persist()
    some, held = few(some, n), few(of(both.where("held")), sizes[True][0])
    whole = _weighted(of(both if refit else known), *(map(sum, zip(*sizes.values(), strict=True)) if refit else sizes[False]))
    cores = train.sparkSession.sparkContext.defaultParallelism
    whole = (whole.repartition(cores) if whole.rdd.getNumPartitions() < cores else whole).persist()
    chained = few(whole, sum(size for size, _ in sizes.values()) if refit else sizes[False][0])  # a boosted tree's passes are many and short
    short = sizes[True][0] <= PART_ROWS
    share = inheritable_thread_target(train.sparkSession)
    n, pos = int(n), int(pos)
    grown = _weighted(some, n, pos).persist()
    boosted = _weighted(some, n, pos).withColumn("held", F.lit(False)).unionByName(_weighted(held, n, pos).withColumn("held", F.lit(True)))
    boosted = boosted.coalesce(some.rdd.getNumPartitions()).persist()

    def kind(name: str) -> tuple[dict, object, object]:
        """(the best trial with its threshold, its model, the same fitted on all rows)."""
        with ThreadPoolExecutor(AT_ONCE) as pool:
            tried, models = _tried(some, held, lambda both: boosted if both else grown, [p for p in params if p["model"] == name], n, pos, pool, short)
            k = max(range(len(tried)), key=lambda k: (tried[k]["valid_ap"], -k))
            final = pool.submit(share(lambda: _estimator(tried[k], False).fit(chained if name == "gbt" else whole)))
            judged = models[k] if k in models else _estimator(tried[k], False).fit(grown)
            scored = judged.transform(held).select(F.lit(name).alias("model"), _positive().alias("p"), "label")
            threshold = threshold_quantile_f1(scored, ["model"], whole=short).first()["threshold"]
            return tried[k] | {"threshold": threshold}, judged, final.result()

    names = sorted({p["model"] for p in params}, key=lambda name: (name != "gbt", name))  # boosting, the longest chain, first
    with ThreadPoolExecutor(max(1, len(names))) as kinds:
        done = dict(zip(names, kinds.map(share(kind), names), strict=True))
    best, judged, final = ({name: d[k] for name, d in done.items()} for k in range(3))
    for table in (some, held, whole, chained, grown, boosted):
        table.unpersist()
    discard(both)
    if before is not None:
        before.update({name: PipelineModel([assembler, m]) for name, m in judged.items()})
    return {name: (PipelineModel([assembler, final[name]]), p) for name, p in best.items()}


def score_all(models: dict[str, tuple[PipelineModel, dict]], rows: DataFrame, wanted: list[str], keys: list[str]) -> DataFrame:
    """keys, model, p, pred for every wanted model: pred is 1 from the model's own threshold on; a missing model scores 0."""
    out = None
    for name in wanted:
        if name in models:
            model, info = models[name]
            part = score_classifier(model, rows, keys).select(*keys, F.lit(name).alias("model"), "p", (F.col("p") >= float(info["threshold"])).cast("int").alias("pred"))
        else:
            part = rows.select(*keys, F.lit(name).alias("model"), F.lit(0.0).alias("p"), F.lit(0).alias("pred"))
        out = part if out is None else out.unionByName(part)
    return out


#: Kinds of regression, by what they see, and the random settings tried for each (ticker, target, kind).
KINDS, CONFIGS = ("linear", "quadratic"), 4
MIN_TRAIN, MIN_VALID = 500, 50


def _terms(features: list[str]) -> list[Column]:
    """1, the features, and their squares."""
    x = [F.col(f).cast("double") for f in features]
    return [F.lit(1.0), *x, *(v * v for v in x)]


def _sums(rows: DataFrame, features: list[str]) -> DataFrame:
    """ticker, target, n, xx (products of terms, the upper triangle by rows), xy: all that a ridge regression needs."""
    terms = [t.alias(f"t{i}") for i, t in enumerate(_terms(features))]
    k = len(terms)
    made = summed_products(rows.where("y is not null").select("ticker", "target", F.col("y").alias("y"), *terms), ["ticker", "target"], ["y", *(f"t{i}" for i in range(k))])
    at = 2 + k  # after the number of rows and the sums of y and the terms: y with itself and the terms, then the terms'
    return made.select("ticker", "target", F.col("sums")[0].cast("long").alias("n"), F.slice("sums", at + k + 2, k * (k + 1) // 2).alias("xx"), F.slice("sums", at + 2, k).alias("xy"))


def _ridge_of(ticker: str, target: str, kind: str, config: int) -> float:
    """The penalty of a configuration, log-uniform from 1e-4 to 1 by MD5."""
    u = int(hashlib.md5(f"{ticker}|{target}|{kind}|{config}".encode()).hexdigest()[:13], 16) / (1 << 52)
    return float(np.exp(np.log(1e-4) * (1 - u)))


def solved(xx: np.ndarray, xy: np.ndarray, used: int, ridge: float) -> np.ndarray:
    """Coefficients of the first `used` terms (the others 0), standardised for the penalty; the constant goes without."""
    k = len(xy)
    a = np.zeros((k, k))
    a[np.triu_indices(k)] = xx
    a = (a + np.triu(a, 1).T)[:used, :used]
    scale = np.sqrt(np.maximum(np.diag(a), 1e-12))
    a = a / np.outer(scale, scale) + ridge * np.diag([0.0] + [1.0] * (used - 1))
    return np.concatenate((np.linalg.lstsq(a, xy[:used] / scale, rcond=None)[0] / scale, np.zeros(k - used)))


_MODELS = "ticker string, target string, model string, config int, ridge double, n long, coefficients array<double>"


def _candidates(sums: DataFrame, n_features: int, chosen: bool) -> DataFrame:
    """_MODELS: every configuration of every kind, or with `chosen` those that columns model and config name."""

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                for kind, config in [(r["model"], r["config"])] if chosen else [(kind, c) for kind in KINDS for c in range(CONFIGS)]:
                    ridge = _ridge_of(r["ticker"], r["target"], kind, int(config))
                    used = 1 + n_features * (1 if kind == "linear" else 2)
                    w = solved(np.array(r["xx"], float), np.array(r["xy"], float), used, ridge)
                    out.append((r["ticker"], r["target"], kind, int(config), ridge, int(r["n"]), w.tolist()))
            yield pd.DataFrame(out, columns=["ticker", "target", "model", "config", "ridge", "n", "coefficients"])

    ship(sums.sparkSession)
    return sums.mapInPandas(solve, _MODELS)


#: What the boosted regressions of a target may look like, by configuration.
BOOSTED = "boosted"
#: Tickers up to so many are a category for boosting; beyond, their number in the order of names is a feature like others.
CATEGORIES = 256


def _boosted_settings(target: str, config: int) -> dict:
    """Depth 3 to 5, step log-uniform from .03 to .3, share of rows .6 to 1, leaves of 5 to 40 rows, by MD5."""
    u = [int(hashlib.md5(f"{target}|{BOOSTED}|{config}|{k}".encode()).hexdigest()[:13], 16) / (1 << 52) for k in range(4)]
    return {"maxDepth": 3 + int(u[0] * 3), "stepSize": float(0.03 * 10 ** u[1]), "subsamplingRate": 0.6 + 0.4 * u[2], "minInstancesPerNode": int(5 * 8 ** u[3])}


def fit_boosted(train: DataFrame, valid: DataFrame, features: list[str]) -> dict[str, tuple[PipelineModel, PipelineModel, dict]]:
    """For each target of train: boosted trees over all tickers, fitted on train, and the same fitted on both sets; and what is said of them.

    The ticker is a category among the features. All of a target's CONFIGS start with START rounds; the one with the least
    squared error on valid goes on until rounds gain no more there, and its final fit has as many rounds.
    """
    rows = train.withColumn("held", F.lit(False)).unionByName(valid.withColumn("held", F.lit(True))).where("y is not null")
    indexer = StringIndexer(inputCol="ticker", outputCol="_ticker", handleInvalid="keep").fit(rows)
    many = len(indexer.labels) + 1
    assembler = VectorAssembler(inputCols=["_ticker" if many <= CATEGORIES else "_number", *features], outputCol="features", handleInvalid="keep")
    number = SQLTransformer(statement="SELECT *, _ticker + 0.0 AS _number FROM __THIS__")  # an expression drops the category's names
    table = cut(assembler.transform(number.transform(indexer.transform(rows))).select("target", "features", "y", "held"), "pooled-vectors")
    sizes = {r["target"]: r for r in table.groupBy("target").agg(F.count_if("held").alias("held"), F.count_if(~F.col("held")).alias("known")).collect()}
    targets = sorted(t for t, r in sizes.items() if r["held"] and r["known"])
    of = {t: table.where(F.col("target") == t).coalesce(max(1, -(-(sizes[t]["held"] + sizes[t]["known"]) // PART_ROWS))).persist() for t in targets}
    # Where each feature was is part of the vectors' description, which a table doesn't keep.
    kind = assembler.transform(number.transform(indexer.transform(rows.limit(0)))).schema["features"].metadata
    of = {t: df.withMetadata("features", kind) for t, df in of.items()}
    share = inheritable_thread_target(train.sparkSession)

    def grow(target: str, config: int, rounds: int, early: bool):
        stop = {"validationIndicatorCol": "held", "validationTol": GAIN} if early else {}
        return GBTRegressor(labelCol="y", maxIter=rounds, maxBins=max(32, min(many, CATEGORIES)), maxMemoryInMB=512, seed=42, **stop, **_boosted_settings(target, config)).fit(of[target])

    def error(model, target: str) -> float:
        return model.transform(of[target].where("held")).agg(F.avg((F.col("prediction") - F.col("y")) ** 2)).first()[0]

    found = {}
    with ThreadPoolExecutor(AT_ONCE) as pool:
        trials = [(t, c) for t in targets for c in range(CONFIGS)]
        errors = dict(zip(trials, pool.map(share(lambda x: error(grow(*x, START, True), x[0])), trials), strict=True))
        best = {t: min(range(CONFIGS), key=lambda c: (errors[t, c], c)) for t in targets}
        known = list(pool.map(share(lambda t: grow(t, best[t], ROUNDS, True)), targets))
        whole = list(pool.map(share(lambda x: grow(x[0], best[x[0]], x[1].getNumTrees, False)), zip(targets, known, strict=True)))
    for t, a, b in zip(targets, known, whole, strict=True):
        of[t].unpersist()
        stages = [indexer, number, assembler]
        found[t] = PipelineModel([*stages, a]), PipelineModel([*stages, b]), {"config": best[t], "rounds": a.getNumTrees} | _boosted_settings(t, best[t])
    discard(table)
    return found


def apply_boosted(models: dict[str, tuple[PipelineModel, int]], rows: DataFrame, keep: list[str] = []) -> DataFrame | None:  # noqa: B006
    """dt, ticker, target, model, config, ridge (0), keep, pred: each target's (pipeline, configuration) on its rows; None without models."""
    out = None
    for target, (model, config) in sorted(models.items()):
        part = model.transform(rows.where(F.col("target") == target)).select("dt", "ticker", "target", F.lit(BOOSTED).alias("model"), F.lit(config).alias("config"), F.lit(0.0).alias("ridge"), *keep, F.col("prediction").alias("pred"))
        out = part if out is None else out.unionByName(part)
    return out


def valid_forecasts(train: DataFrame, valid: DataFrame, features: list[str], boosted: dict[str, tuple[PipelineModel, int]] | None = None) -> DataFrame:
    """dt, ticker, target, model, config, ridge, y, pred: what every configuration, fitted on train, says of valid rows.

    Groups have MIN_TRAIN rows in train and MIN_VALID in valid at least.
    """
    enough = train.groupBy("ticker", "target").agg(F.count("y").alias("a")).join(valid.groupBy("ticker", "target").agg(F.count("y").alias("b")), ["ticker", "target"])
    enough = cut(enough.where((F.col("a") >= MIN_TRAIN) & (F.col("b") >= MIN_VALID)).select("ticker", "target"), "enough-rows")
    tried = _candidates(_sums(train, features).join(enough, ["ticker", "target"], "left_semi"), len(features), False)
    columns = ["dt", "ticker", "target", "model", "config", "ridge", "y", "pred"]
    rows = apply_regressors(tried, valid, features, ["y", "config", "ridge"]).select(*columns)
    pooled = apply_boosted(boosted or {}, valid, ["y"])
    if pooled is not None:
        rows = rows.unionByName(pooled.join(enough, ["ticker", "target"], "left_semi").select(*columns))
    return rows.where("y is not null")


def tune_regressors(train: DataFrame, valid: DataFrame, features: list[str], gate: bool = True, forecasts: DataFrame | None = None) -> DataFrame:
    """ticker, target, model, config, ridge, mae, rmse, r2, quality_score: for each group and kind, the best on valid.

    Of a kind's configurations, those that the quality gate lets through compete (with gate), by RMSE, then by number; a
    kind of which none passes has no row. Forecasts are those of `valid_forecasts`, boosted trees among them if given.
    """
    rows = valid_forecasts(train, valid, features) if forecasts is None else forecasts
    by = ["ticker", "target", "model", "config", "ridge"]
    measured = regression_metrics(rows, by).join(model_quality(rows, by).select(*by, "quality_score", "is_valid"), by)
    if gate:
        measured = measured.where("is_valid")
    best = F.row_number().over(W.partitionBy("ticker", "target", "model").orderBy("rmse", "config"))
    return measured.withColumn("_nth", best).where("_nth = 1").select(*by, "mae", "rmse", "r2", "quality_score")


def fit_regressors(rows: DataFrame, features: list[str], tuned: DataFrame) -> DataFrame:
    """ticker, target, model, config, ridge, n, coefficients: the ridge regressions that tuned names, fitted on rows, from sums of products.

    The sums combine before the one shuffle; what is solved per group is a matrix of the terms' number.
    """
    named = tuned.where(F.col("model").isin(*KINDS)).select("ticker", "target", "model", "config")
    return _candidates(_sums(rows, features).join(named, ["ticker", "target"]), len(features), True)


def apply_regressors(models: DataFrame, rows: DataFrame, features: list[str], keep: list[str] = []) -> DataFrame:  # noqa: B006
    """dt, ticker, target, model, keep, pred: each ticker's regressions on its rows; rows that have a target meet those of it."""
    on = ["ticker", "target"] if "target" in rows.columns else ["ticker"]
    dot = F.aggregate(F.zip_with("coefficients", F.array(*_terms(features)), lambda c, v: c * v), F.lit(0.0), lambda a, v: a + v)
    return rows.join(models, on).select("dt", "ticker", "target", "model", *keep, dot.alias("pred"))


def finished_forecasts(raw: DataFrame, forecasts: DataFrame, tuned: DataFrame, known: DataFrame, dates: DataFrame) -> DataFrame:
    """dt, ticker, target, model, pred_pct, alpha, quality_score, used_fallback: forecasts as they are handed out.

    raw (dt, ticker, target, model, pred) are what the final fits say. Each is calibrated by what its kind said of valid rows
    (forecasts), drawn to the group's fallback the more the lower its quality, and clipped. Groups of known (dt, ticker,
    target, y) that have no model get the fallback itself on each of dates (dt).
    """
    by = ["ticker", "target", "model"]
    chosen = forecasts.join(tuned.select(*by, "config"), [*by, "config"], "left_semi")
    fallbacks = fallback_values(known.where("y is not null"))
    made = blend_with_fallback(raw.join(tuned.select(*by), by, "left_semi"), linear_calibration(chosen), model_quality(chosen), fallbacks)
    wanted = dates.select("dt").distinct().join(known.select("ticker", "target").distinct(), F.lit(True))  # as many as the result has rows
    columns = ["dt", *by, "pred_pct", "alpha", "quality_score", "used_fallback"]
    return made.select(*columns).unionByName(smart_fallback_rows(wanted, tuned, fallbacks).select(*columns))


#: Held while a version is numbered and registered: appends to one table at a time would clear each other's files.
_REGISTERING = Lock()


class ModelStore:
    """Fitted models in a folder, and a table of their keys, versions, settings and scores; the latest version counts.

    Pipelines are kept by (target, model), and many small models by (ticker, target, model) in one table.
    """

    SCHEMA = "target string, model string, version long, path string, params map<string,string>, valid_ap double"
    SCORES = "target string, model string, version long, dt date, ticker string, p double"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        """All rows of a table of the store; none where nothing is stored yet."""
        if not self._exists(f"{self.folder}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def _exists(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def save(self, target: str, name: str, model: PipelineModel, info: dict, before: PipelineModel | None = None) -> int:
        """Adds a version of a pipeline and returns its number; earlier ones stay. `before` is the same before its fit on all rows."""
        return self.save_all(target, {name: (model, info, before)})[name]

    def save_all(self, target: str, models: dict[str, tuple]) -> dict[str, int]:
        """Adds a version of each pipeline by name, (model, info) or (model, info, before): files side by side, then all rows at once."""
        write = lambda job: job[0].write().overwrite().save(job[1])
        with _REGISTERING:
            of = {r["model"]: r["version"] for r in self.registry().where(F.col("target") == target).select("model", "version").collect()}
            version = {name: 1 + of.get(name, 0) for name in models}
            path = {name: f"{self.folder}/pipelines/{target}/{name}/{v}" for name, v in version.items()}
            jobs = [(model, path[name]) for name, (model, *_) in models.items()]
            jobs += [(m[2], f"{path[name]}-before") for name, m in models.items() if m[2:] and m[2] is not None]
            with ThreadPoolExecutor(AT_ONCE) as pool:
                list(pool.map(inheritable_thread_target(self.spark)(write), jobs))
            rows = [(target, name, version[name], path[name], {k: str(v) for k, v in m[1].items()}, float(m[1].get("valid_ap", float("nan")))) for name, m in models.items()]
            self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/registry")
        return version

    def registry(self) -> DataFrame:
        """The latest version of each (target, model)."""
        nth = F.row_number().over(W.partitionBy("target", "model").orderBy(F.desc("version"), "path"))
        return self._table("registry", self.SCHEMA).withColumn("_nth", nth).where("_nth = 1").drop("_nth")

    def load(self, target: str, name: str) -> tuple[PipelineModel, dict]:
        """The latest version of a pipeline, and its info; KeyError where there is none."""
        row = self.registry().where((F.col("target") == target) & (F.col("model") == name)).first()
        if row is None:
            raise KeyError((target, name))
        return PipelineModel.load(row["path"]), dict(row["params"]) | {"valid_ap": row["valid_ap"]}

    def missing(self, wanted: DataFrame) -> DataFrame:
        """What of wanted (target, model) isn't registered yet."""
        return wanted.join(self.registry().select("target", "model"), ["target", "model"], "left_anti")

    def models(self, target: str, names: list[str], fit: Callable[[list[str]], dict[str, tuple]], mode: str = "auto") -> dict[str, tuple[PipelineModel, dict]]:
        """The models of a target by name. Mode `load` takes what is stored, `train` fits all anew, `auto` fits what is missing; fit gives (model, info) or (model, info, model before its refit)."""
        have = {r["model"] for r in self.registry().where(F.col("target") == target).select("model").collect()} if mode != "train" else set()
        wanted = [n for n in names if n not in have] if mode != "load" else []
        if found := fit(wanted) if wanted else {}:
            self.save_all(target, found)
            have |= set(found)
        kept = [n for n in names if n in have]
        with ThreadPoolExecutor(AT_ONCE) as pool:
            return dict(zip(kept, pool.map(inheritable_thread_target(self.spark)(lambda n: self.load(target, n)), kept), strict=True))

    def scores(self, target: str, rows: DataFrame, held: Column) -> DataFrame:
        """target, model, version, dt, ticker, p: what the latest version of each of the target's models says of rows (dt, ticker, features).

        A table of the store keeps scores by version and date. Only dates that a version hasn't scored are scored, and added
        to it. Rows that are `held` go by the model before its refit, where one is stored, so that it hasn't seen them. A row
        that repeats a dt and ticker counts once.
        """
        have, new, key = self._table("scores", self.SCORES), None, ["target", "model", "version", "dt", "ticker"]
        versions = self.registry().where(F.col("target") == target).select("target", "model", "version", "path")
        found = versions.collect()  # one a kind of model
        before = {r["path"]: f"{r['path']}-before" for r in found if self._exists(f"{r['path']}-before")}
        paths = [*(r["path"] for r in found), *before.values()]
        with ThreadPoolExecutor(AT_ONCE) as pool:
            models = dict(zip(paths, pool.map(inheritable_thread_target(self.spark)(PipelineModel.load), paths), strict=True))
        for r in found:
            of = {c: r[c] for c in ("target", "model", "version")}
            done = have.where(" and ".join(f"{c} = {v!r}" for c, v in of.items())).select("dt").distinct()
            todo, own = rows.join(done, "dt", "left_anti"), before.get(r["path"])
            parts = [(todo.where(held), own), (todo.where(~held), r["path"])] if own else [(todo, r["path"])]
            for part, path in parts:
                part = score_classifier(models[path], part, ["dt", "ticker"]).select(*(F.lit(v).alias(c) for c, v in of.items()), F.col("dt").cast("date").alias("dt"), "ticker", "p")
                new = part if new is None else new.unionByName(part)
        if new is not None:
            new.dropDuplicates(key).withColumn("version", F.col("version").cast("long")).write.mode("append").parquet(f"{self.folder}/scores")
        kept = self._table("scores", self.SCORES).join(F.broadcast(versions.drop("path")), ["target", "model", "version"], "left_semi")
        return kept.join(rows.select(F.col("dt").cast("date").alias("dt"), "ticker").distinct(), ["dt", "ticker"], "left_semi").dropDuplicates(key).select(*key, "p")

    def save_regressors(self, models: DataFrame) -> None:
        """Adds a version of every (ticker, target, model) of models."""
        version = 1 + (self._table("regressors", f"{_MODELS}, version long").agg(F.max("version")).first()[0] or 0)
        models.withColumn("version", F.lit(version).cast("long")).write.mode("append").parquet(f"{self.folder}/regressors")

    def regressors(self) -> DataFrame:
        """The latest version of each (ticker, target, model)."""
        nth = F.row_number().over(W.partitionBy("ticker", "target", "model").orderBy(F.desc("version"), "config"))
        return self._table("regressors", f"{_MODELS}, version long").withColumn("_nth", nth).where("_nth = 1").drop("_nth")

    def missing_regressors(self, wanted: DataFrame) -> DataFrame:
        """What of wanted (ticker, target, model) isn't stored yet."""
        return wanted.join(self.regressors().select("ticker", "target", "model"), ["ticker", "target", "model"], "left_anti")
