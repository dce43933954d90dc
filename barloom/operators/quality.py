"""Regression forecasts: calibration, quality gate, fallbacks and their blend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .fill import asset_type, finite
from .guards import with_columns_of, with_rows

#: Clips by target, error limits by asset type, and the variance below which a target counts as flat.
CLIPS = {"best_entry": (-0.20, 0.30), "best_sale": (0.05, 0.40)}
MAX_RMSE, MAX_RMSE_INDEX, MAX_MAE, MIN_R2, LOW_VARIANCE = 0.25, 0.35, 0.20, -1.0, 1e-4
MODEL = ["ticker", "target", "model"]


def fallback_values(targets: DataFrame, rows: int = 30) -> DataFrame:
    """ticker, target, rolling_mean (of the last rows, without nulls), last_pred (the last value)."""
    recent = F.row_number().over(W.partitionBy("ticker", "target").orderBy(F.desc("dt"))) <= rows
    marked = targets.withColumn("recent", recent)
    return marked.groupBy("ticker", "target").agg(F.avg(F.when(F.col("recent"), F.col("y"))).alias("rolling_mean"), F.max_by("y", F.when(F.col("y").isNotNull(), F.col("dt"))).alias("last_pred"))


def low_variance(targets: DataFrame, least: float = LOW_VARIANCE) -> DataFrame:
    return targets.groupBy("ticker", "target").agg(F.var_samp("y").alias("variance")).where(F.col("variance") < least)


def linear_calibration(rows: DataFrame) -> DataFrame:
    """MODEL, slope, intercept of y on pred: (1, 0) for fewer than 3 pairs, (1, difference of means) for a flat pred, slope kept in [.2, 1.8]."""
    ok = rows.where(finite(F.col("y")).isNotNull() & finite(F.col("pred")).isNotNull())
    sums = ok.groupBy(*MODEL).agg(F.count("*").alias("n"), F.var_pop("pred").alias("v"), F.regr_slope("y", "pred").alias("s"), F.regr_intercept("y", "pred").alias("i"), (F.avg("y") - F.avg("pred")).alias("d"))
    few, flat = F.col("n") < 3, F.col("v") < 1e-8
    slope = F.when(few | flat, 1.0).otherwise(F.least(F.lit(1.8), F.greatest(F.lit(0.2), "s")))
    return sums.select(*MODEL, slope.alias("slope"), F.when(few, 0.0).when(flat, F.col("d")).otherwise(F.col("i")).alias("intercept"))


def model_quality(rows: DataFrame, by: list[str] = MODEL) -> DataFrame:  # noqa: B006
    """by (the ticker among it), errors relative to the range of y, quality_score, is_valid and reasons."""
    e = F.col("y") - F.col("pred")
    s = rows.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop("y").alias("y_var"), (F.max("y") - F.min("y") + 1e-9).alias("span"), F.count("*").alias("n"))
    s = s.select(*by, asset_type(F.col("ticker")).alias("asset_type"), (F.col("mae") / F.col("span")).alias("mae_pct"), (F.sqrt("mse") / F.col("span")).alias("rmse_pct"), F.when(F.col("y_var") * F.col("n") > 1e-12, 1 - F.col("mse") / F.col("y_var")).otherwise(0.0).alias("r2"), "y_var")
    flat = F.col("y_var") < LOW_VARIANCE
    limit = F.when(F.col("asset_type") == "index_commodity", MAX_RMSE_INDEX).otherwise(MAX_RMSE)
    bad = {"r2": F.col("r2") < MIN_R2, "rmse": F.col("rmse_pct") > limit, "mae": F.col("mae_pct") > MAX_MAE}
    off = lambda q, cond, x: F.when(cond, F.greatest(F.lit(0.0), q - x)).otherwise(q)
    score = off(off(off(F.lit(1.0), bad["r2"], 0.3), bad["rmse"], 0.4), bad["mae"], 0.3)
    score = F.when(flat, 0.8).otherwise(score) + F.when(F.col("r2") > 0.3, 0.2).when(F.col("r2") > 0, 0.1).otherwise(0.0)
    reasons = F.when(flat, F.array(F.lit("low variance"))).otherwise(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in bad.items()))))
    return s.select(*by, "asset_type", "mae_pct", "rmse_pct", "r2", F.least(F.lit(1.0), score).alias("quality_score"), (flat | ~(bad["r2"] | bad["rmse"] | bad["mae"])).alias("is_valid"), F.array_join(reasons, ",").alias("reasons"))


def clipped(x: Column, target: Column) -> Column:
    low, high = (F.when(target == "best_entry", CLIPS["best_entry"][k]).otherwise(CLIPS["best_sale"][k]) for k in (0, 1))
    return F.least(high, F.greatest(low, x))


def blend_with_fallback(rows: DataFrame, calibration: DataFrame, quality: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """dt, MODEL, pred_pct, alpha: the calibrated forecast, drawn to the fallback the more the lower its quality, clipped."""
    joined = rows.join(calibration, MODEL).join(quality.select(*MODEL, "quality_score"), MODEL).join(fallbacks, ["ticker", "target"], "left")
    alpha = F.least(F.lit(1.0), F.greatest(F.lit(0.2), "quality_score"))
    pred = F.col("pred") * F.col("slope") + F.col("intercept")
    value = F.coalesce("last_pred", "rolling_mean")
    mixed = F.when(value.isNotNull(), alpha * pred + (1 - alpha) * value).otherwise(pred)
    return joined.select("dt", *MODEL, clipped(mixed, F.col("target")).alias("pred_pct"), alpha.alias("alpha"), "quality_score", F.lit(False).alias("used_fallback"))


def smart_fallback_rows(wanted: DataFrame, models: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """dt, MODEL, pred_pct, ... for (ticker, target) pairs of wanted (dt, ticker, target) that have a fallback but no model."""
    missing = wanted.join(models.select("ticker", "target").distinct(), ["ticker", "target"], "left_anti")
    joined = missing.join(fallbacks, ["ticker", "target"])
    return joined.select("dt", "ticker", "target", F.lit("smart_fallback_last").alias("model"), clipped(F.coalesce("last_pred", "rolling_mean"), F.col("target")).alias("pred_pct"), F.lit(0.0).alias("alpha"), F.lit(0.5).alias("quality_score"), F.lit(True).alias("used_fallback"))


def quality_filter(predictions: DataFrame, least: float = 0.7, strict: bool = False) -> DataFrame:
    """Forecasts of enough quality that aren't fallbacks; with strict, ValueError where a column is missing or none is left."""
    if strict:
        with_columns_of(predictions, ["quality_score", "used_fallback"], "forecasts")
    good = predictions.where((F.col("quality_score") >= least) & ~F.col("used_fallback"))
    return with_rows(good, "forecasts of enough quality") if strict else good
