"""The final report: best models, prices, class scores and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The report's columns in order.
REPORT = ["dt", "ticker", "close", "proba_up", "pred_up", "proba_down", "pred_down", "pred_best_entry", "pred_best_sale", "r2_entry", "rmse_entry", "r2_sale", "rmse_sale"]


def top_k_per_day(scores: DataFrame, k: int = 20, by: list[str] = ["dt"]) -> DataFrame:  # noqa: B006
    """The k greatest scores of each day (or of what `by` names) with their rank; ties go by ticker."""
    order = W.partitionBy(*by).orderBy(F.desc("p"), "ticker")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_model_per_ticker(metrics: DataFrame) -> DataFrame:
    """ticker, target, model, mae, rmse, r2 of the least RMSE, the first name on ties; NaN is passed over."""
    order = W.partitionBy("ticker", "target").orderBy(F.asc_nulls_last("rmse"), "model")
    ok = metrics.where(F.col("rmse").isNotNull() & ~F.isnan("rmse"))
    return ok.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("ticker", "target", "model", "mae", "rmse", "r2")


def join_best(predictions: DataFrame, best: DataFrame) -> DataFrame:
    """The forecasts of each ticker's and target's best model; the best models are a row for each, so they are left to size."""
    return predictions.join(best.select("ticker", "target", "model"), ["ticker", "target", "model"])


def pivot_targets(predictions: DataFrame) -> DataFrame:
    """dt, ticker, pred_best_entry, pred_best_sale from pred_price; rows with neither go."""
    wide = predictions.groupBy("dt", "ticker").pivot("target", ["best_entry", "best_sale"]).agg(F.first("pred_price", ignorenulls=True))
    return wide.select("dt", "ticker", F.col("best_entry").alias("pred_best_entry"), F.col("best_sale").alias("pred_best_sale")).where("coalesce(pred_best_entry, pred_best_sale) is not null")


def metrics_by_ticker(best: DataFrame) -> DataFrame:
    pick = lambda c, t: F.max(F.when(F.col("target") == t, F.col(c)))
    return best.groupBy("ticker").agg(pick("r2", "best_entry").alias("r2_entry"), pick("rmse", "best_entry").alias("rmse_entry"), pick("r2", "best_sale").alias("r2_sale"), pick("rmse", "best_sale").alias("rmse_sale"))


def class_scores_wide(blends: DataFrame, threshold: float = 0.5) -> DataFrame:
    """dt, ticker, proba_* and pred_* for targets up and down."""
    wide = blends.groupBy("dt", "ticker").pivot("target", ["up", "down"]).agg(F.first("p"))
    return wide.select("dt", "ticker", *(c for t in ("up", "down") for c in (F.col(t).alias(f"proba_{t}"), (F.col(t) >= threshold).cast("int").alias(f"pred_{t}"))))


def consolidated(prices: DataFrame, classes: DataFrame, predictions: DataFrame, best: DataFrame) -> DataFrame:
    """prices (dt, ticker, close) with class scores, both forecasts and their models' metrics, in REPORT's order."""
    rows = prices.join(classes, ["dt", "ticker"], "left").join(pivot_targets(predictions), ["dt", "ticker"], "left").join(metrics_by_ticker(best), "ticker", "left")
    return rows.select(*(c for c in REPORT if c in rows.columns)).orderBy("dt", "ticker")


def report_stats(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count("*").alias("rows"), F.min("dt").alias("first"), F.max("dt").alias("last"), F.countDistinct("ticker").alias("tickers"), F.round(F.avg("close"), 4).alias("mean_close"), F.round(F.avg("r2_entry"), 6).alias("mean_r2_entry"), F.round(F.avg("rmse_entry"), 6).alias("mean_rmse_entry")
    )


def model_counts(best: DataFrame) -> DataFrame:
    counts = best.groupBy("target", "model").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("target")), 6))


def top_by_r2(best: DataFrame, k: int = 10) -> DataFrame:
    return best.groupBy("ticker").agg(F.round(F.avg("r2"), 6).alias("mean_r2")).orderBy(F.desc("mean_r2"), "ticker").limit(k)
