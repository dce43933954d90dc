"""Bars in and out: from ticks, from files, repaired, and back to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ["open", "high", "low", "close", "adj_close", "volume"]
BARS_SCHEMA = "ticker string, dt date, open double, high double, low double, close double, adj_close double, volume double"


def bars_from_ticks(ticks: DataFrame, ticker: str, day: Column, price: str, quantity: str, order: list[str]) -> DataFrame:
    """One bar per ticker and day; open and close are the prices at the least and greatest `order` values. One aggregate.

    Keys that are structs make Spark sort the ticks; a hash of the group comes first, since a sort compares long numbers fastest.
    """
    key = F.struct(*order)
    bars = ticks.groupBy(F.xxhash64(F.col(ticker), day).alias("_h"), F.col(ticker).alias("ticker"), day.alias("dt")).agg(
        F.min_by(price, key).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, key).alias("close"),
        F.sum(quantity).alias("volume"),
    )
    return bars.drop("_h")


def scan_bars(bars: DataFrame, tickers: DataFrame, start: str, fields: list[str]) -> DataFrame:
    """The fields of the tickers listed, from a start date on; the filter and the columns reach the scan."""
    return bars.where(F.col("dt") >= F.lit(start).cast("date")).join(tickers.select("ticker"), "ticker", "left_semi").select("ticker", "dt", *fields)


def repair_schema(raw: DataFrame) -> DataFrame:
    """Missing adj_close and open come from close, missing volume is 0; columns that are absent count as missing."""
    have = lambda c: F.col(c).cast("double") if c in raw.columns else F.lit(None).cast("double")
    return raw.select(
        "ticker",
        "dt",
        F.coalesce(have("open"), have("close")).alias("open"),
        have("high").alias("high"),
        have("low").alias("low"),
        have("close").alias("close"),
        F.coalesce(have("adj_close"), have("close")).alias("adj_close"),
        F.coalesce(have("volume"), F.lit(0.0)).alias("volume"),
    )


def skip_reasons(repaired: DataFrame) -> DataFrame:
    """reason, tickers: how many tickers lack which of close, high and low altogether (`ok` for none)."""
    flags = repaired.groupBy("ticker").agg(*(F.count(c).alias(c) for c in ("close", "high", "low")))
    lacking = F.array_join(F.array_compact(F.array(*(F.when(F.col(c) == 0, F.lit(c)) for c in ("close", "high", "low")))), ",")
    return flags.select(F.when(lacking == "", "ok").otherwise(F.concat(F.lit("missing "), lacking)).alias("reason")).groupBy("reason").agg(F.count("*").alias("tickers"))


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """A panel from Parquet with dt as a date."""
    return spark.read.parquet(path).withColumn("dt", F.to_date("dt"))


def write_panel(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def first_readable(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """CSV with a header from the first of the paths that exists."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if there.getFileSystem(conf).exists(there):
            return spark.read.schema(schema).option("header", True).csv(path)
    raise FileNotFoundError(f"none of {paths}")


def write_csv(df: DataFrame, path: str, digits: int = 6) -> None:
    """df as CSV with a header; doubles rounded."""
    df.select(*(F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes)).write.mode("overwrite").option("header", True).csv(path)


def write_fallbacks(fallbacks: DataFrame, low_variance: DataFrame, folder: str) -> None:
    """The fallback map as JSON lines, and the low-variance tickers as sorted text."""
    fallbacks.write.mode("overwrite").json(f"{folder}/fallbacks")
    low_variance.select("ticker").distinct().orderBy("ticker").write.mode("overwrite").text(f"{folder}/low_variance")
