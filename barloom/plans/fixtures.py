"""Bars, scores and regression candidates derived from the given tables, as DataFrames and as SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.labels import first_hit, targets
from ..sources.bars import bars_from_ticks

#: Thresholds and horizon that suit the fixture's prices, which jump far more than a market's.
UP, DOWN, HORIZON = 2.0, -0.98, 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    return items.join(parts, items["l_partkey"] == parts["p_partkey"])


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker = brand, one bar a day, prices from l_extendedprice, volume from l_quantity."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return bars_from_ticks(ticks(spark, sf_dir), "ticker", F.to_date("l_shipdate"), "l_extendedprice", "l_quantity", order)


BARS = """bars as (
  select ticker, dt, arg_min(px, k) as open, max(px) as high, min(px) as low, arg_max(px, k) as close, sum(qty) as volume
  from (select p_brand as ticker, cast(l_shipdate as date) as dt, l_extendedprice as px, l_quantity as qty,
          row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as k
        from lineitem join part on l_partkey = p_partkey)
  group by ticker, dt)"""


def on_bars(sql: str) -> str:
    """SQL that may start with more common tables (`, x as (...) select ...`) over bars, each computed once."""
    whole = f"with {BARS}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
    return re.sub(r"\b(\w+) as \((?=\s*select\b)", r"\1 as materialized (", whole)


def on_bars_recursive(sql: str) -> str:
    """on_bars for common tables that may refer to themselves; only those that say so, and bars, are computed once."""
    return f"with recursive {BARS}".replace("bars as (", "bars as materialized (", 1) + sql


def rolling(n: int) -> str:
    """A frame of the last n rows."""
    return f"(partition by ticker order by dt rows between {n - 1} preceding and current row)"


LABELLED = f""", ahead as (
  select *, max(high) over f >= close * (1 + {UP}) as u, min(low) over f <= close * (1 + {DOWN}) as d
  from bars window f as (partition by ticker order by dt rows between 1 following and {HORIZON} following)),
labelled as (select * exclude (u, d), coalesce(u, false)::int as target_up, coalesce(d, false)::int as target_down from ahead)"""


def labelled(spark: SparkSession, sf_dir: str, bars: DataFrame | None = None) -> DataFrame:
    return targets(bars_daily(spark, sf_dir) if bars is None else bars, HORIZON, UP, DOWN)


def scores_synth(spark: SparkSession, sf_dir: str, bars: DataFrame | None = None) -> DataFrame:
    """dt, ticker, target, model, p, label: three rules of thumb in place of trained models, for two targets."""
    order, day = W.partitionBy("ticker").orderBy("dt"), W.partitionBy("dt")
    rows = labelled(spark, sf_dir, bars)
    rows = rows.withColumn("r", F.col("close") / F.lag("close").over(order) - 1)
    rows = rows.withColumn("s", F.col("close") / F.avg("close").over(order.rowsBetween(-19, 0)))
    z = (F.col("r") - F.avg("r").over(day)) / F.when(F.stddev_pop("r").over(day) > 0, F.stddev_pop("r").over(day))
    rows = rows.select("dt", "ticker", "target_up", "target_down", z.alias("z"), "r", "s", F.percent_rank().over(day.orderBy("s", "ticker")).alias("q"))
    clip = lambda p: F.round(F.greatest(F.least(F.coalesce(p, F.lit(0.5)), F.lit(1 - 1e-6)), F.lit(1e-6)), 6)
    m3 = F.round(F.coalesce(F.col("r"), F.lit(0.0)), 1)
    models = F.array(
        F.named_struct(F.lit("model"), F.lit("m1"), F.lit("p"), clip(1 / (1 + F.exp(-F.col("z"))))),
        F.named_struct(F.lit("model"), F.lit("m2"), F.lit("p"), clip(F.col("q"))),
        F.named_struct(F.lit("model"), F.lit("m3"), F.lit("p"), clip(1 / (1 + F.exp(F.greatest(F.lit(-5.0), F.least(F.lit(5.0), m3)))))),
    )
    both = F.array(F.struct(F.lit("down").alias("target"), F.col("target_down").alias("label")), F.struct(F.lit("up").alias("target"), F.col("target_up").alias("label")))
    rows = rows.select("dt", "ticker", F.explode(both).alias("t"), models.alias("models"))
    return rows.select("dt", "ticker", "t.target", F.explode("models").alias("m"), "t.label").select("dt", "ticker", "target", "m.model", "m.p", "label")


SCORES = (
    LABELLED
    + """, rated as (
  select *, close / lag(close) over (partition by ticker order by dt) - 1 as r,
    close / avg(close) over (partition by ticker order by dt rows between 19 preceding and current row) as s from labelled),
placed as (
  select *, (r - avg(r) over day) / nullif(stddev_pop(r) over day, 0) as z,
    percent_rank() over (partition by dt order by s, ticker) as q from rated window day as (partition by dt)),
thumbs as (
  select dt, ticker, target_up, target_down, unnest([
    {'model': 'm1', 'x': 1 / (1 + exp(-z))}, {'model': 'm2', 'x': q},
    {'model': 'm3', 'x': 1 / (1 + exp(greatest(-5.0, least(5.0, round(coalesce(r, 0.0), 1)))))}]) as m from placed),
clipped as (
  select dt, ticker, m.model as model, round(greatest(least(coalesce(m.x, 0.5), 1 - 1e-6), 1e-6), 6) as p, target_up, target_down from thumbs),
scores as (
  select dt, ticker, 'up' as target, model, p, target_up as label from clipped
  union all select dt, ticker, 'down', model, p, target_down from clipped)"""
)


def on_scores(sql: str) -> str:
    return on_bars(SCORES + (sql if sql.lstrip().startswith(",") else " " + sql))


def reg_synth(spark: SparkSession, sf_dir: str, bars: DataFrame | None = None) -> DataFrame:
    """dt, ticker, target, model, y, pred: normalised entry and sale targets, and three simple forecasts of them."""
    order = W.partitionBy("ticker").orderBy("dt")
    ahead = order.rowsBetween(0, HORIZON)
    rows = bars_daily(spark, sf_dir) if bars is None else bars
    close = F.when(F.col("close") != 0, F.col("close"))
    y = [((f("low" if k == "best_entry" else "high").over(ahead) - F.col("close")) / close) for k, f in (("best_entry", F.min), ("best_sale", F.max))]
    rows = rows.select("dt", "ticker", *(x.alias(k) for k, x in zip(("best_entry", "best_sale"), y, strict=True)))
    rows = rows.select("dt", "ticker", F.explode(F.array(*(F.struct(F.lit(k).alias("target"), F.col(k).alias("y")) for k in ("best_entry", "best_sale")))).alias("t")).select("dt", "ticker", "t.*")
    past = W.partitionBy("ticker", "target").orderBy("dt")
    preds = F.array(
        F.struct(F.lit("last").alias("model"), F.lag("y").over(past).alias("pred")),
        F.struct(F.lit("mean30").alias("model"), F.avg("y").over(past.rowsBetween(-30, -1)).alias("pred")),
        F.struct(F.lit("mean90").alias("model"), F.avg("y").over(past.rowsBetween(-90, -1)).alias("pred")),
    )
    rows = rows.withColumn("m", preds)
    return rows.select("dt", "ticker", "target", "y", F.explode("m").alias("m")).select("dt", "ticker", "target", "m.model", "y", "m.pred").where("pred is not null")


REG = f""", aimed as (
  select dt, ticker, close, min(low) over f as lo, max(high) over f as hi
  from bars window f as (partition by ticker order by dt rows between current row and {HORIZON} following)),
normed as (
  select dt, ticker, 'best_entry' as target, (lo - close) / nullif(close, 0) as y from aimed
  union all select dt, ticker, 'best_sale', (hi - close) / nullif(close, 0) from aimed),
guessed as (
  select *, lag(y) over p as l, avg(y) over (partition by ticker, target order by dt rows between 30 preceding and 1 preceding) as a,
    avg(y) over (partition by ticker, target order by dt rows between 90 preceding and 1 preceding) as b
  from normed window p as (partition by ticker, target order by dt)),
reg as (
  select dt, ticker, target, 'last' as model, y, l as pred from guessed where l is not null
  union all select dt, ticker, target, 'mean30', y, a from guessed where a is not null
  union all select dt, ticker, target, 'mean90', y, b from guessed where b is not null)"""


def on_reg(sql: str) -> str:
    return on_bars(REG + (sql if sql.lstrip().startswith(",") else " " + sql))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_hit(bars_daily(spark, sf_dir), HORIZON, UP, DOWN)
