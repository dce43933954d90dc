"""Queries of sources, projections, reshapes and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scratch import scratch
from ..operators import fill
from ..sources import bars as src
from . import fixtures as fx
from .fixtures import BARS, bars_daily, on_bars, table
from .registry import query

O = "over (partition by ticker order by dt)"  # noqa: E741
START = "1998-01-01"
SOME = ["Brand#11", "Brand#23", "Brand#45"]
#: Every ticker of the given tables.
TICKERS = [f"Brand#{k}" for k in range(1, 26)]


def _folder(spark) -> str:
    """A new folder that executors share too."""
    return scratch(spark, "panel")


@query("bars_from_ticks", on_bars("select * from bars"))
def bars_from_ticks(spark, sf_dir):
    return bars_daily(spark, sf_dir)


@query("bars_hourly", "select event_type as ticker, date_trunc('hour', ts) as dt, arg_min(value, row(ts, event_id)) as open, max(value) as high, min(value) as low, arg_max(value, row(ts, event_id)) as close, cast(count(*) as bigint) as volume from events group by 1, 2")
def bars_hourly(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("one", F.lit(1))
    return src.bars_from_ticks(events, "event_type", F.date_trunc("hour", "ts"), "value", "one", ["ts", "event_id"])


@query("bars_scan", on_bars(f" select ticker, dt, high, low, close, volume from bars where dt >= date '{START}' and ticker in ({', '.join(map(repr, SOME))})"))
def bars_scan(spark, sf_dir):
    tickers = table(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker")).where(F.col("ticker").isin(SOME)).distinct()
    return src.scan_bars(bars_daily(spark, sf_dir), tickers, START, ["high", "low", "close", "volume"])


_HOLES = """, holed as (
  select ticker, dt, case when day(dt) % 3 = 0 then null else open end as open, high, case when ticker = 'Brand#23' then null else low end as low, close,
    case when day(dt) % 5 = 0 then null else volume end as volume from bars)"""


def _holed(spark, sf_dir):
    b, d = bars_daily(spark, sf_dir), F.dayofmonth("dt")
    return b.withColumns({"open": F.when(d % 3 != 0, F.col("open")), "low": F.when(F.col("ticker") != "Brand#23", F.col("low")), "volume": F.when(d % 5 != 0, F.col("volume"))})


@query("bars_schema_repair", on_bars(_HOLES + " select ticker, dt, coalesce(open, close) as open, high, low, close, close as adj_close, coalesce(volume, 0) as volume from holed"))
def bars_schema_repair(spark, sf_dir):
    return src.repair_schema(_holed(spark, sf_dir))


@query("bars_skip_reasons", on_bars(_HOLES + ", f as (select ticker, count(low) as n from holed group by ticker) select case when n = 0 then 'missing low' else 'ok' end as reason, count(*) as tickers from f group by 1"))
def bars_skip_reasons(spark, sf_dir):
    return src.skip_reasons(src.repair_schema(_holed(spark, sf_dir)))


@query("panel_read", on_bars("select ticker, dt, close, volume from bars"))
def panel_read(spark, sf_dir):
    path = _folder(spark) + "/panel"
    src.write_panel(bars_daily(spark, sf_dir).select("ticker", F.col("dt").cast("string").alias("dt"), "close", "volume"), path)
    return src.read_panel(spark, path)


@query("panel_write", on_bars("select ticker, dt, close::float as close, volume::float as volume from bars"))
def panel_write(spark, sf_dir):
    path = _folder(spark) + "/panel"
    src.write_panel(fill.compact_types(bars_daily(spark, sf_dir).select("ticker", "dt", "close", "volume")), path)
    return src.read_panel(spark, path)


@query("csv_sources", on_bars("select ticker, dt, close from bars"))
def csv_sources(spark, sf_dir):
    folder = _folder(spark)
    src.write_csv(bars_daily(spark, sf_dir).select("ticker", "dt", "close"), f"{folder}/second")
    return src.first_readable(spark, [f"{folder}/first", f"{folder}/second"], "ticker string, dt date, close double")


@query("csv_sinks", on_bars("select ticker, dt, round(close / 7, 6) as x from bars"))
def csv_sinks(spark, sf_dir):
    path = _folder(spark) + "/out"
    src.write_csv(bars_daily(spark, sf_dir).select("ticker", "dt", (F.col("close") / 7).alias("x")), path)
    return spark.read.schema("ticker string, dt date, x double").option("header", True).csv(path)


@query("ticker_slice", on_bars("select dt, close from bars where ticker = 'Brand#23'"))
def ticker_slice(spark, sf_dir):
    return bars_daily(spark, sf_dir).where("ticker = 'Brand#23'").select("dt", "close")


_GRID = """, grid as (select ticker, dt from (select distinct ticker from bars) cross join (select distinct dt from bars)),
g as (select grid.ticker, grid.dt, open, high, low, close, volume from grid left join bars on grid.ticker = bars.ticker and grid.dt = bars.dt)"""
_FF = ", ".join(f"last_value({c} ignore nulls) over (partition by ticker order by dt) as {c}" for c in ("open", "high", "low", "close", "volume"))


@query("calendar_align_ffill", on_bars(f"{_GRID} select ticker, dt, {_FF} from g"))
def calendar_align_ffill(spark, sf_dir):
    return fill.align_calendar(bars_daily(spark, sf_dir))


_RAW = """, raw as (select ticker, dt, case when close > 50000 then 'inf'::double when day(dt) % 4 = 0 then null else close end as x,
  case when month(dt) < 9 then null else volume end as y from bars)"""


def _raw(spark, sf_dir):
    b = bars_daily(spark, sf_dir)
    x = F.when(F.col("close") > 50000, float("inf")).when(F.dayofmonth("dt") % 4 != 0, F.col("close"))
    return b.select("ticker", "dt", x.alias("x"), F.when(F.month("dt") >= 9, F.col("volume")).alias("y"))


@query("fill_100pct", on_bars(_RAW + """, c as (select ticker, dt, case when isfinite(x) then x end as x, y from raw)
select ticker, dt, coalesce(last_value(x ignore nulls) over p, first_value(x ignore nulls) over n, 0) as x, coalesce(last_value(y ignore nulls) over p, first_value(y ignore nulls) over n, 0) as y
from c window p as (partition by ticker order by dt), n as (partition by ticker order by dt rows between current row and unbounded following)"""))
def fill_100pct(spark, sf_dir):
    return fill.fill_gaps(_raw(spark, sf_dir), ["x", "y"])


@query("fill_forward_only", on_bars(_RAW + ", c as (select ticker, dt, case when isfinite(x) then x end as x, y from raw) select ticker, dt, coalesce(last_value(x ignore nulls) over p, 0) as x, coalesce(last_value(y ignore nulls) over p, 0) as y from c window p as (partition by ticker order by dt)"))
def fill_forward_only(spark, sf_dir):
    return fill.fill_gaps(_raw(spark, sf_dir), ["x", "y"], backward=False)


@query("compact_types", on_bars(fx.LABELLED + " select ticker, dt, close::float as close, target_up::tinyint as target_up, target_down::tinyint as target_down from labelled"))
def compact_types(spark, sf_dir):
    return fill.compact_types(fx.labelled(spark, sf_dir).select("ticker", "dt", "close", "target_up", "target_down"))


@query("shift_features", on_bars(f"select ticker, dt, lag(close, 2) {O} as close, lag(volume, 2) {O} as volume from bars"))
def shift_features(spark, sf_dir):
    return fill.shift_features(bars_daily(spark, sf_dir).select("ticker", "dt", "close", "volume"), ["close", "volume"], 2)


@query("stack_long", on_bars("select ticker, dt, 'close' as feature, close as value from bars union all select ticker, dt, 'volume', volume from bars"))
def stack_long(spark, sf_dir):
    return fill.stack_long(bars_daily(spark, sf_dir), ["close", "volume"])


@query("mask_features", on_bars("select ticker, dt, case when ticker like '%1' then close else 0.0 end as close, volume from bars"))
def mask_features(spark, sf_dir):
    b = bars_daily(spark, sf_dir)
    tickers = b.select("ticker").distinct()
    selection = tickers.select("ticker", F.lit("volume").alias("feature")).union(tickers.where("ticker like '%1'").select("ticker", F.lit("close")))
    return fill.mask_features(b, selection, ["close", "volume"])


@query("ticker_dummies", on_bars("select ticker, dt, " + ", ".join(f"(ticker = '{t}')::int as \"tk_{t}\"" for t in TICKERS) + ", ticker as ticker_rec from bars"))
def ticker_dummies(spark, sf_dir):
    b = bars_daily(spark, sf_dir).select("ticker", "dt")
    return fill.recover_ticker(fill.dummies(b, TICKERS), TICKERS)


@query("numeric_clean", on_bars("select ticker, dt, coalesce(try_cast(case when day(dt) % 2 = 0 then 'n/a' else cast(close as varchar) end as double), 0) as x from bars"))
def numeric_clean(spark, sf_dir):
    b = bars_daily(spark, sf_dir).select("ticker", "dt", F.when(F.dayofmonth("dt") % 2 == 0, "n/a").otherwise(F.col("close").cast("string")).alias("x"))
    return fill.numeric_clean(b, ["x"])


@query("align_columns", on_bars("select ticker, dt, volume, 0.0::double as new_one, close from bars"))
def align_columns(spark, sf_dir):
    return fill.align_columns(bars_daily(spark, sf_dir), ["volume", "new_one", "close"])


@query("pct_change", on_bars(f"select ticker, dt, round(close / nullif(lag(close) {O}, 0) - 1, 6) as pct_change from bars"))
def pct_change(spark, sf_dir):
    return bars_daily(spark, sf_dir).select("ticker", "dt", F.round(fill.pct_change(), 6).alias("pct_change"))


@query("norm_target", on_bars(fx.REG + " select dt, ticker, target, round(y, 6) as y from normed"))
def norm_target(spark, sf_dir):
    from ..operators.labels import best_entry_sale, normalised

    b = best_entry_sale(bars_daily(spark, sf_dir), fx.HORIZON)
    pairs = F.array(*(F.struct(F.lit(k).alias("target"), normalised(F.col(f"target_{k}"), F.col("close")).alias("y")) for k in ("best_entry", "best_sale")))
    return b.select("dt", "ticker", F.explode(pairs).alias("t")).select("dt", "ticker", "t.target", F.round("t.y", 6).alias("y"))


@query("pct_to_price", on_bars(fx.REG + " select reg.dt, reg.ticker, target, model, round(close * (1 + pred), 4) as pred_price from reg join bars on reg.dt = bars.dt and reg.ticker = bars.ticker"))
def pct_to_price(spark, sf_dir):
    rows = fx.reg_synth(spark, sf_dir).join(bars_daily(spark, sf_dir).select("dt", "ticker", "close"), ["dt", "ticker"])
    return rows.select("dt", "ticker", "target", "model", F.round(F.col("close") * (1 + F.col("pred")), 4).alias("pred_price"))


_NAMES = "case when p_size % 4 = 0 then p_brand || '.SA' when p_size % 4 = 1 then '^' || p_brand when p_size % 4 = 2 then 'BTC-' || p_brand else p_brand end"


@query("asset_type", f"select p_partkey, case when n like '%.SA' then 'stock' when n like '^%' or n like 'BTC%' then 'index_commodity' else 'other' end as asset_type from (select p_partkey, {_NAMES} as n from part)")
def asset_type(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fill.asset_type(F.expr(_NAMES)).alias("asset_type"))


@query("last_n_dates", on_bars("select * from bars where dt in (select distinct dt from bars order by dt desc limit 5)"))
def last_n_dates(spark, sf_dir):
    return fill.last_dates(bars_daily(spark, sf_dir), 5)


@query("concat_axis1", on_bars(f"select ticker, dt, close, lag(close) {O} as before, volume from bars"))
def concat_axis1(spark, sf_dir):
    b = bars_daily(spark, sf_dir)
    return b.select("ticker", "dt", "close").join(b.select("ticker", "dt", F.lag("close").over(fill.order()).alias("before"), "volume"), ["ticker", "dt"])


@query("concat_axis0", on_bars("select ticker, dt, close, volume from bars where ticker in ('Brand#11', 'Brand#23')"))
def concat_axis0(spark, sf_dir):
    b = bars_daily(spark, sf_dir)
    return b.where("ticker = 'Brand#11'").select("ticker", "dt", "close", "volume").unionByName(b.where("ticker = 'Brand#23'").select("volume", "close", "dt", "ticker"))


@query("targets_both", on_bars(fx.LABELLED + " select distinct ticker from labelled where target_up = 1 intersect select ticker from labelled where target_down = 1"))
def targets_both(spark, sf_dir):
    rows = fx.labelled(spark, sf_dir)
    return rows.where("target_up = 1").select("ticker").intersect(rows.where("target_down = 1").select("ticker"))


@query("missing_tickers", f"with {BARS} select distinct p_brand as ticker from part where p_brand not in (select ticker from bars where dt < date '1995-01-05')")
def missing_tickers(spark, sf_dir):
    built = bars_daily(spark, sf_dir).where("dt < date '1995-01-05'").select("ticker")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker")).distinct().join(built, "ticker", "left_anti")


@query("semi_dates", on_bars("select * from bars where dt in (select dt from bars where ticker = 'Brand#23')"))
def semi_dates(spark, sf_dir):
    b = bars_daily(spark, sf_dir)
    return b.join(b.where("ticker = 'Brand#23'").select("dt"), "dt", "left_semi")


_LAST = "(select distinct dt from bars order by dt desc limit 5)"


@query("price_grid", on_bars(f", d as {_LAST}, g as (select ticker, dt from (select distinct ticker from bars) cross join d) select g.ticker, g.dt, close from g left join bars on g.ticker = bars.ticker and g.dt = bars.dt"))
def price_grid(spark, sf_dir):
    b = bars_daily(spark, sf_dir)
    days = b.select("dt").distinct().orderBy(F.desc("dt")).limit(5).agg(F.collect_list("dt").alias("days"))
    grid = b.select("ticker").distinct().join(F.broadcast(days), F.lit(True)).select("ticker", F.explode("days").alias("dt"))
    return grid.join(b.select("ticker", "dt", "close"), ["ticker", "dt"], "left")


@query("close_fill_window", on_bars(f""", d as {_LAST}, span as (select min(dt) - interval 30 day as a, max(dt) + interval 1 day as b from d),
g as (select ticker, dt from (select distinct ticker from bars) cross join (select distinct dt from bars, span where dt >= a and dt < b)),
f as (select g.ticker, g.dt, close from g left join bars on g.ticker = bars.ticker and g.dt = bars.dt),
c as (select ticker, dt, coalesce(last_value(close ignore nulls) over (partition by ticker order by dt), first_value(close ignore nulls) over (partition by ticker order by dt rows between current row and unbounded following)) as close from f)
select * from c where dt in (select dt from d)"""))
def close_fill_window(spark, sf_dir):
    b = bars_daily(spark, sf_dir).select("ticker", "dt", "close")
    days = b.select("dt").distinct().orderBy(F.desc("dt")).limit(5)
    span = days.agg((F.min("dt") - F.expr("interval 30 days")).cast("date").alias("a"), F.date_add(F.max("dt"), 1).alias("b"))
    near = b.join(F.broadcast(span), (F.col("dt") >= F.col("a")) & (F.col("dt") < F.col("b"))).drop("a", "b")
    calendar = near.agg(F.collect_set("dt").alias("days"))
    grid = b.select("ticker").distinct().join(F.broadcast(calendar), F.lit(True)).select("ticker", F.explode("days").alias("dt"))
    filled = grid.join(near, ["ticker", "dt"], "left").withColumn("close", F.coalesce(F.last("close", True).over(fill.before()), F.first("close", True).over(fill.after())))
    return filled.join(F.broadcast(days), "dt", "left_semi").select("ticker", "dt", "close")
