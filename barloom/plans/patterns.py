"""Chart-pattern and label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as lab
from ..operators import patterns as pat
from ..operators.fill import shift_features
from . import fixtures as fx
from .fixtures import DOWN, HORIZON, UP, bars_daily, on_bars, rolling
from .registry import query

O = "over (partition by ticker order by dt)"  # noqa: E741
_BASE = f""", b as (
  select *, case when count(high) over w = 3 then max(high) over w end as rh, case when count(low) over w = 3 then min(low) over w end as rl,
    case when count(close) over w = 3 then max(close) over w end as cmax, case when count(close) over w = 3 then min(close) over w end as cmin,
    lag(high) {O} as ph, lag(low) {O} as pl, lag(close) {O} as pc, lead(high) {O} as nh, lead(low) {O} as nl,
    sign(high - lag(high, 2) {O}) as th, sign(low - lag(low, 2) {O}) as tl
  from bars window w as {rolling(3)})"""
_WEDGE = ("rh >= ph and rl <= pl and th = 1 and tl = 1", "rh <= ph and rl >= pl and th = -1 and tl = -1")
_NEAR = "(ph - pl) <= 0.05 * (ph + pl) / 2 and (nh - nl) <= 0.05 * (nh + nl) / 2"
_NARROW = "(rh - rl) <= 0.1 * (rh + rl) / 2"
_MASKS = {
    "pat_head_shoulder": ("hs_", "rh > ph and rh > nh and high < ph and high < nh", "rl < pl and rl < nl and low > pl and low > nl"),
    "pat_multi_top_bottom": ("mtb_", "rh >= ph and cmax < pc", "rl <= pl and cmin > pc"),
    "pat_triangle": ("tri_", "rh >= ph and rl <= pl and close > pc", "rh <= ph and rl >= pl and close < pc"),
    "pat_wedge": ("wed_", *_WEDGE),
    "pat_channel": ("chan_", *(f"{x} and {_NARROW}" for x in _WEDGE)),
    "pat_double": ("dbl_", f"rh >= ph and rh >= nh and high < ph and high < nh and {_NEAR}", f"rl <= pl and rl <= nl and low > pl and low > nl and {_NEAR}"),
}


#: What a pattern has besides the extremes of High and Low, by column.
_MORE = {"mtb_": {"mtb_close_roll_max": "cmax", "mtb_close_roll_min": "cmin"}}


def _more(prefix: str) -> str:
    return "".join(f"{x} as {c}, " for c, x in _MORE.get(prefix, {}).items())


def _case(up: str, down: str) -> str:
    return f"case when {down} then -1 when {up} then 1 else 0 end"


def _register(name: str) -> None:
    prefix, up, down = _MASKS[name]
    sql = f"{_BASE} select ticker, dt, rh as {prefix}high_roll_max, rl as {prefix}low_roll_min, {_more(prefix)}{_case(up, down)} as {prefix}pattern from b"

    @query(name, on_bars(sql))
    def run(spark, sf_dir):
        return pat.PATTERNS[name](bars_daily(spark, sf_dir)).select("ticker", "dt", f"{prefix}high_roll_max", f"{prefix}low_roll_min", *_MORE.get(prefix, {}), f"{prefix}pattern")


for _name in _MASKS:
    _register(_name)

_SR = f""", s as (
  select *, case when count(low) over w = 3 then avg(low) over w - 2 * stddev_samp(low) over w end as lo,
    case when count(high) over w = 3 then avg(high) over w + 2 * stddev_samp(high) over w end as hi from bars window w as {rolling(3)})
select ticker, dt, round(lo, 4) as sr_support, round(hi, 4) as sr_resistance, round(close - lo, 4) as sr_support_diff, round(hi - close, 4) as sr_resistance_diff from s"""


@query("support_resistance", on_bars(_SR))
def support_resistance(spark, sf_dir):
    rows = pat.support_resistance(bars_daily(spark, sf_dir))
    return rows.select("ticker", "dt", *(F.round(c, 4).alias(c) for c in ("sr_support", "sr_resistance", "sr_support_diff", "sr_resistance_diff")))


_TREND = f""", t as (
  select *, row_number() {O} - 1 as i, lag(close) {O} as c1, lag(close, 2) {O} as c2 from bars),
l as (select *, coalesce(c1 - c2, 0) as slope, case when c2 is null then 0 else c2 - (c1 - c2) * (i - 2) end as start from t),
y as (select *, slope * i + start as line from l)
select ticker, dt, round(slope, 2) as trend_slope, round(start, 2) as trend_intercept, round(case when slope > 0 then line end, 2) as trend_support,
  round(case when slope < 0 then line end, 2) as trend_resistance, round(close - case when slope > 0 then line end, 2) as trend_support_diff,
  round(case when slope < 0 then line end - close, 2) as trend_resistance_diff from y"""
_TREND_DIGITS = {"trend_slope": 2, "trend_intercept": 2, "trend_support": 2, "trend_resistance": 2, "trend_support_diff": 2, "trend_resistance_diff": 2}


_TREND = _TREND.replace("then line end - close", "then line - close end").replace("close - case when slope > 0 then line end", "case when slope > 0 then close - line end")


@query("trendline", on_bars(_TREND))
def trendline(spark, sf_dir):
    rows = pat.trendline(bars_daily(spark, sf_dir))
    return rows.select("ticker", "dt", *(F.round(c, d).alias(c) for c, d in _TREND_DIGITS.items()))


_SR_DIGITS = dict.fromkeys(("sr_support", "sr_resistance", "sr_support_diff", "sr_resistance_diff"), 4)
_ALL = [f"{p}{c}" for p, *_ in _MASKS.values() for c in ("high_roll_max", "low_roll_min", "pattern")] + [c for more in _MORE.values() for c in more] + [*_SR_DIGITS, *_TREND_DIGITS]
_PATTERNS_SQL = (
    _BASE
    + ", p as (select ticker, dt, " + ", ".join(f"rh as {p}high_roll_max, rl as {p}low_roll_min, {_more(p)}{_case(u, d)} as {p}pattern" for p, u, d in _MASKS.values()) + " from b)"
    + f", sr as (with {_SR.removeprefix(', ')}), tr as (with {_TREND.removeprefix(', ')})"
    + ", u as (select ticker, dt, " + ", ".join(_ALL) + " from p join sr using (ticker, dt) join tr using (ticker, dt))"
)
_UNSHIFTED = _PATTERNS_SQL + " select * from u"


@query("patterns_all", on_bars(_PATTERNS_SQL + " select ticker, dt, " + ", ".join(f"lag({c}) {O} as {c}" for c in _ALL) + " from u"))
def patterns_all(spark, sf_dir):
    """Every column of every pattern, shifted by one row as it would feed a model."""
    rows = pat.all_patterns(bars_daily(spark, sf_dir))
    rows = rows.withColumns({c: F.round(c, d) for c, d in (_SR_DIGITS | _TREND_DIGITS).items()})
    return shift_features(rows, _ALL, 1).select("ticker", "dt", *_ALL)


def _targets_sql(up: float, down: float, horizon: int) -> str:
    return f""" select ticker, dt, coalesce(max(high) over f >= close * (1 + {up}), false)::int as target_up,
  coalesce(min(low) over f <= close * (1 + {down}), false)::int as target_down
from bars window f as (partition by ticker order by dt rows between 1 following and {horizon} following)"""


@query("target_up", on_bars(f"select ticker, dt, target_up from ({_targets_sql(UP, DOWN, HORIZON)})"))
def target_up(spark, sf_dir):
    return fx.labelled(spark, sf_dir).select("ticker", "dt", "target_up")


@query("target_down", on_bars(f"select ticker, dt, target_down from ({_targets_sql(UP, DOWN, HORIZON)})"))
def target_down(spark, sf_dir):
    return fx.labelled(spark, sf_dir).select("ticker", "dt", "target_down")


@query("targets_default", on_bars(_targets_sql(0.20, -0.05, 90)))
def targets_default(spark, sf_dir):
    return lab.targets(bars_daily(spark, sf_dir)).select("ticker", "dt", "target_up", "target_down")


_HITS = f""", n as (select *, row_number() {O} as i from bars),
h as (
  select a.ticker, a.dt, a.i, min(case when b.high >= a.close * (1 + {UP}) then b.i - a.i end) as u, min(case when b.low <= a.close * (1 + {DOWN}) then b.i - a.i end) as d
  from n a left join n b on a.ticker = b.ticker and b.i between a.i + 1 and a.i + {HORIZON} group by a.ticker, a.dt, a.i)"""


@query("target_first_hit", on_bars(f"{_HITS} select ticker, dt, case when u is null and d is null then -1 when d is null then 1 when u is null then 0 when u < d then 1 else 0 end as target_first_hit from h"))
def target_first_hit(spark, sf_dir):
    return fx.hits(spark, sf_dir).select("ticker", "dt", "target_first_hit")


@query("target_path_aware", on_bars(f"{_HITS} select ticker, dt, (u is not null and (d is null or u < d))::int as target_path from h"))
def target_path_aware(spark, sf_dir):
    return lab.path_aware(bars_daily(spark, sf_dir), HORIZON, UP, DOWN).select("ticker", "dt", "target_path")


for _k, _f, _c in (("entry", "min", "low"), ("sale", "max", "high")):

    @query(f"target_best_{_k}", on_bars(f" select ticker, dt, {_f}({_c}) over (partition by ticker order by dt rows between current row and 90 following) as target_best_{_k} from bars"))
    def best(spark, sf_dir, k=_k):
        return lab.best_entry_sale(bars_daily(spark, sf_dir)).select("ticker", "dt", f"target_best_{k}")


_FLAG = """, a as (
  select ticker, dt, avg(close) over s as fast, avg(close) over l as slow, count(*) over l as n from bars
  window s as (partition by ticker order by dt rows between 19 preceding and current row), l as (partition by ticker order by dt rows between 49 preceding and current row)),
x as (
  select *, lag(case when n >= 20 then fast end) over (partition by ticker order by dt) as pf, lag(case when n = 50 then slow end) over (partition by ticker order by dt) as ps from a),
c as (select ticker, dt, case when n = 50 and fast < slow and pf >= ps then -1 when n = 50 and fast > slow and pf <= ps then 1 else 0 end as state from x)"""
_FLAGSHIP = (
    _FLAG + f", t as ({_targets_sql(UP, DOWN, HORIZON)}) select c.ticker, state, count(*) as bars, round(avg(target_up), 6) as up_rate, round(avg(target_down), 6) as down_rate from c join t on c.ticker = t.ticker and c.dt = t.dt group by c.ticker, state"
)


@query("flagship_cross_label_rates", on_bars(_FLAGSHIP))
def flagship(spark, sf_dir):
    """How often the labels hold by ticker and by the state of the 20/50 cross."""
    from ..operators.indicators import add_crosses

    rows = add_crosses(lab.targets(bars_daily(spark, sf_dir), HORIZON, UP, DOWN), (20, 50))
    return rows.groupBy("ticker", F.col("cross_20_50").alias("state")).agg(F.count("*").alias("bars"), F.round(F.avg("target_up"), 6).alias("up_rate"), F.round(F.avg("target_down"), 6).alias("down_rate"))
