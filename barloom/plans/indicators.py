"""Indicator queries: the columns of each registered indicator, and the same by SQL windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scratch import cut
from ..operators import indicators as ind
from ..operators import path_indicators
from .fixtures import bars_daily, on_bars, on_bars_recursive, rolling
from .registry import query

#: Columns of sums and products in one order, equal to the last bit in both engines; their decimals often end in a 5.
_EXACT = ("psar_up", "psar_down")
#: Added before rounding where many columns meet: quotients of prices often lie just between two decimals.
_NUDGE = 1e-9
#: Decimals that both engines round to, where sums of doubles come in another order.
DIGITS = 4


def _prev(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) over (partition by ticker order by dt)"


def _full(f: str, x: str, n: int) -> str:
    return f"(case when count({x}) over {rolling(n)} = {n} then {f}({x}) over {rolling(n)} end)"


def _sma(x: str, n: int) -> str:
    return _full("avg", x, n)


def _run(x: str) -> str:
    return f"sum({x}) over (partition by ticker order by dt rows between unbounded preceding and current row)"


def _ema(x: str, n: int | None = None, alpha: float | None = None) -> str:
    a = alpha if alpha is not None else 2 / (n + 1)
    return f"list_reduce(list({x}) filter ({x} is not null) over (partition by ticker order by dt rows between unbounded preceding and current row), lambda e, v: e + {a!r} * (v - e))"


def _ratio(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def _chain(*steps: dict[str, str], start: str = "bars") -> str:
    """Common tables that add columns step by step; the last is called done."""
    out, source = "", start
    for k, step in enumerate(steps):
        name = "done" if k == len(steps) - 1 else f"s{k}"
        out += f", {name} as (select *, " + ", ".join(f"{v} as {c}" for c, v in step.items()) + f" from {source})"
        source = name
    return out


TR = f"greatest(high - low, abs(high - {_prev('close')}), abs(low - {_prev('close')}))"
TP = "((high + low + close) / 3)"
D = {"d": f"close - {_prev('close')}"}
RSI = [
    D,
    {"g": _ema("greatest(d, 0.0) + 0 * d", alpha=1 / 14), "l": _ema("greatest(-d, 0.0) + 0 * d", alpha=1 / 14)},
    {"rsi": "100 * " + _ratio("g", "g + l")},
]


def _macd(x: str, name: str, relative: bool) -> list[dict[str, str]]:
    line = "100 * " + _ratio("f - s", "s") if relative else "f - s"
    return [{"f": _ema(x, 12), "s": _ema(x, 26)}, {name: line}, {f"{name}_signal": _ema(name, 9)}, {f"{name}_hist": f"{name} - {name}_signal"}]


FLOW = f"coalesce({_ratio('(close - low) - (high - close)', 'high - low')}, 0.0) * volume"
MID = lambda n: f"({_full('max', 'high', n)} + {_full('min', 'low', n)}) / 2"
UO = lambda n: _ratio(_full("sum", "bp", n), _full("sum", "tr", n))
STEPS: dict[str, list[dict[str, str]]] = {
    "ema_12": [{"ema_12": _ema("close", 12)}],
    "macd": _macd("close", "macd", False),
    "ppo": _macd("close", "ppo", True),
    "pvo": _macd("volume", "pvo", True),
    "trix": [{"e1": _ema("close", 15)}, {"e2": _ema("e1", 15)}, {"e3": _ema("e2", 15)}, {"trix": f"100 * ({_ratio('e3', _prev('e3'))} - 1)"}],
    "tsi": [D, {"a": _ema("d", 25), "b": _ema("abs(d)", 25)}, {"c": _ema("a", 13), "e": _ema("b", 13)}, {"tsi": "100 * " + _ratio("c", "e")}],
    "rsi": RSI,
    "stoch_rsi": [*RSI, {"stoch_rsi": _ratio(f"rsi - {_full('min', 'rsi', 14)}", f"{_full('max', 'rsi', 14)} - {_full('min', 'rsi', 14)}")}, {"stoch_rsi_k": _sma("stoch_rsi", 3)}, {"stoch_rsi_d": _sma("stoch_rsi_k", 3)}],
    "stochastic": [{"lo": _full("min", "low", 14), "hi": _full("max", "high", 14)}, {"stoch_k": "100 * " + _ratio("close - lo", "hi - lo")}, {"stoch_d": _sma("stoch_k", 3)}],
    "williams_r": [{"lo": _full("min", "low", 14), "hi": _full("max", "high", 14)}, {"williams_r": "-100 * " + _ratio("hi - close", "hi - lo")}],
    "roc": [{"roc": f"100 * ({_ratio('close', _prev('close', 12))} - 1)"}],
    "ao": [{"m": "(high + low) / 2"}, {"ao": f"{_sma('m', 5)} - {_sma('m', 34)}"}],
    "uo": [{"pc": _prev("close")}, {"bp": "close - least(low, pc)", "tr": "greatest(high, pc) - least(low, pc)"}, {"uo": f"100 * (4 * {UO(7)} + 2 * {UO(14)} + {UO(28)}) / 7"}],
    "bollinger": [
        {"bb_m": _sma("close", 20), "sd": _full("stddev_pop", "close", 20)},
        {"bb_h": "bb_m + 2 * sd", "bb_l": "bb_m - 2 * sd"},
        {"bb_w": "100 * " + _ratio("bb_h - bb_l", "bb_m"), "bb_p": _ratio("close - bb_l", "bb_h - bb_l"), "bb_hi": "coalesce(close > bb_h, false)::int", "bb_li": "coalesce(close < bb_l, false)::int"},
    ],
    "keltner": [{"tp": TP, "rg": "high - low"}, {"kc_m": _sma("tp", 10), "r": _sma("rg", 10)}, {"kc_h": "kc_m + r", "kc_l": "kc_m - r"}],
    "donchian": [{"dc_h": _full("max", "high", 20), "dc_l": _full("min", "low", 20)}, {"dc_m": "(dc_h + dc_l) / 2", "dc_w": "100 * " + _ratio("dc_h - dc_l", _sma("close", 20)), "dc_p": _ratio("close - dc_l", "dc_h - dc_l")}],
    "atr": [{"true_range": TR}, {"atr": _ema("true_range", alpha=1 / 14)}],
    "ulcer": [{"top": _full("max", "close", 14)}, {"dd": f"power(100 * {_ratio('close - top', 'top')}, 2)"}, {"ulcer": f"sqrt({_sma('dd', 14)})"}],
    "obv": [{"s": f"coalesce(sign(close - {_prev('close')}), 0) * volume"}, {"obv": _run("s")}],
    "adi": [{"f": FLOW}, {"adi": _run("f")}],
    "cmf": [{"f": FLOW}, {"cmf": _ratio(_full("sum", "f", 20), _full("sum", "volume", 20))}],
    "force_index": [{"f": f"(close - {_prev('close')}) * volume"}, {"force_index": _ema("f", 13)}],
    "eom": [{"m": "(high + low) / 2"}, {"eom": _ratio(f"(m - {_prev('m')}) * (high - low)", "volume")}, {"eom_sma": _sma("eom", 14)}],
    "vpt": [{"x": f"coalesce(volume * ({_ratio('close', _prev('close'))} - 1), 0.0)"}, {"vpt": _run("x")}],
    "vwap": [{"tv": f"{TP} * volume"}, {"vwap": _ratio(_full("sum", "tv", 14), _full("sum", "volume", 14))}],
    "mfi": [
        {"tp": TP},
        {"ch": f"tp - {_prev('tp')}"},
        {"up": "case when ch > 0 then tp * volume when ch is not null then 0.0 end", "dn": "case when ch < 0 then tp * volume when ch is not null then 0.0 end"},
        {"mfi": "100 * " + _ratio(_full("sum", "up", 14), f"{_full('sum', 'up', 14)} + {_full('sum', 'dn', 14)}")},
    ],
    "nvi": [{"g": f"case when volume < {_prev('volume')} then ln({_ratio('close', _prev('close'))}) else 0.0 end"}, {"nvi": f"1000 * exp({_run('g')})"}],
    "vortex": [
        {"tr": f"{TR} + 0 * {_prev('close')}", "p": f"abs(high - {_prev('low')})", "n": f"abs(low - {_prev('high')})"},
        {"vortex_pos": _ratio(_full("sum", "p", 14), _full("sum", "tr", 14)), "vortex_neg": _ratio(_full("sum", "n", 14), _full("sum", "tr", 14))},
        {"vortex_diff": "vortex_pos - vortex_neg"},
    ],
    "mass_index": [{"rg": "high - low"}, {"e1": _ema("rg", 9)}, {"e2": _ema("e1", 9)}, {"r": _ratio("e1", "e2")}, {"mass_index": _full("sum", "r", 25)}],
    "dpo": [{"dpo": f"{_prev('close', 11)} - {_sma('close', 20)}"}],
    "kst": [
        {f"r{n}": f"100 * ({_ratio('close', _prev('close', n))} - 1)" for n in (10, 15, 20, 30)},
        {"kst": f"{_sma('r10', 10)} + 2 * {_sma('r15', 10)} + 3 * {_sma('r20', 10)} + 4 * {_sma('r30', 15)}"},
        {"kst_sig": _sma("kst", 9)},
    ],
    "ichimoku": [{"ich_conv": MID(9), "ich_base": MID(26), "ich_b": MID(52)}, {"ich_a": "(ich_conv + ich_base) / 2"}],
    "cci": [
        {"tp": TP},
        {"m": _sma("tp", 20), "x": f"list(tp) over {rolling(20)}"},
        {"cci": _ratio("tp - m", "0.015 * (list_sum(list_transform(x, lambda v: abs(v - m))) / 20)")},
    ],
    "adx": [
        {"u": f"high - {_prev('high')}", "w": f"{_prev('low')} - low", "tr": f"{TR} + 0 * {_prev('close')}"},
        {"p": "case when u > w and u > 0 then u when u is not null then 0.0 end", "n": "case when w > u and w > 0 then w when u is not null then 0.0 end"},
        {"a": _ema("tr", alpha=1 / 14), "ep": _ema("p", alpha=1 / 14), "en": _ema("n", alpha=1 / 14)},
        {"adx_pos": "100 * " + _ratio("ep", "a"), "adx_neg": "100 * " + _ratio("en", "a")},
        {"dx": "100 * " + _ratio("abs(adx_pos - adx_neg)", "adx_pos + adx_neg")},
        {"adx": _ema("dx", alpha=1 / 14)},
    ],
    "aroon": [
        {"i": "row_number() over (partition by ticker order by dt)"},
        {"ih": f"max(row(high, i)) over {rolling(25)}", "il": f"min(row(low, -i)) over {rolling(25)}"},
        {"aroon_up": "case when i >= 25 then 100 * (25 - (i - ih[2])) / 25.0 end", "aroon_down": "case when i >= 25 then 100 * (25 - (i + il[2])) / 25.0 end"},
        {"aroon_diff": "aroon_up - aroon_down"},
    ],
    "stc": [
        {"f": _ema("close", 23), "s": _ema("close", 50)},
        {"x0": "f - s"},
        *[s for k in (0, 1) for s in ({f"k{k}": "100 * " + _ratio(f"x{k} - {_full('min', f'x{k}', 10)}", f"{_full('max', f'x{k}', 10)} - {_full('min', f'x{k}', 10)}")}, {f"x{k + 1}": _ema(f"k{k}", 3)})],
        {"stc": "x2"},
    ],
    "returns": [
        {"daily_return": f"100 * ({_ratio('close', _prev('close'))} - 1)", "log_return": f"ln({_ratio('close', _prev('close'))})", "cum_return": f"100 * ({_ratio('close', 'first_value(close) over (partition by ticker order by dt)')} - 1)"},
    ],
}


def _register(name: str, f) -> None:
    columns = f.columns
    whole = {"bb_hi", "bb_li"}
    sql = _chain(*STEPS[name]) + " select ticker, dt, " + ", ".join(c if c in whole else f"round({c}, {DIGITS}) as {c}" for c in columns) + " from done"

    @query(f"ind_{name}", on_bars(sql))
    def run(spark, sf_dir):
        return f(bars_daily(spark, sf_dir)).select("ticker", "dt", *(c if c in whole else F.round(c, DIGITS).alias(c) for c in columns))


for _name, _f in ind.INDICATORS.items():
    if _name in STEPS:
        _register(_name, _f)


@query("sma_all", on_bars(" select ticker, dt, " + ", ".join(f"round({_sma('close', n)}, {DIGITS}) as sma_{n}" for n in ind.AVERAGES) + " from bars"))
def sma_all(spark, sf_dir):
    return ind.add_smas(bars_daily(spark, sf_dir)).select("ticker", "dt", *(F.round(f"sma_{n}", DIGITS).alias(f"sma_{n}") for n in ind.AVERAGES))


_PAIRS = [(f, s) for f in ind.AVERAGES for s in ind.AVERAGES if f < s]
_CROSSES = _chain({f"a{n}": _sma("close", n) for n in ind.AVERAGES}, {f"p{n}": _prev(f"a{n}") for n in ind.AVERAGES}) + " select ticker, dt, " + ", ".join(
    f"case when a{f} < a{s} and p{f} >= p{s} then -1 when a{f} > a{s} and p{f} <= p{s} then 1 else 0 end as cross_{f}_{s}" for f, s in _PAIRS
) + " from done"


@query("ma_cross", on_bars(_CROSSES))
def ma_cross(spark, sf_dir):
    return ind.add_crosses(bars_daily(spark, sf_dir)).select("ticker", "dt", *(f"cross_{f}_{s}" for f, s in _PAIRS))


_KAMA = f""", k0 as (select ticker, dt, close, row_number() over o as i, abs(close - lag(close) over o) as m, abs(close - lag(close, 10) over o) as way from bars window o as (partition by ticker order by dt)),
k1 as (select *, case when count(m) over {rolling(10)} = 10 then sum(m) over {rolling(10)} end as path from k0),
k2 as materialized (select ticker, dt, i, close, power(case when path > 0 then way / path else 0.0 end * (2 / 3.0::double - 2 / 31.0::double) + 2 / 31.0::double, 2) as c from k1),
kr as (select ticker, i, close as kama from k2 where i = 10
  union all select k2.ticker, k2.i, kr.kama + k2.c * (k2.close - kr.kama) from kr join k2 on k2.ticker = kr.ticker and k2.i = kr.i + 1),
j_kama as (select ticker, dt, kama from k2 left join kr using (ticker, i))"""
#: The state of the parabolic rule after each bar: whether the stop rises, the stop, the extreme, the pace, whether it turned.
_PSAR = """, p0 as materialized (select ticker, dt, high, low, row_number() over o as i, lag(low) over o as l1, lag(low, 2) over o as l2, lag(high) over o as h1, lag(high, 2) over o as h2
  from bars where high is not null and low is not null window o as (partition by ticker order by dt)),
pr as (select ticker, i, true as up, low as stop, high as extreme, 0.02::double as pace, false as turned from p0 where i = 1
  union all select ticker, i, up <> turned, case when turned then extreme else stop end,
    case when turned then (case when up then low else high end) when (up and high > extreme) or (not up and low < extreme) then (case when up then high else low end) else extreme end,
    case when turned then 0.02::double when (up and high > extreme) or (not up and low < extreme) then least(0.2::double, pace + 0.02::double) else pace end, turned
  from (select *, case when up then low < stop else high > stop end as turned
    from (select p0.ticker, p0.i, pr.up, pr.extreme, pr.pace, p0.high, p0.low,
        case when pr.up then least(pr.stop + pr.pace * (pr.extreme - pr.stop), l1, coalesce(l2, l1)) else greatest(pr.stop + pr.pace * (pr.extreme - pr.stop), h1, coalesce(h2, h1)) end as stop
      from pr join p0 on p0.ticker = pr.ticker and p0.i = pr.i + 1))),
j_psar as (select ticker, dt, case when up then stop end as psar_up, case when not up then stop end as psar_down, (turned and up)::int as psar_up_flag, (turned and not up)::int as psar_down_flag from p0 join pr using (ticker, i))"""


@query("ind_kama", on_bars_recursive(_KAMA + f" select ticker, dt, round(kama, {DIGITS}) as kama from j_kama"))
def kama(spark, sf_dir):
    return ind.kama(bars_daily(spark, sf_dir)).select("ticker", "dt", F.round("kama", DIGITS).alias("kama"))


@query("ind_psar", on_bars_recursive(_PSAR + " select ticker, dt, psar_up, psar_down, psar_up_flag, psar_down_flag from j_psar"))
def psar(spark, sf_dir):
    return path_indicators.psar(bars_daily(spark, sf_dir))


def _all_sql() -> str:
    """Every indicator by its own chain, side by side, with the fill that all_indicators ends in."""
    parts = {n: f" as (with {_chain(*STEPS[n]).removeprefix(', ')} select ticker, dt, {', '.join(f.columns)} from done)" for n, f in ind.INDICATORS.items() if n in STEPS}
    average = ", ".join(f"{_sma('close', n)} as sma_{n}" for n in ind.AVERAGES)
    parts["average"] = f" as (select ticker, dt, {average}, close / nullif({_prev('close')}, 0) - 1 as pct_change from bars)"
    parts["cross"] = f" as (with {_CROSSES.removeprefix(', ')})"
    real = [c for n, f in ind.INDICATORS.items() for c in f.columns if c not in ind.FLAGS] + ["psar_up", "psar_down", "pct_change"] + [f"sma_{n}" for n in ind.AVERAGES]
    whole = [*ind.FLAGS, *(f"cross_{f}_{s}" for f, s in _PAIRS)]
    filled = lambda c: f"coalesce(last_value(case when isfinite({c}) then {c} end ignore nulls) over (partition by ticker order by dt rows between unbounded preceding and current row), 0.0)"
    return (
        _KAMA
        + _PSAR
        + "".join(f", j_{n}{sql}" for n, sql in parts.items())
        + " select ticker, dt, "
        + ", ".join([f"round({filled(c)} + {_NUDGE}, {DIGITS}) as {c}" if c not in _EXACT else f"{filled(c)} as {c}" for c in real] + [f"coalesce({c}, 0)::int as {c}" for c in whole])
        + " from bars "
        + " ".join(f"left join j_{n} using (ticker, dt)" for n in [*parts, "kama", "psar"])
    )


@query("all_indicators", on_bars_recursive(_all_sql()))
def all_indicators(spark, sf_dir):
    rows = ind.all_indicators(cut(bars_daily(spark, sf_dir), "bars"))
    return rows.select(*(F.round(F.col(c) + _NUDGE, DIGITS).alias(c) if t == "double" and c not in _EXACT else F.col(c) for c, t in rows.dtypes))
