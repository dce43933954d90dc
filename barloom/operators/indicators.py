"""Technical indicators by their published definitions, as columns over the one window (ticker, dt).

Each function takes bars (ticker, dt, open, high, low, close, volume) and adds its columns. Values are null while a
window isn't full and where a denominator is 0. Indicators that feed on others go layer by layer, one select each.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.windows import C, H, L, V, full, last, order, prev, ratio, running, sma, with_emas, with_recurrence
from .fill import fill_gaps, pct_change
from .path_indicators import psar

#: The moving averages.
AVERAGES = (1, 2, 5, 10, 15, 20, 25, 50, 100)
INDICATORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def indicator(*names: str):
    """Registers a function that adds the columns named."""

    def add(f):
        INDICATORS[f.__name__] = f
        f.columns = names
        return f

    return add


def add_smas(bars: DataFrame, periods: tuple[int, ...] = AVERAGES) -> DataFrame:
    return bars.withColumns({f"sma_{n}": sma("close", n) for n in periods})


def add_crosses(bars: DataFrame, periods: tuple[int, ...] = AVERAGES) -> DataFrame:
    """cross_f_s for each fast f below slow s: -1 as the fast one falls below, 1 as it rises above, else 0."""
    rows = add_smas(bars, periods)
    before = rows.withColumns({f"_p{n}": prev(f"sma_{n}") for n in periods})
    mark = {}
    for fast, slow in combinations(periods, 2):
        f, s, pf, ps = F.col(f"sma_{fast}"), F.col(f"sma_{slow}"), F.col(f"_p{fast}"), F.col(f"_p{slow}")
        mark[f"cross_{fast}_{slow}"] = F.when((f < s) & (pf >= ps), -1).when((f > s) & (pf <= ps), 1).otherwise(0)
    return before.withColumns(mark).drop(*(f"_p{n}" for n in periods))


def true_range() -> Column:
    return F.greatest(H() - L(), F.abs(H() - prev("close")), F.abs(L() - prev("close")))


def typical() -> Column:
    return (H() + L() + C()) / 3


def of_period(n: int) -> float:
    """The alpha of an exponential mean over n rows."""
    return 2 / (n + 1)


@indicator("ema_12")
def ema_12(b):
    return with_emas(b, {"ema_12": ("close", of_period(12))})


def _macd(b: DataFrame, x: str, name: str, relative: bool) -> DataFrame:
    b = with_emas(b, {"_fast": (x, of_period(12)), "_slow": (x, of_period(26))})
    b = b.withColumn(name, 100 * ratio(F.col("_fast") - F.col("_slow"), F.col("_slow")) if relative else F.col("_fast") - F.col("_slow"))
    b = with_emas(b, {f"{name}_signal": (name, of_period(9))})
    return b.withColumn(f"{name}_hist", F.col(name) - F.col(f"{name}_signal")).drop("_fast", "_slow")


@indicator("macd", "macd_signal", "macd_hist")
def macd(b):
    return _macd(b, "close", "macd", False)


@indicator("ppo", "ppo_signal", "ppo_hist")
def ppo(b):
    return _macd(b, "close", "ppo", True)


@indicator("pvo", "pvo_signal", "pvo_hist")
def pvo(b):
    return _macd(b, "volume", "pvo", True)


@indicator("trix")
def trix(b):
    for x, e in (("close", "_e1"), ("_e1", "_e2"), ("_e2", "_e3")):
        b = with_emas(b, {e: (x, of_period(15))})
    return b.withColumn("trix", 100 * (ratio(F.col("_e3"), prev("_e3")) - 1)).drop("_e1", "_e2", "_e3")


@indicator("tsi")
def tsi(b):
    b = b.withColumn("_d", C() - prev("close"))
    b = with_emas(b, {"_a": ("_d", of_period(25)), "_b": (F.abs("_d"), of_period(25))})
    b = with_emas(b, {"_a2": ("_a", of_period(13)), "_b2": ("_b", of_period(13))})
    return b.withColumn("tsi", 100 * ratio(F.col("_a2"), F.col("_b2"))).drop("_d", "_a", "_b", "_a2", "_b2")


def _with_rsi(b: DataFrame, name: str, n: int = 14) -> DataFrame:
    b = b.withColumn("_d", C() - prev("close"))
    b = with_emas(b, {"_g": (F.greatest("_d", F.lit(0.0)) + 0 * F.col("_d"), 1 / n), "_l": (F.greatest(-F.col("_d"), F.lit(0.0)) + 0 * F.col("_d"), 1 / n)})
    return b.withColumn(name, 100 * ratio(F.col("_g"), F.col("_g") + F.col("_l"))).drop("_d", "_g", "_l")


@indicator("rsi")
def rsi(b):
    return _with_rsi(b, "rsi")


@indicator("stoch_rsi", "stoch_rsi_k", "stoch_rsi_d")
def stoch_rsi(b):
    b = _with_rsi(b, "_rsi")
    lo, hi = full(F.min, "_rsi", 14), full(F.max, "_rsi", 14)
    b = b.withColumn("stoch_rsi", ratio(F.col("_rsi") - lo, hi - lo))
    b = b.withColumn("stoch_rsi_k", sma("stoch_rsi", 3))
    return b.withColumn("stoch_rsi_d", sma("stoch_rsi_k", 3)).drop("_rsi")


@indicator("stoch_k", "stoch_d")
def stochastic(b):
    lo, hi = full(F.min, "low", 14), full(F.max, "high", 14)
    b = b.withColumn("stoch_k", 100 * ratio(C() - lo, hi - lo))
    return b.withColumn("stoch_d", sma("stoch_k", 3))


@indicator("williams_r")
def williams_r(b):
    lo, hi = full(F.min, "low", 14), full(F.max, "high", 14)
    return b.withColumn("williams_r", -100 * ratio(hi - C(), hi - lo))


@indicator("roc")
def roc(b):
    return b.withColumn("roc", 100 * (ratio(C(), prev("close", 12)) - 1))


@indicator("ao")
def ao(b):
    return b.withColumn("ao", sma((H() + L()) / 2, 5) - sma((H() + L()) / 2, 34))


@indicator("uo")
def uo(b):
    low = F.least(L(), prev("close"))
    b = b.withColumns({"_bp": C() - low, "_tr": F.greatest(H(), prev("close")) - low})
    part = lambda n: ratio(full(F.sum, "_bp", n), full(F.sum, "_tr", n))
    return b.withColumn("uo", 100 * (4 * part(7) + 2 * part(14) + part(28)) / 7).drop("_bp", "_tr")


@indicator("bb_m", "bb_h", "bb_l", "bb_w", "bb_p", "bb_hi", "bb_li")
def bollinger(b):
    b = b.withColumns({"bb_m": sma("close", 20), "_s": full(F.stddev_pop, "close", 20)})
    b = b.withColumns({"bb_h": F.col("bb_m") + 2 * F.col("_s"), "bb_l": F.col("bb_m") - 2 * F.col("_s")})
    return b.withColumns(
        {
            "bb_w": 100 * ratio(F.col("bb_h") - F.col("bb_l"), F.col("bb_m")),
            "bb_p": ratio(C() - F.col("bb_l"), F.col("bb_h") - F.col("bb_l")),
            "bb_hi": F.coalesce(C() > F.col("bb_h"), F.lit(False)).cast("int"),
            "bb_li": F.coalesce(C() < F.col("bb_l"), F.lit(False)).cast("int"),
        }
    ).drop("_s")


@indicator("kc_m", "kc_h", "kc_l")
def keltner(b):
    b = b.withColumns({"kc_m": sma(typical(), 10), "_r": sma(H() - L(), 10)})
    return b.withColumns({"kc_h": F.col("kc_m") + F.col("_r"), "kc_l": F.col("kc_m") - F.col("_r")}).drop("_r")


@indicator("dc_h", "dc_l", "dc_m", "dc_w", "dc_p")
def donchian(b):
    b = b.withColumns({"dc_h": full(F.max, "high", 20), "dc_l": full(F.min, "low", 20)})
    h, l = F.col("dc_h"), F.col("dc_l")  # noqa: E741
    return b.withColumns({"dc_m": (h + l) / 2, "dc_w": 100 * ratio(h - l, sma("close", 20)), "dc_p": ratio(C() - l, h - l)})


@indicator("true_range", "atr")
def atr(b):
    b = b.withColumn("true_range", true_range())
    return with_emas(b, {"atr": ("true_range", 1 / 14)})


@indicator("ulcer")
def ulcer(b):
    top = full(F.max, "close", 14)
    b = b.withColumn("_d", F.pow(100 * ratio(C() - top, top), 2))
    return b.withColumn("ulcer", F.sqrt(sma("_d", 14))).drop("_d")


@indicator("obv")
def obv(b):
    b = b.withColumn("_s", F.coalesce(F.signum(C() - prev("close")), F.lit(0.0)) * V())
    return b.withColumn("obv", running(F.col("_s"))).drop("_s")


def _flow() -> Column:
    return F.coalesce(ratio((C() - L()) - (H() - C()), H() - L()), F.lit(0.0)) * V()


@indicator("adi")
def adi(b):
    return b.withColumn("adi", running(_flow()))


@indicator("cmf")
def cmf(b):
    return b.withColumn("cmf", ratio(full(F.sum, _flow(), 20), full(F.sum, V(), 20)))


@indicator("force_index")
def force_index(b):
    b = b.withColumn("_f", (C() - prev("close")) * V())
    return with_emas(b, {"force_index": ("_f", of_period(13))}).drop("_f")


@indicator("eom", "eom_sma")
def eom(b):
    b = b.withColumn("_m", (H() + L()) / 2)
    b = b.withColumn("eom", ratio((F.col("_m") - prev("_m")) * (H() - L()), V())).drop("_m")
    return b.withColumn("eom_sma", sma("eom", 14))


@indicator("vpt")
def vpt(b):
    b = b.withColumn("_x", F.coalesce(V() * (ratio(C(), prev("close")) - 1), F.lit(0.0)))
    return b.withColumn("vpt", running(F.col("_x"))).drop("_x")


@indicator("vwap")
def vwap(b):
    return b.withColumn("vwap", ratio(full(F.sum, typical() * V(), 14), full(F.sum, V(), 14)))


@indicator("mfi")
def mfi(b):
    b = b.withColumn("_tp", typical())
    b = b.withColumn("_ch", F.col("_tp") - prev("_tp"))
    flow = F.col("_tp") * V()
    b = b.withColumns({"_up": F.when(F.col("_ch") > 0, flow).when(F.col("_ch").isNotNull(), 0.0), "_dn": F.when(F.col("_ch") < 0, flow).when(F.col("_ch").isNotNull(), 0.0)})
    up, down = full(F.sum, "_up", 14), full(F.sum, "_dn", 14)
    return b.withColumn("mfi", 100 * ratio(up, up + down)).drop("_tp", "_ch", "_up", "_dn")


@indicator("nvi")
def nvi(b):
    b = b.withColumn("_g", F.when(V() < prev("volume"), F.log(ratio(C(), prev("close")))).otherwise(0.0))
    return b.withColumn("nvi", 1000 * F.exp(running(F.col("_g")))).drop("_g")


@indicator("vortex_pos", "vortex_neg", "vortex_diff")
def vortex(b):
    b = b.withColumns({"_tr": true_range() + 0 * prev("close"), "_p": F.abs(H() - prev("low")), "_n": F.abs(L() - prev("high"))})
    tr = full(F.sum, "_tr", 14)
    b = b.withColumns({"vortex_pos": ratio(full(F.sum, "_p", 14), tr), "vortex_neg": ratio(full(F.sum, "_n", 14), tr)})
    return b.withColumn("vortex_diff", F.col("vortex_pos") - F.col("vortex_neg")).drop("_tr", "_p", "_n")


@indicator("mass_index")
def mass_index(b):
    b = with_emas(b, {"_e1": (H() - L(), of_period(9))})
    b = with_emas(b, {"_e2": ("_e1", of_period(9))})
    b = b.withColumn("_r", ratio(F.col("_e1"), F.col("_e2")))
    return b.withColumn("mass_index", full(F.sum, "_r", 25)).drop("_e1", "_e2", "_r")


@indicator("dpo")
def dpo(b):
    return b.withColumn("dpo", prev("close", 11) - sma("close", 20))


@indicator("kst", "kst_sig")
def kst(b):
    b = b.withColumns({f"_r{n}": 100 * (ratio(C(), prev("close", n)) - 1) for n in (10, 15, 20, 30)})
    b = b.withColumn("kst", sma("_r10", 10) + 2 * sma("_r15", 10) + 3 * sma("_r20", 10) + 4 * sma("_r30", 15))
    return b.withColumn("kst_sig", sma("kst", 9)).drop("_r10", "_r15", "_r20", "_r30")


@indicator("ich_conv", "ich_base", "ich_a", "ich_b")
def ichimoku(b):
    middle = lambda n: (full(F.max, "high", n) + full(F.min, "low", n)) / 2
    b = b.withColumns({"ich_conv": middle(9), "ich_base": middle(26), "ich_b": middle(52)})
    return b.withColumn("ich_a", (F.col("ich_conv") + F.col("ich_base")) / 2)


@indicator("cci")
def cci(b):
    b = b.withColumn("_tp", typical())
    b = b.withColumns({"_m": sma("_tp", 20), "_x": F.collect_list("_tp").over(last(20))})
    away = F.aggregate("_x", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_m"))) / 20
    return b.withColumn("cci", ratio(F.col("_tp") - F.col("_m"), 0.015 * away)).drop("_tp", "_m", "_x")


@indicator("adx", "adx_pos", "adx_neg")
def adx(b):
    up, down = H() - prev("high"), prev("low") - L()
    b = b.withColumns({"_p": F.when((up > down) & (up > 0), up).when(up.isNotNull(), 0.0), "_n": F.when((down > up) & (down > 0), down).when(up.isNotNull(), 0.0), "_tr": true_range() + 0 * prev("close")})
    b = with_emas(b, {"_a": ("_tr", 1 / 14), "_up": ("_p", 1 / 14), "_down": ("_n", 1 / 14)})
    b = b.withColumns({"adx_pos": 100 * ratio(F.col("_up"), F.col("_a")), "adx_neg": 100 * ratio(F.col("_down"), F.col("_a"))})
    b = b.withColumn("_dx", 100 * ratio(F.abs(F.col("adx_pos") - F.col("adx_neg")), F.col("adx_pos") + F.col("adx_neg")))
    return with_emas(b, {"adx": ("_dx", 1 / 14)}).drop("_p", "_n", "_tr", "_a", "_up", "_down", "_dx")


@indicator("aroon_up", "aroon_down", "aroon_diff")
def aroon(b):
    n = 25
    b = b.withColumn("_i", F.row_number().over(order()))
    w = last(n)
    since = lambda at: 100 * (n - (F.col("_i") - at)) / F.lit(float(n))
    enough = F.count("*").over(w) == n
    top = F.max(F.struct("high", "_i")).over(w)["_i"]
    low = F.min(F.struct(F.col("low"), -F.col("_i"))).over(w).getField("col2")
    b = b.withColumns({"aroon_up": F.when(enough, since(top)), "aroon_down": F.when(enough, since(-low))})
    return b.withColumn("aroon_diff", F.col("aroon_up") - F.col("aroon_down")).drop("_i")


@indicator("stc")
def stc(b):
    b = with_emas(b, {"_fast": ("close", of_period(23)), "_slow": ("close", of_period(50))})
    b = b.withColumn("_x", F.col("_fast") - F.col("_slow"))
    for _ in range(2):
        lo, hi = full(F.min, "_x", 10), full(F.max, "_x", 10)
        b = b.withColumn("_k", 100 * ratio(F.col("_x") - lo, hi - lo))
        b = with_emas(b.drop("_x"), {"_x": ("_k", of_period(3))})
    return b.withColumn("stc", F.col("_x")).drop("_fast", "_slow", "_x", "_k")


@indicator("kama")
def kama(b, n: int = 10, fast: int = 2, slow: int = 30):
    """The adaptive mean: from the n-th close on, alpha goes from slow to fast with the share of a path that was progress."""
    b = b.withColumns({"_i": F.row_number().over(order()), "_m": F.abs(C() - prev("close"))})
    b = b.withColumns({"_path": full(F.sum, "_m", n), "_way": F.abs(C() - prev("close", n))})
    e = F.when(F.col("_path") > 0, F.col("_way") / F.col("_path")).otherwise(0.0)
    c = F.pow(e * (of_period(fast) - of_period(slow)) + of_period(slow), 2)
    return with_recurrence(b, "kama", F.when(F.col("_i") >= n, C()), c).drop("_i", "_m", "_path", "_way")


@indicator("daily_return", "log_return", "cum_return")
def returns(b):
    first = F.first("close").over(order().rowsBetween(W.unboundedPreceding, 0))
    return b.withColumns({"daily_return": 100 * (ratio(C(), prev("close")) - 1), "log_return": F.log(ratio(C(), prev("close"))), "cum_return": 100 * (ratio(C(), first) - 1)})


#: The columns of all_indicators that count or flag; the others are real numbers.
FLAGS = ("bb_hi", "bb_li", "psar_up_flag", "psar_down_flag")


#: Indicators in one chain of windows; longer chains make plans deeper than Spark's planner goes.
CHAIN = 6


def all_indicators(bars: DataFrame, fill: bool = True) -> DataFrame:
    """ticker, dt and every indicator, moving average, cross and the change of close of bars; one column each.

    With fill, values that are missing or infinite take the ticker's last one before, or 0 where there is none. Bars
    without high or low have no parabolic stop. The indicators go in chains of CHAIN, side by side, which join on the key;
    within a chain all windows share one exchange. bars are read once for each chain, so hand over a table.
    """
    real = [*(f"sma_{n}" for n in AVERAGES), "pct_change", *(c for f in INDICATORS.values() for c in f.columns if c not in FLAGS), "psar_up", "psar_down"]
    whole = [*(f"cross_{f}_{s}" for f, s in combinations(AVERAGES, 2)), *FLAGS]
    key, every = ["ticker", "dt"], list(INDICATORS.values())
    chains = [add_crosses(bars).withColumn("pct_change", pct_change("close")), psar(bars)]
    for k in range(0, len(every), CHAIN):
        rows = bars
        for f in every[k : k + CHAIN]:
            rows = f(rows)
        chains.append(rows)
    done = bars.select(key)
    for rows in chains:
        columns = [c for c in [*real, *whole] if c in rows.columns]
        if fill:
            rows = fill_gaps(rows, [c for c in columns if c in real], backward=False)
        done = done.join(rows.select(*key, *columns), key, "left")
    if fill:
        done = fill_gaps(done, ["psar_up", "psar_down"], backward=False)  # bars that the parabolic stop has no row for
    return done.select(*key, *real, *(F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c) for c in whole))
