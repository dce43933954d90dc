"""Chart patterns on windows of three rows (by default). Masks of -1 are set after those of 1 and win."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import C, H, L, following, full, order, prev


def _mark(up: Column, down: Column) -> Column:
    """-1 where down holds, else 1 where up does, else 0; null counts as false."""
    return F.when(F.coalesce(down, F.lit(False)), -1).when(F.coalesce(up, F.lit(False)), 1).otherwise(0)


def _ranges(bars: DataFrame, n: int, prefix: str) -> tuple[DataFrame, Column, Column]:
    bars = bars.withColumns({f"{prefix}high_roll_max": full(F.max, "high", n), f"{prefix}low_roll_min": full(F.min, "low", n)})
    return bars, F.col(f"{prefix}high_roll_max"), F.col(f"{prefix}low_roll_min")


def head_shoulder(bars: DataFrame, n: int = 3, prefix: str = "hs_") -> DataFrame:
    """Looks one row ahead, so shift it by a row before it feeds a model."""
    bars, top, low = _ranges(bars, n, prefix)
    up = (top > prev("high")) & (top > following("high")) & (H() < prev("high")) & (H() < following("high"))
    down = (low < prev("low")) & (low < following("low")) & (L() > prev("low")) & (L() > following("low"))
    return bars.withColumn(f"{prefix}pattern", _mark(up, down))


def multi_top_bottom(bars: DataFrame, n: int = 3, prefix: str = "mtb_") -> DataFrame:
    """Always 0, since a window holds the row that its extreme must exceed; kept as it is defined."""
    bars, top, low = _ranges(bars, n, prefix)
    bars = bars.withColumns({f"{prefix}close_roll_max": full(F.max, "close", n), f"{prefix}close_roll_min": full(F.min, "close", n)})
    up = (top >= prev("high")) & (F.col(f"{prefix}close_roll_max") < prev("close"))
    down = (low <= prev("low")) & (F.col(f"{prefix}close_roll_min") > prev("close"))
    return bars.withColumn(f"{prefix}pattern", _mark(up, down))


def support_resistance(bars: DataFrame, n: int = 3, prefix: str = "sr_") -> DataFrame:
    support = full(F.avg, "low", n) - 2 * full(F.stddev_samp, "low", n)
    resistance = full(F.avg, "high", n) + 2 * full(F.stddev_samp, "high", n)
    bars = bars.withColumns({f"{prefix}support": support, f"{prefix}resistance": resistance})
    return bars.withColumns({f"{prefix}support_diff": C() - F.col(f"{prefix}support"), f"{prefix}resistance_diff": F.col(f"{prefix}resistance") - C()})


def triangle(bars: DataFrame, n: int = 3, prefix: str = "tri_") -> DataFrame:
    bars, top, low = _ranges(bars, n, prefix)
    up = (top >= prev("high")) & (low <= prev("low")) & (C() > prev("close"))
    down = (top <= prev("high")) & (low >= prev("low")) & (C() < prev("close"))
    return bars.withColumn(f"{prefix}pattern", _mark(up, down))


def _wedge(top: Column, low: Column, n: int) -> tuple[Column, Column]:
    high_trend, low_trend = F.signum(H() - prev("high", n - 1)), F.signum(L() - prev("low", n - 1))
    up = (top >= prev("high")) & (low <= prev("low")) & (high_trend == 1) & (low_trend == 1)
    down = (top <= prev("high")) & (low >= prev("low")) & (high_trend == -1) & (low_trend == -1)
    return up, down


def wedge(bars: DataFrame, n: int = 3, prefix: str = "wed_") -> DataFrame:
    bars, top, low = _ranges(bars, n, prefix)
    return bars.withColumn(f"{prefix}pattern", _mark(*_wedge(top, low, n)))


def channel(bars: DataFrame, n: int = 3, prefix: str = "chan_", width: float = 0.1) -> DataFrame:
    bars, top, low = _ranges(bars, n, prefix)
    up, down = _wedge(top, low, n)
    narrow = (top - low) <= width * (top + low) / 2
    return bars.withColumn(f"{prefix}pattern", _mark(up & narrow, down & narrow))


def double_top_bottom(bars: DataFrame, n: int = 3, prefix: str = "dbl_", threshold: float = 0.05) -> DataFrame:
    """Looks one row ahead, like head_shoulder."""
    bars, top, low = _ranges(bars, n, prefix)
    near = lambda at: (at("high") - at("low")) <= threshold * (at("high") + at("low")) / 2
    both = near(prev) & near(following)
    up = (top >= prev("high")) & (top >= following("high")) & (H() < prev("high")) & (H() < following("high")) & both
    down = (low <= prev("low")) & (low <= following("low")) & (L() > prev("low")) & (L() > following("low")) & both
    return bars.withColumn(f"{prefix}pattern", _mark(up, down))


def trendline(bars: DataFrame, n: int = 2, prefix: str = "trend_") -> DataFrame:
    """Least squares of close on the row number over the n rows before this one, drawn on to this row."""
    before = order().rowsBetween(-n, -1)
    bars = bars.withColumn("_i", (F.row_number().over(order()) - 1).cast("double"))
    enough = F.count("close").over(before) == n
    if n == 2:  # through two points, without the rounding of sums
        rise = prev("close") - prev("close", 2)
        line = (rise, prev("close", 2) - rise * (F.col("_i") - 2))
    else:
        line = (F.regr_slope("close", "_i").over(before), F.regr_intercept("close", "_i").over(before))
    slope, start = (F.when(enough, x).otherwise(0.0) for x in line)
    bars = bars.withColumns({f"{prefix}slope": slope, f"{prefix}intercept": start})
    line = F.col(f"{prefix}slope") * F.col("_i") + F.col(f"{prefix}intercept")
    bars = bars.withColumns({f"{prefix}support": F.when(F.col(f"{prefix}slope") > 0, line), f"{prefix}resistance": F.when(F.col(f"{prefix}slope") < 0, line)})
    return bars.withColumns({f"{prefix}support_diff": C() - F.col(f"{prefix}support"), f"{prefix}resistance_diff": F.col(f"{prefix}resistance") - C()}).drop("_i")


PATTERNS = {
    "pat_head_shoulder": head_shoulder,
    "pat_multi_top_bottom": multi_top_bottom,
    "support_resistance": support_resistance,
    "pat_triangle": triangle,
    "pat_wedge": wedge,
    "pat_channel": channel,
    "pat_double": double_top_bottom,
    "trendline": trendline,
}


def all_patterns(bars: DataFrame, n: int = 3) -> DataFrame:
    """Every pattern's columns next to ticker and dt; one exchange serves all windows."""
    for name, f in PATTERNS.items():
        bars = f(bars) if name == "trendline" else f(bars, n)
    return bars
