"""Gaps, types and shapes of the panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import after, before, order


def align_calendar(bars: DataFrame) -> DataFrame:
    """Every ticker on every date of any ticker, each field carried forward from its last value.

    The calendar and the tickers are both small next to the bars; the calendar is handed to each ticker as one array, so
    no rows meet but those of the result.
    """
    calendar = bars.agg(F.sort_array(F.collect_set("dt")).alias("days"))
    grid = bars.select("ticker").distinct().join(F.broadcast(calendar), F.lit(True)).select("ticker", F.explode("days").alias("dt"))
    fields = [c for c in bars.columns if c not in ("ticker", "dt")]
    return grid.join(bars, ["ticker", "dt"], "left").select("ticker", "dt", *(F.last(c, ignorenulls=True).over(before()).alias(c) for c in fields))


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def fill_gaps(df: DataFrame, columns: list[str], backward: bool = True) -> DataFrame:
    """Infinite to null, then the last value before, then (if backward) the next one after, then 0."""
    df = df.withColumns({c: finite(F.col(c).cast("double")) for c in columns})
    ahead = lambda c: [F.first(c, ignorenulls=True).over(after())] if backward else []
    return df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(before()), *ahead(c), F.lit(0.0)) for c in columns})


def compact_types(df: DataFrame, keys: tuple[str, ...] = ("ticker", "dt")) -> DataFrame:
    """Flags (cross_*, *pattern, class targets) as tinyint, other numbers as float."""
    flag = lambda c: c.startswith("cross_") or c.endswith("pattern") or c in ("target_up", "target_down")
    return df.select(*(F.col(c) if c in keys else F.col(c).cast("tinyint" if flag(c) else "float").alias(c) for c in df.columns))


def shift_features(df: DataFrame, columns: list[str], rows: int) -> DataFrame:
    return df.withColumns({c: F.lag(c, rows).over(order()) for c in columns}) if rows else df


def stack_long(wide: DataFrame, columns: list[str]) -> DataFrame:
    """ticker, dt, feature, value."""
    return wide.select("ticker", "dt", *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(["ticker", "dt"], columns, "feature", "value")


def mask_features(wide: DataFrame, selection: DataFrame, columns: list[str]) -> DataFrame:
    """Features that a ticker hasn't selected are 0.0; selection is (ticker, feature), one short list per ticker."""
    chosen = selection.groupBy("ticker").agg(F.collect_set("feature").alias("_chosen"))
    rows = wide.join(chosen, "ticker")
    return rows.select("ticker", "dt", *(F.when(F.array_contains("_chosen", c), F.coalesce(F.col(c).cast("double"), F.lit(0.0))).otherwise(0.0).alias(c) for c in columns))


def dummies(df: DataFrame, tickers: list[str]) -> DataFrame:
    return df.withColumns({f"tk_{t}": (F.col("ticker") == t).cast("int") for t in tickers})


def recover_ticker(df: DataFrame, tickers: list[str]) -> DataFrame:
    """ticker from the greatest of its dummies, the first on ties."""
    most = F.greatest(*(F.col(f"`tk_{t}`") for t in tickers)) if len(tickers) > 1 else F.col(f"`tk_{tickers[0]}`")
    return df.withColumn("ticker_rec", F.coalesce(*(F.when(F.col(f"`tk_{t}`") == most, F.lit(t)) for t in tickers)))


def numeric_clean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text and numbers to doubles; what is no finite number is 0."""
    return df.withColumns({c: F.coalesce(finite(F.col(c).try_cast("double")), F.lit(0.0)) for c in columns})


def align_columns(df: DataFrame, expected: list[str], keys: tuple[str, ...] = ("ticker", "dt")) -> DataFrame:
    """The keys and the expected columns in order; missing ones are 0.0."""
    return df.select(*keys, *(F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in expected))


def pct_change(x: str = "close") -> Column:
    before = F.lag(x).over(order())
    return F.col(x) / F.when(before != 0, before) - 1


def asset_type(ticker: Column) -> Column:
    """The suffix of shares and the marks of indices, coins and metals."""
    return F.when(ticker.endswith(".SA"), "stock").when(ticker.rlike(r"\^|BTC|ETH|GC=F|SI=F|CL=F"), "index_commodity").otherwise("other")


def last_dates(df: DataFrame, n: int) -> DataFrame:
    """Rows of the last n distinct dates."""
    return df.join(F.broadcast(df.select("dt").distinct().orderBy(F.desc("dt")).limit(n)), "dt", "left_semi")
