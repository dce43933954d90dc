"""Labels that look ahead: whether, when and how far prices go within a horizon of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..functions.windows import order


def targets(bars: DataFrame, horizon: int = 90, up: float = 0.20, down: float = -0.05, truncate: bool = True) -> DataFrame:
    """target_up, target_down: does High reach close * (1 + up), or Low close * (1 + down), in the next rows?

    Truncated at the end of history, where fewer rows are left; with truncate=False such rows get null.
    """
    ahead = order().rowsBetween(1, horizon)
    hit = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    enough = F.lit(True) if truncate else F.count("*").over(ahead) == horizon
    return bars.withColumns(
        {
            "target_up": F.when(enough, hit(F.max("high").over(ahead) >= F.col("close") * (1 + up))),
            "target_down": F.when(enough, hit(F.min("low").over(ahead) <= F.col("close") * (1 + down))),
        }
    )


def _first(values: np.ndarray, limit: np.ndarray, last: np.ndarray) -> np.ndarray:
    """How many rows after each the first value of at least its limit stands, up to row `last`; 0 for none.

    Maxima over 1, 2, 4, ... rows form a pyramid; from the top down, a stretch without a hit is skipped whole.
    """
    n, levels = len(values), [values]
    while (step := 1 << (len(levels) - 1)) <= int((last - np.arange(n)).max(initial=0)):
        levels.append(np.maximum(levels[-1], levels[-1][np.minimum(np.arange(n) + step, n - 1)]))
    at = np.arange(n) + 1
    for k in range(len(levels) - 1, -1, -1):
        skip = (at + (1 << k) <= last + 1) & (levels[k][np.minimum(at, n - 1)] < limit)
        at = at + np.where(skip, 1 << k, 0)
    hit = (at <= last) & (values[np.minimum(at, n - 1)] >= limit)
    return np.where(hit, at - np.arange(n), 0)


def hit_rows(bars: DataFrame, horizon: int, up: float, down: float) -> DataFrame:
    """bars with up_row, down_row: how many rows ahead High first reaches, and Low first falls to, the threshold; 0 for never.

    A ticker's rows stream by in the order of their dates; a task holds the next `horizon` rows and searches pyramids of
    their maxima, so a longer horizon costs its logarithm. Null prices hit nothing.
    """
    ship(bars.sparkSession)
    bars = bars.drop("up_row", "down_row")

    def found(table: pa.Table, ready: int) -> pa.RecordBatch:
        tickers = table.column("ticker").to_pandas().to_numpy()
        high, low, close = (table.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("high", "low", "close"))
        n = len(tickers)
        same = np.array([a == b or (a is None and b is None) for a, b in zip(tickers[1:], tickers[:-1], strict=True)], bool)
        ends = np.append(np.flatnonzero(~same), n - 1)
        last = np.minimum(ends[np.searchsorted(ends, np.arange(n))], np.arange(n) + horizon)
        rows = {}
        for name, values, limit in (("up_row", high, close * (1 + up)), ("down_row", -low, -(close * (1 + down)))):
            rows[name] = _first(np.where(np.isnan(values), -np.inf, values), np.where(np.isnan(limit), np.inf, limit), last)
        out = table.slice(0, ready)
        for name, r in rows.items():
            out = out.append_column(name, pa.array(r[:ready].astype(np.int32)))
        return out

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new]).combine_chunks()
            if (ready := held.num_rows - horizon) > horizon:
                yield from found(held, ready).to_batches()
                held = held.slice(ready)
        if held is not None and held.num_rows:
            yield from found(held, held.num_rows).to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema.fields)
    ordered = bars.repartition("ticker").sortWithinPartitions("ticker", "dt")
    return ordered.mapInArrow(search, f"{schema}, up_row int, down_row int")


def first_hit(bars: DataFrame, horizon: int, up: float, down: float) -> DataFrame:
    """target_first_hit: 1 if up comes first, 0 if down does or both come in one row, -1 if neither comes."""
    u, d = F.col("up_row"), F.col("down_row")
    first = F.when((u == 0) & (d == 0), -1).when(d == 0, 1).when(u == 0, 0).when(u < d, 1).otherwise(0)
    return hit_rows(bars, horizon, up, down).withColumn("target_first_hit", first)


def path_aware(bars: DataFrame, horizon: int = 30, up: float = 0.15, down: float = -0.05) -> DataFrame:
    """target_path: 1 if up is hit, and before any hit of down."""
    u, d = F.col("up_row"), F.col("down_row")
    return hit_rows(bars, horizon, up, down).withColumn("target_path", ((u > 0) & ((d == 0) | (u < d))).cast("int"))


def best_entry_sale(bars: DataFrame, horizon: int = 90) -> DataFrame:
    """target_best_entry, target_best_sale: the least Low and greatest High from today to horizon rows ahead."""
    ahead = order().rowsBetween(0, horizon)
    return bars.withColumns({"target_best_entry": F.min("low").over(ahead), "target_best_sale": F.max("high").over(ahead)})


def normalised(target: Column, close: Column) -> Column:
    """(target - close) / close; null where close is 0."""
    return (target - close) / F.when(close != 0, close)
