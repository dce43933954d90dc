"""The parabolic stop and reverse: each row's state hangs on the row before, so each ticker is one ordered pass."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship

#: What the stop's pace begins with and grows by, and its most.
STEP, MOST = 0.02, 0.2
_COLUMNS = ["ticker", "dt", "psar_up", "psar_down", "psar_up_flag", "psar_down_flag"]


class Stop:
    """The rule's state: the stop, whether it rises, the extreme since it turned, the pace, and the last two bars."""

    def __init__(self, high: float, low: float):
        self.up, self.stop, self.extreme, self.pace = True, low, high, STEP
        self.highs, self.lows = [high], [low]

    def next(self, high: float, low: float) -> bool:
        """Takes the next bar; True if the stop turns."""
        self.stop += self.pace * (self.extreme - self.stop)
        self.stop = min(self.stop, *self.lows) if self.up else max(self.stop, *self.highs)
        turned = low < self.stop if self.up else high > self.stop
        if turned:
            self.up, self.stop, self.pace = not self.up, self.extreme, STEP
            self.extreme = high if self.up else low
        elif (high > self.extreme) if self.up else (low < self.extreme):
            self.extreme, self.pace = high if self.up else low, min(MOST, self.pace + STEP)
        self.highs, self.lows = [*self.highs[-1:], high], [*self.lows[-1:], low]
        return turned


def _pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over bars sorted by ticker and date: the state goes on from batch to batch, so no task holds a whole ticker."""
    ticker, state = None, None
    for batch in batches:
        rows = []
        for t, dt, high, low in batch[["ticker", "dt", "high", "low"]].itertuples(index=False, name=None):
            if state is None or t != ticker:
                ticker, state, turned = t, Stop(high, low), False
            else:
                turned = state.next(high, low)
            up = state.up
            rows.append((t, dt, state.stop if up else None, None if up else state.stop, int(turned and up), int(turned and not up)))
        yield pd.DataFrame(rows, columns=_COLUMNS)


def psar(bars: DataFrame) -> DataFrame:
    """psar_up, psar_down (the one that holds), psar_up_flag, psar_down_flag (1 where the stop turns that way).

    Rows without high or low take no part.
    """
    ship(bars.sparkSession)
    rows = bars.select("ticker", "dt", F.col("high").cast("double").alias("high"), F.col("low").cast("double").alias("low")).where("high is not null and low is not null")
    ordered = rows.repartition("ticker").sortWithinPartitions("ticker", "dt")
    return ordered.mapInPandas(_pass, "ticker string, dt date, psar_up double, psar_down double, psar_up_flag int, psar_down_flag int")
