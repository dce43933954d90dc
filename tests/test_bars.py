"""Bars: what they are for odd ticks, and by what Spark sorts the ticks."""

import re

from pyspark.sql import functions as F

from barloom.plans import fixtures as fx
from barloom.sources.bars import bars_from_ticks


def test_ticks_are_sorted_by_a_number_first(spark, sf, capsys):
    fx.bars_daily(spark, sf).explain()
    first = re.findall(r"\bSort \[(\w+)#", capsys.readouterr().out)
    assert first and "ticker" not in first


def test_bars_of_nulls_and_ties(spark):
    rows = [("a", 1, 5, 2.0, 1.0), ("a", 1, 5, 3.0, 1.0), ("a", 1, 4, 9.0, 2.0), (None, 1, 1, 7.0, 1.0), ("a", None, 1, 8.0, 4.0), (None, None, 2, 6.0, 1.0), (None, None, 1, 1.0, 1.0)]
    ticks = spark.createDataFrame(rows, "name string, day int, k int, px double, n double").repartition(3)
    bars = bars_from_ticks(ticks, "name", F.col("day"), "px", "n", ["k", "px"])
    assert bars.columns == ["ticker", "dt", "open", "high", "low", "close", "volume"]
    assert {tuple(r) for r in bars.collect()} == {("a", 1, 9.0, 9.0, 2.0, 3.0, 4.0), (None, 1, 7.0, 7.0, 7.0, 7.0, 1.0), ("a", None, 8.0, 8.0, 8.0, 8.0, 4.0), (None, None, 1.0, 6.0, 1.0, 6.0, 2.0)}
