"""Building blocks on the one window spec (ticker, dt): frames that must be full, exponential means, running sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def order() -> WindowSpec:
    """The window of all operators: a ticker's rows by date. A function, since windows need a session."""
    return W.partitionBy("ticker").orderBy("dt")


def before() -> WindowSpec:
    return order().rowsBetween(W.unboundedPreceding, 0)


def after() -> WindowSpec:
    return order().rowsBetween(0, W.unboundedFollowing)


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def last(n: int):
    """The frame of the last n rows, this one included."""
    return order().rowsBetween(-(n - 1), 0)


def full(f, x: str | Column, n: int) -> Column:
    """f over the last n rows; null until n of them have a value."""
    return F.when(F.count(col(x)).over(last(n)) == n, f(col(x)).over(last(n)))


def sma(x: str | Column, n: int) -> Column:
    return full(F.avg, x, n)


def prev(x: str | Column, k: int = 1) -> Column:
    return F.lag(col(x), k).over(order())


def following(x: str | Column, k: int = 1) -> Column:
    return F.lead(col(x), k).over(order())


def running(x: Column) -> Column:
    """The sum of x from the first row to this one."""
    return F.sum(x).over(before())


#: An exponential mean is summed in blocks over which a weight falls by exp(SPAN) at most, so that none overflows; what
#: lies before the block ahead weighs less than exp(-SPAN), far below what a double can hold beside the rest.
SPAN = 100.0


def _in_blocks(df: DataFrame, parts: dict[str, tuple[Column, Column, Column, Column]]) -> DataFrame:
    """df with each name: sums of terms (x, weight) that fade with the exponent, from (term, block, exponent within it, place).

    Within a block: a running sum of term * exp(exponent), scaled back. Across blocks: the sum at the end of the one before.
    """
    tmp = lambda name: {k: f"_{k}_{name}" for k in ("x", "b", "r", "n", "s", "p")}
    t = {name: tmp(name) for name in parts}
    df = df.withColumns({t[name][k]: c for name, cs in parts.items() for k, c in zip("xbrn", cs, strict=True)})
    inside = lambda n: W.partitionBy("ticker", n["b"]).orderBy("dt").rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumns({n["s"]: F.sum(F.col(n["x"]) * F.exp(n["r"])).over(inside(n)) * F.exp(-F.col(n["r"])) for n in t.values()})
    ahead = lambda n: W.partitionBy("ticker").orderBy(n["b"]).rangeBetween(-1, -1)
    df = df.withColumns({n["p"]: F.max(F.struct(F.col(n["n"]).alias("n"), F.col(n["s"]).alias("s"))).over(ahead(n)) for n in t.values()})
    out = {name: F.col(n["s"]) + F.coalesce(F.col(n["p"])["s"] * F.exp(F.col(n["p"])["n"] - F.col(n["n"])), F.lit(0.0)) for name, n in t.items()}
    return df.withColumns(out).drop(*(c for n in t.values() for c in n.values()))


def with_emas(df: DataFrame, of: dict[str, tuple[str | Column, float]]) -> DataFrame:
    """df with each name: e = e + alpha * (x - e) from the first x on, for (x, alpha). Nulls are passed over.

    The whole history counts, for any alpha, in a fixed number of windows: no row looks at more than its block's sums.
    """
    of = {name: (col(x), a) for name, (x, a) in of.items()}
    df = df.withColumns({f"_v_{name}": x.cast("double") for name, (x, _) in of.items()})
    df = df.withColumns({f"_k_{name}": F.count(f"_v_{name}").over(before()) - 1 for name in of})
    parts = {}
    for name, (_, a) in of.items():
        step = -math.log1p(-min(a, 1 - 1e-15))
        size = max(1, int(SPAN / step))
        x, k = F.col(f"_v_{name}"), F.col(f"_k_{name}")
        parts[name] = (F.when(k == 0, x).otherwise(x * a), F.floor(k / size), F.pmod(k, F.lit(size)) * step, k * step)
    return _in_blocks(df, parts).drop(*(f"_{c}_{name}" for name in of for c in "vk"))


def with_recurrence(df: DataFrame, name: str, x: Column, c: Column) -> DataFrame:
    """df with name: k = k + c * (x - k) from the first x on, where c, from 0 to below 1, differs from row to row."""
    df = df.withColumns({"_v": x.cast("double"), "_c": c.cast("double")})
    df = df.withColumn("_k", F.count("_v").over(before()))
    start = F.col("_k") == 1
    fade = F.when(F.col("_v").isNull() | start, 0.0).otherwise(-F.log1p(-F.least("_c", F.lit(1 - 1e-15))))
    df = df.withColumn("_e", F.when(F.col("_k") > 0, F.sum(fade).over(before())))
    block = F.floor(F.col("_e") / SPAN)
    return _in_blocks(df, {name: (F.when(start, F.col("_v")).otherwise(F.col("_v") * F.col("_c")), block, F.col("_e") - block * SPAN, F.col("_e"))}).drop("_v", "_c", "_k", "_e")


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return a / F.when(b != 0, b)


def C() -> Column:  # noqa: N802
    return F.col("close")


def H() -> Column:  # noqa: N802
    return F.col("high")


def L() -> Column:  # noqa: N802
    return F.col("low")


def V() -> Column:  # noqa: N802
    return F.col("volume")
