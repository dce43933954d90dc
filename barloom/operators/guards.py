"""Checks that stop a run before it trains or reports on what can't be right."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .splits import split_guards


def with_columns_of(df: DataFrame, names: list[str], what: str = "table") -> DataFrame:
    """df, if it has all columns of names; otherwise ValueError with those that are missing. No job runs."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {', '.join(missing)}")
    return df


def with_rows(df: DataFrame, what: str = "table") -> DataFrame:
    """df, if it has a row; otherwise ValueError. The job ends at the first row found."""
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df


def usable_split(calendar: DataFrame, apply: int = 5, valid: int = 90, purge: int = 30) -> DataFrame:
    """calendar (dt, pos, split) as `purged_split` makes it, if it has enough dates and its parts lie in order; otherwise ValueError.

    A calendar whose parts can't be compared, for want of valid or apply dates, isn't in order.
    """
    with_columns_of(calendar, ["dt", "split"], "calendar")
    found = split_guards(calendar, apply, valid, purge).first()
    if not found["enough_history"]:
        raise ValueError(f"fewer than {apply + valid + purge + 5} dates")
    if not found["ordered"]:
        raise ValueError("train, valid and apply dates aren't in order")
    return calendar
