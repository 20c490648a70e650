"""Joins whose strategy must not be left to an estimate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.functions import broadcast


def spread(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the data and must never be broadcast.

    The size of exploded rows, of fields picked out of nested columns and of
    checkpointed results is estimated far too low before the run; by it the
    engine would send them to every executor. With this both sides are shuffled.
    """
    return df.hint("merge")


def sized(df: DataFrame, rows: int, most: int = 50_000) -> DataFrame:
    """A side of a join whose number of rows was counted: broadcast up to a bound, shuffled beyond it."""
    return broadcast(df) if rows <= most else spread(df)
