"""Lenient typing: unreadable values become null, NaN becomes null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """Anything to double; unreadable text and NaN to null."""
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def whole(c: Column) -> Column:
    """Numeric key: coerced, then truncated toward zero."""
    return number(c).try_cast("int")


def instant(c: Column) -> Column:
    """Anything to timestamp; unreadable to null."""
    return c.try_cast("timestamp")


def seconds(c: Column) -> Column:
    """Timestamp to fractional epoch seconds (exact on microseconds)."""
    return F.unix_micros(c) / F.lit(1e6)


def finite_or_zero(c: Column) -> Column:
    """Null, NaN and infinities to zero."""
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(c)
