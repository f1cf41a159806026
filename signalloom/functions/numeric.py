"""Number and date helpers with explicit rounding and clock rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column) -> Column:
    """Round to the nearest integer, halves toward plus infinity."""
    return F.floor(x + F.lit(0.5))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def age_days(ts: Column, as_of: Column) -> Column:
    """Fractional days from ``ts`` to ``as_of``; null for a null date (callers decide)."""
    return (F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(86_400_000_000.0)


def older_than(ts: Column, as_of: Column, days: float) -> Column:
    """True when the date is known and older than ``days``."""
    return F.coalesce(age_days(ts, as_of) > F.lit(float(days)), F.lit(False))


def half_life(age: Column, days: float) -> Column:
    return F.pow(F.lit(0.5), age / F.lit(float(days)))


def lookup(key: Column, table: dict, default=None) -> Column:
    """Small literal table as a CASE expression (no join, no broadcast)."""
    expr = None
    for k, v in table.items():
        expr = F.when(key == F.lit(k), F.lit(v)) if expr is None else expr.when(key == F.lit(k), F.lit(v))
    return expr.otherwise(F.lit(default)) if default is not None else expr
