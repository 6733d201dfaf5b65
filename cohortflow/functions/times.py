"""Date arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plus(ts: Column, hours: int = 0, days: int = 0) -> Column:
    return ts + F.expr(f"INTERVAL '{hours + 24 * days}' HOUR")


def whole_hours(start: Column, end: Column) -> Column:
    """Complete hours from ``start`` to ``end``, truncated towards zero."""
    return F.timestamp_diff("HOUR", start, end)


def whole_minutes(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MINUTE", start, end)


def calendar_years(start_year: Column, ts: Column) -> Column:
    """Year boundaries crossed, not elapsed years: 31 December to 1 January counts one."""
    return F.year(ts) - start_year
