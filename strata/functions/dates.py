"""Date-part and cyclical expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Periods used for cyclical encodings.
CYCLE_PERIODS = {"month": 12, "day": 31, "dayofweek": 7, "dayofyear": 365, "hour": 24, "minute": 60}


def date_parts(c: Column, with_time: bool = True) -> list[tuple[str, Column]]:
    """(suffix, expression) pairs: year, quarter, month, ISO week, day,
    dayofweek (Monday = 0), dayofyear, [hour, minute], is_weekend (0 for null)."""
    ts = c.cast("timestamp")
    parts = [("year", F.year(ts)), ("quarter", F.quarter(ts)), ("month", F.month(ts)),
             ("week", F.weekofyear(ts)), ("day", F.dayofmonth(ts)),
             ("dayofweek", F.weekday(ts)), ("dayofyear", F.dayofyear(ts))]
    if with_time:
        parts += [("hour", F.hour(ts)), ("minute", F.minute(ts))]
    parts.append(("is_weekend", F.coalesce(F.weekday(ts) >= 5, F.lit(False)).cast("int")))
    return parts


def part(c: Column, name: str) -> Column:
    return dict(date_parts(c))[name]


def cyclical(value: Column, period: float) -> tuple[Column, Column]:
    """(sin, cos) of 2π·value/period; a null value encodes as 0."""
    angle = F.lit(2 * math.pi) * F.coalesce(value.cast("double"), F.lit(0.0)) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)
