"""Time buckets and durations. All inputs are TIMESTAMP_NTZ or UTC TIMESTAMP columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(value: Column) -> Column:
    """A UTC timestamp from text; null where it can't be read (a plain cast would fail the query)."""
    return F.try_to_timestamp(value)


def week_monday(t: Column) -> Column:
    """The Monday on or before `t`, at midnight, without a zone."""
    return F.date_trunc("week", t).cast("timestamp_ntz")


def week_tuesday(t: Column) -> Column:
    """The Tuesday on or before `t`: weeks that end on Monday."""
    day = F.expr("INTERVAL 1 DAY")
    return (F.date_trunc("week", t - day) + day).cast("timestamp_ntz")


def week_utc(t: Column) -> Column:
    """Monday 00:00 UTC of the ISO week as a timestamp with a zone."""
    return F.date_trunc("week", t).cast("timestamp")


def month(t: Column) -> Column:
    """The first of the month at midnight, without a zone."""
    return F.date_trunc("month", t).cast("timestamp_ntz")


BUCKETS = {"monday": week_monday, "tuesday": week_tuesday, "iso_utc": week_utc, "month": month}

_UNIT = {"hours": 3.6e9, "minutes": 6e7, "days": 8.64e10}


def elapsed(start: Column, end: Column, unit: str) -> Column:
    """Fractional, signed time from `start` to `end` in hours, minutes or days."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(_UNIT[unit])
