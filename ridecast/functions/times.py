"""Time expressions on zone-less timestamps.

`date_trunc` and `timestampdiff` go through the session zone, which shifts hours that
a zone skips in spring. The forms below use interval arithmetic, so the result does
not depend on the session zone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_weather_time(text: Column) -> Column:
    """`20110729 13:00` -> TIMESTAMP_NTZ; malformed text raises under ANSI."""
    return F.to_timestamp_ntz(text, F.lit("yyyyMMdd HH:mm"))


def parse_trip_time(text: Column) -> Column:
    """`7/28/2011 9:05:42` (padded or not) -> TIMESTAMP_NTZ with the seconds dropped."""
    return F.to_timestamp_ntz(F.substring_index(text, ":", 2), F.lit("M/d/yyyy H:m"))


def parse_trip_date(text: Column) -> Column:
    """The DATE part of the same text."""
    return F.to_date(F.substring_index(text, " ", 1), "M/d/yyyy")


def parse_iso_time(text: Column) -> Column:
    return F.to_timestamp_ntz(text)


def day_of(ts: Column) -> Column:
    return ts.cast("date")


def floor_to_minute(ts: Column) -> Column:
    return ts - F.make_dt_interval(secs=F.extract(F.lit("SECOND"), ts))


def floor_to_hour(ts: Column) -> Column:
    return ts - F.make_dt_interval(mins=F.minute(ts), secs=F.extract(F.lit("SECOND"), ts))


def weather_key(start: Column) -> Column:
    """The hour whose reading is known when a trip starts.

    A reading needs a minute to arrive, so 12:00 still uses the 11:00 row and 12:01
    the 12:00 row.
    """
    return floor_to_hour(start - F.make_dt_interval(mins=F.lit(1)))


def weekday(ts: Column) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(ts)


def month_of(ts: Column) -> Column:
    return F.month(ts)


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a value that repeats every `period`."""
    angle = F.lit(2 * math.pi) * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def seconds_between(start: Column, end: Column) -> Column:
    """`end - start` in seconds, with the fraction."""
    return (end - start).cast("interval second").cast("decimal(18,6)").cast("double")


def hours_between(start: Column, end: Column) -> Column:
    return seconds_between(start, end) / F.lit(3600.0)


def days_between(start: Column, end: Column) -> Column:
    return seconds_between(start, end) / F.lit(86400.0)
