"""Time, text and number helpers as column expressions.

Clock fields come from the epoch by arithmetic, so they mean UTC whatever the session time zone is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND_US = 1_000_000
MINUTE_US = 60 * SECOND_US
HOUR_US = 60 * MINUTE_US
DAY_US = 24 * HOUR_US


def epoch_us(ts: Column) -> Column:
    """Microseconds since the epoch."""
    return F.unix_micros(ts)


def _day_us(us: Column) -> Column:
    return F.pmod(us, F.lit(DAY_US))


def whole_hour(us: Column) -> Column:
    """Hour 0..23 of an epoch-microsecond column."""
    return F.floor(_day_us(us) / HOUR_US)


def hour_of_day(us: Column) -> Column:
    """Hour with minutes as fraction; seconds are ignored."""
    return F.floor(_day_us(us) / MINUTE_US) / 60.0


def day_number(us: Column) -> Column:
    """Days since the epoch."""
    return ((us - _day_us(us)) / DAY_US).cast("long")


def weekday(us: Column) -> Column:
    """Monday 0 .. Sunday 6 (the epoch fell on a Thursday)."""
    return F.pmod(day_number(us) + 3, F.lit(7))


def hour_angle(us: Column) -> Column:
    return hour_of_day(us) * (2 * math.pi) / 24.0


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text with a trailing Z."""
    return utc_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def utc_format(ts: Column, pattern: str) -> Column:
    """Text of a timestamp in UTC."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), pattern)


def device_key(os: Column, mac: Column) -> Column:
    return F.concat_ws("|", F.coalesce(os, F.lit("")), F.coalesce(mac, F.lit("")))


def finite_or_zero(value: Column) -> Column:
    """Null, NaN and the infinities become 0."""
    value = value.cast("double")
    usable = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(usable, value).otherwise(F.lit(0.0))


def shannon_bits(items: Column) -> Column:
    """Shannon entropy (base 2) of the values in an array; 0 for null or empty."""
    n = F.size(items)
    shares = F.transform(
        F.array_distinct(items), lambda v: F.size(F.filter(items, lambda w: w.eqNullSafe(v))) / n
    )
    bits = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(items.isNull() | (n <= 0), F.lit(0.0)).otherwise(bits)
