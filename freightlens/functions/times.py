"""Calendar parts and differences of naive timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from freightlens.functions.scalars import _col

MICROS_PER_HOUR = 3_600_000_000
MICROS_PER_DAY = 24 * MICROS_PER_HOUR


def _micros(later, earlier) -> Column:
    return F.timestamp_diff("MICROSECOND", _col(earlier), _col(later))


def days_between(later, earlier) -> Column:
    """Whole days, rounded down: one hour early is -1."""
    return F.floor(_micros(later, earlier) / F.lit(float(MICROS_PER_DAY))).cast("bigint")


def hours_between(later, earlier) -> Column:
    return _micros(later, earlier) / F.lit(float(MICROS_PER_HOUR))


def weekday(ts) -> Column:
    """0 is Monday."""
    return F.weekday(_col(ts))


def iso_week(ts) -> Column:
    return F.weekofyear(_col(ts))


def days_left_in_month(ts) -> Column:
    return F.day(F.last_day(_col(ts))) - F.day(_col(ts))
