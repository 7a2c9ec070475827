"""Null-aware arithmetic, flags and text helpers.

Absent values are NULL throughout, never NaN: Spark orders NaN above every
number and treats two NaNs as equal, which no flag or bin here wants.
"""

from __future__ import annotations

from functools import reduce
from operator import mul

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clean(value) -> Column:
    """NaN and infinities become NULL."""
    number = _col(value).cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), number)


def ratio(top, bottom) -> Column:
    """``top / bottom``, NULL for a zero divisor."""
    return _col(top).cast("double") / F.nullif(_col(bottom).cast("double"), F.lit(0.0))


def flag(condition: Column) -> Column:
    """1 where the condition holds; 0 where it fails or cannot be decided."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def one_of(value, choices) -> Column:
    return flag(_col(value).isin(list(choices)))


def fill(value, default) -> Column:
    return F.coalesce(_col(value), F.lit(default))


def log1p(value) -> Column:
    """``log(1 + x)``; NULL for ``x <= -1``, where it is undefined."""
    return F.log1p(_col(value).cast("double"))


def product(*names) -> Column:
    """Product of columns, NULL as soon as one factor is."""
    return reduce(mul, [_col(name).cast("double") for name in names])


def add(*columns) -> Column:
    return reduce(lambda a, b: a + b, [_col(c) for c in columns])


def floor_div(value, step: int) -> Column:
    """Integer division rounding down, for negative values too."""
    return F.floor(_col(value).cast("double") / F.lit(float(step))).cast("bigint")


def clip_upper(value, bound: Column) -> Column:
    """``min(value, bound)``; unlike ``least`` it keeps NULL values NULL."""
    number = _col(value)
    return F.when(number > bound, bound).otherwise(number)


def text_length(value) -> Column:
    return F.length(_col(value))
