"""Grouped and whole-table statistics. All of them combine before the shuffle,
so a group holding a large share of the rows costs no more than another."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightlens.functions import clean
from freightlens.operators.quantiles import quantiles


def grouped(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Aggregates per key; keys that are NULL form no group. The test for NULL is made on the groups: below
    the aggregate it would evaluate a computed key a second time for every row."""
    keys = list(keys)
    known = reduce(lambda a, b: a & b, [F.col(key).isNotNull() for key in keys])
    return (
        df.groupBy(*keys).agg(*aggregates, F.count("*").alias("__rows"))
        .where(F.when(known, F.col("__rows")) > 0)
        .drop("__rows")
    )


def group_stats(df: DataFrame, keys: Sequence[str], y: str, rows: int = 1) -> DataFrame:
    """Mean, sample standard deviation and count of ``y`` per key."""
    stats = grouped(df, keys, F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"),
                    F.count(y).alias("count"))
    return stats.where(F.col("count") >= rows) if rows > 1 else stats


def group_means(df: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    return grouped(df, keys, F.avg(y).alias("mean"))


def flag_contrast(df: DataFrame, flags: Sequence[str], y: str) -> DataFrame:
    """Mean of ``y`` with a flag set and not set, their difference and the number
    of rows that set it: all flags in one pass."""
    long = df.select(F.col(y).alias("__y"), *flags).unpivot(
        ["__y"], list(flags), "flag", "__set")
    on, off = F.col("__set") == 1, F.col("__set") == 0
    contrast = long.groupBy("flag").agg(
        F.avg(F.when(on, F.col("__y"))).alias("mean_on"),
        F.avg(F.when(off, F.col("__y"))).alias("mean_off"),
        F.sum(F.when(on, 1).otherwise(0)).alias("rows_on"),
    )
    return contrast.withColumn("difference", F.col("mean_on") - F.col("mean_off"))


def pearson(x: Column, y: Column) -> Column:
    """Pearson r over the rows where both sides are known; NULL when either side
    is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def corr_table(df: DataFrame, features: Mapping[str, Column] | Sequence[str], y: str) -> DataFrame:
    """Pearson r of every feature with ``y``: one pass, one row per feature. The
    features become rows while reading and are summed before the shuffle, which
    keeps the generated code small however many there are."""
    if not isinstance(features, Mapping):
        features = {name: F.col(name) for name in features}
    wide = df.select(
        clean(y).alias("__y"), *[clean(column).alias(name) for name, column in features.items()])
    long = wide.unpivot(["__y"], list(features), "feature", "__x")
    x, target = F.col("__x"), F.col("__y")
    return long.groupBy("feature").agg(
        pearson(x, target).alias("r"),
        F.count(F.when(x.isNotNull() & target.isNotNull(), 1)).alias("rows"))


def t_statistic(r: Column, n: Column) -> Column:
    """Test statistic of a correlation with n - 2 degrees of freedom."""
    return r * F.sqrt((n - 2) / F.nullif(1 - r * r, F.lit(0.0)))


def pearson_test(df: DataFrame, x: str, y: str) -> DataFrame:
    """r, rows, t statistic and two-sided p-value of one pair of columns."""
    both = df.select(clean(x).alias("x"), clean(y).alias("y")).na.drop()
    stats = both.agg(pearson(F.col("x"), F.col("y")).alias("r"), F.count("*").alias("rows"))
    return with_p_value(stats.withColumn("t", t_statistic(F.col("r"), F.col("rows"))))


def with_p_value(stats: DataFrame) -> DataFrame:
    """Add the two-sided p-value of ``t`` with ``rows - 2`` degrees of freedom ``v``:
    the regularised incomplete beta function at ``v / (v + t*t)`` for ``v/2, 1/2``.
    NULL below one degree of freedom or without a ``t``. More than ``MOST_FREEDOM``
    degrees count as so many: the normal distribution is as near."""
    freedom = F.least(F.col("rows").cast("double") - 2, F.lit(MOST_FREEDOM))
    shape = F.when(freedom >= 1, freedom / 2)
    square = F.col("t") * F.col("t")
    share = _beta_share(square / (freedom + square), freedom / (freedom + square), shape)
    return stats.withColumn("p", F.when(shape.isNotNull() & square.isNotNull(), share))


MOST_FREEDOM = 1e9


def _log_gamma_step(a: Column) -> Column:
    """log(gamma(a + 1/2) / gamma(a)): Stirling's series behind 20 steps of the
    recurrence, so that nothing large is subtracted."""
    far = a + 20
    series = lambda x: (1 / (12 * x) - 1 / (360 * x * x * x)
                        + 1 / (1260 * x * x * x * x * x))
    up = far + 0.5
    at_far = far * F.log1p(F.lit(0.5) / far) - 0.5 + 0.5 * F.log(far) + series(up) - series(far)
    down = F.aggregate(F.sequence(F.lit(0), F.lit(19)), F.lit(0.0),
                       lambda total, k: total + F.log1p(F.lit(0.5) / (a + k)))
    return at_far - down


def _beta_share(other: Column, x: Column, a: Column) -> Column:
    """The regularised incomplete beta function of ``a`` and 1/2 at ``x = 1 - other``.
    The continued fraction is taken where it settles fast, by Lentz's method, and its
    mirror image elsewhere."""
    b = F.lit(0.5)
    log_scale = _log_gamma_step(a) - F.log(F.lit(math.pi)) / 2
    height = F.exp(log_scale + a * F.log(x) + b * F.log(other))
    direct = x < (a + 1) / (a + b + 2)
    first = height / a * _beta_fraction(a, b, x)
    mirrored = 1 - height / b * _beta_fraction(b, a, other)
    return F.when(other == 0, F.lit(1.0)).when(x == 0, F.lit(0.0)).when(
        direct, first).otherwise(mirrored)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    # It settles after some square roots of the larger parameter.
    terms = (200 + 8 * F.sqrt(F.greatest(a, b))).cast("int")
    tiny = F.lit(1e-300)
    held = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
    start = 1 / held(1 - (a + b) * x / (a + 1))
    zero = F.struct(F.lit(1.0).alias("c"), start.alias("d"), start.alias("h"))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / held(1 + even * s["d"])
        c = held(1 + even / s["c"])
        h = s["h"] * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        last = 1 / held(1 + odd * d)
        after = held(1 + odd / c)
        return F.struct(after.alias("c"), last.alias("d"), (h * last * after).alias("h"))

    return F.aggregate(F.sequence(F.lit(1), terms), zero, step, lambda s: s["h"])


def spread(bin_means: DataFrame, by: Sequence[str] = (), mean: str = "mean") -> DataFrame:
    """Largest minus smallest bin mean."""
    return bin_means.groupBy(*by).agg((F.max(mean) - F.min(mean)).alias("spread"))


def pivot_mean(df: DataFrame, row: str, column: str, values: Sequence, y: str) -> DataFrame:
    """Means of ``y`` as a matrix. The column values are given, so the shape is
    fixed and no job has to find them."""
    cells = [F.when(F.col(column) == F.lit(v), F.col(y)) for v in values]
    return grouped(df, [row], *[F.avg(c).alias(str(v)) for c, v in zip(cells, values)])


def describe(df: DataFrame, y: str) -> DataFrame:
    """Count, mean, sample std, minimum, exact quartiles and maximum."""
    x = clean(y)
    q25, q50, q75 = quantiles(df, y, [0.25, 0.5, 0.75])
    return df.agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"), F.lit(q25).alias("q25"), F.lit(q50).alias("q50"),
        F.lit(q75).alias("q75"), F.max(x).alias("max"),
    )


def rmse(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    gap = F.col(actual).cast("double") - F.col(predicted)
    return df.agg(F.sqrt(F.avg(gap * gap)).alias("rmse"), F.count(gap).alias("rows"))


def residual_summary(df: DataFrame, residual: str) -> DataFrame:
    """Mean and population standard deviation of the residuals."""
    return df.agg(
        F.avg(residual).alias("mean"), F.stddev_pop(residual).alias("std"),
        F.count(residual).alias("rows"),
    )
