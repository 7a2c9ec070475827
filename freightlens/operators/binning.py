"""Right-closed bins: by quantiles, by given edges, and of equal width."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightlens.functions import clean
from freightlens.operators.quantiles import quantiles


def above(x: Column, bounds: Sequence[Column]) -> Column:
    """How many bounds lie strictly below x; absent bounds count as none."""
    total = F.lit(0)
    for bound in bounds:
        total = total + F.when(x > bound, 1).otherwise(0)
    return total


def probabilities(bins: int) -> list[float]:
    return [i / bins for i in range(bins + 1)]


def distinct_edges(edges: Sequence[float | None]) -> list[float]:
    """Ascending edges without repeats: equal quantiles merge into one edge."""
    return sorted({e for e in edges if e is not None})


def bin_of(x: Column, edges: Sequence[float | None]) -> Column:
    """Bin number from 1 between ascending edges, the lowest edge included. Fewer
    than two different edges make no bin."""
    bounds = distinct_edges(edges)
    if len(bounds) < 2:
        return F.lit(None).cast("int")
    index = F.greatest(F.lit(1), above(x, [F.lit(e) for e in bounds]))
    return F.when(x.isNotNull(), index)


def qcut(
    df: DataFrame, value: str | Column, bins: int, name: str = "bin", keep: bool = True
) -> DataFrame:
    """Add the quantile bin of ``value`` (1 .. ``bins``). ``keep=False`` is for inputs
    cheap to read (see ``quantile_edges``)."""
    column = F.col(value) if isinstance(value, str) else value
    edges = quantiles(df, column, probabilities(bins), keep=keep)
    return df.withColumn(name, bin_of(clean(column), edges))


def cut(value: str | Column, edges: Sequence[float], labels: Sequence | None = None) -> Column:
    """Bin by given edges; a value at or below the first edge has no bin. Labels
    default to 0, 1, ..."""
    x = F.col(value) if isinstance(value, str) else value
    bounds = [F.lit(float(e)) for e in edges]
    index = above(x, bounds) - 1
    inside = (x > bounds[0]) & (x <= bounds[-1])
    if labels is None:
        return F.when(inside, index)
    return F.when(inside, F.get(F.array(*[F.lit(v) for v in labels]), index))


def cut_width(df: DataFrame, value: str, bins: int, name: str = "bin") -> DataFrame:
    """Add the equal-width bin of ``value`` between its minimum and maximum."""
    x = clean(value)
    span = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias("s")).scalar()
    low, high = F.col("__span.lo"), F.col("__span.hi")
    step = (high - low) / bins
    index = F.greatest(F.lit(1), above(x, [low + F.lit(float(j)) * step for j in range(bins)]))
    middle = F.lit((bins + 1) // 2)
    return (
        df.withColumn("__span", span)
        .withColumn(name, F.when(x.isNotNull(), F.when(low == high, middle).otherwise(index)))
        .drop("__span")
    )
