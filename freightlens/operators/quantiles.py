"""Exact quantiles that no single task has to hold.

The built-in exact percentile keeps every distinct value of a group in one hash
map. Here, at every size, the wanted ranks are located by narrowing: a histogram over
fixed logarithmic cells, then one of equal width inside the few cells that hold a wanted rank, then
the values of the cells still holding several. Each step combines before the
shuffle and ships histogram rows only, and a value shared by any number of rows
is one entry. Steps two and three run only where needed; a column of few
different values is done after the first.

Like ``approxQuantile`` these functions run jobs when called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightlens.functions import clean
from freightlens.session import store

CELLS_PER_E_FOLD = 1024
SUB_CELLS = 65_536


def _log_cell(x: Column) -> Column:
    """Rises with x over the whole double range."""
    return F.floor(F.signum(x) * F.log1p(F.abs(x)) * F.lit(float(CELLS_PER_E_FOLD)))


def _sub_cell(x: Column, low: Column, high: Column) -> Column:
    # Halves keep the span finite when the bounds are near the double limits.
    share = (x / 2 - low / 2) / (high / 2 - low / 2)
    return F.least(F.floor(share * F.lit(float(SUB_CELLS))), F.lit(SUB_CELLS - 1))


def _histogram(rows: DataFrame, keys: list[str], cell: str) -> DataFrame:
    return rows.groupBy(*keys, cell).agg(
        F.sum("__w").alias("__w"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"),
    )


def _locate(hist: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """The cells that hold a rank of ``__picks``, ranks recounted from the start
    of the cell. The running sum is over the cells of one histogram."""
    before = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("__below")
    inside = F.filter("__picks", lambda p: (p["rank"] >= below) & (p["rank"] < below + F.col("__w")))
    moved = F.transform(inside, lambda p: F.struct(
        p["i"].alias("i"), p["upper"].alias("upper"), (p["rank"] - below).alias("rank")))
    return store(
        hist.withColumn("__below", F.coalesce(F.sum("__w").over(before), F.lit(0)))
        .withColumn("__picks", moved)
        .where(F.size("__picks") > 0)
        .drop("__below", "__w")
    )


def _wanted_ranks(total: Column, probs: Sequence[float]) -> Column:
    """For every probability the ranks (from 0) on both sides of its place."""
    ranks = []
    for i, p in enumerate(probs):
        place = F.floor((total - 1) * F.lit(float(p))).cast("bigint")
        for upper in (False, True):
            rank = F.least(place + 1, total - 1) if upper else place
            ranks.append(F.struct(
                F.lit(i).alias("i"), F.lit(upper).alias("upper"), rank.alias("rank")))
    return F.array(*ranks)


def _several(cells: DataFrame, keys: list[str]) -> DataFrame | None:
    """Located cells holding more than one value."""
    several = cells.where("__lo < __hi").select(*keys, "__lo", "__hi", "__picks")
    return None if several.isEmpty() else several


def _values(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.where("__lo = __hi").select(
        *keys, F.col("__lo").alias("__v"), F.explode("__picks").alias("__p"))


def quantile_edges(
    df: DataFrame,
    value: str | Column,
    probs: Sequence[float],
    by: Sequence[str] = (),
    weight: str | None = None,
    keep: bool = True,
) -> DataFrame:
    """Linearly interpolated quantiles of ``value`` as columns ``edges`` and
    ``rows``, one row per group of ``by``.

    NULL, NaN and infinite values and NULL groups are left out. ``weight`` names a
    column of whole row counts. The columns used are written to the checkpoint folder;
    ``keep=False`` reads the input once per step instead, for inputs cheap to read.
    """
    value = F.col(value) if isinstance(value, str) else value
    keys = list(by) or ["__all"]
    count = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    group = [F.col(key) for key in by] or [F.lit(0).alias("__all")]
    # Kept for the following steps; filters on computed values stay above it.
    kept = df.select(*group, clean(value).alias("__x"), count.alias("__w"))
    if keep:
        kept = store(kept)
    rows = kept.where("__w > 0").na.drop(subset=[*keys, "__x"])
    return _narrowed(rows.withColumn("__c", _log_cell(F.col("__x"))), keys, list(by), probs)


def _narrowed(rows: DataFrame, keys: list[str], by: list[str], probs: Sequence[float]) -> DataFrame:
    first = _locate(
        _histogram(rows, keys, "__c")
        .withColumn("__n", F.sum("__w").over(Window.partitionBy(*keys)))
        .withColumn("__picks", _wanted_ranks(F.col("__n"), probs)),
        keys, "__c")
    found = _values(first, keys)
    sub_keys = [*keys, "__c"]
    wide = _several(first, sub_keys)
    if wide is not None:
        inner = rows.join(wide.drop("__picks"), sub_keys).select(
            *sub_keys, "__x", "__w",
            _sub_cell(F.col("__x"), F.col("__lo"), F.col("__hi")).alias("__s"))
        picks = wide.drop("__lo", "__hi")
        second = _locate(
            _histogram(inner, sub_keys, "__s").join(picks, sub_keys), sub_keys, "__s")
        found = found.unionByName(_values(second, keys))
        value_keys = [*sub_keys, "__s"]
        narrow = _several(second, value_keys)
        if narrow is not None:
            last = inner.join(narrow.select(*value_keys), value_keys)
            third = _locate(
                _histogram(last, value_keys, "__x").join(
                    narrow.drop("__lo", "__hi"), value_keys),
                value_keys, "__x")
            found = found.unionByName(_values(third, keys))
    p = F.col("__p")
    sides = found.groupBy(*keys).agg(*[
        F.max(F.when((p["i"] == i) & (p["upper"] == F.lit(upper)), F.col("__v")))
        .alias(f"__{'hi' if upper else 'lo'}{i}")
        for i in range(len(probs)) for upper in (False, True)
    ])
    totals = first.select(*keys, "__n").distinct()
    edges = []
    for i, prob in enumerate(probs):
        place = (F.col("__n") - 1) * F.lit(float(prob))
        low, high = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        share = place - F.floor(place)
        # One value at both sides is the edge itself, not a rounded mean of it.
        edges.append(F.when(low == high, low).otherwise((1 - share) * low + share * high))
    return sides.join(totals, keys).select(
        *by, F.array(*edges).alias("edges"), F.col("__n").alias("rows"))


def quantiles(
    df: DataFrame, value: str | Column, probs: Sequence[float], weight: str | None = None,
    keep: bool = True,
) -> list[float | None]:
    """The quantiles of a whole column; NULLs if it has no values."""
    row = quantile_edges(df, value, probs, weight=weight, keep=keep).first()
    return list(row["edges"]) if row else [None] * len(probs)


def quantile(
    df: DataFrame, value: str | Column, prob: float, keep: bool = True
) -> float | None:
    return quantiles(df, value, [prob], keep=keep)[0]
