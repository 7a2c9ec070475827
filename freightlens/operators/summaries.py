"""The reduced tables behind distribution charts, over all rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightlens.functions import clean
from freightlens.operators.lookup import attach
from freightlens.operators.quantiles import quantile_edges
from freightlens.operators.stats import group_stats, grouped


def _span(df: DataFrame, *columns: str):
    """Minimum and maximum of columns: one row of fixed width."""
    return df.agg(*[
        f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max)]).first()


def hexbin(df: DataFrame, x: str | Column, y: str | Column, gridsize: int) -> DataFrame:
    """Counts of points in a hexagonal grid: centre, count and log10 of it.

    A hexagon is the nearest of two interleaved rectangular lattices.
    """
    points = df.select(clean(x).alias("x"), clean(y).alias("y")).na.drop()
    span = _span(points, "x", "y")
    if span["min_x"] is None:
        return points.select("x", "y", F.lit(0).alias("count"), F.lit(0.0).alias("log10_count"))
    nx, ny = gridsize, int(gridsize / math.sqrt(3))
    pad_x = 1e-9 * (span["max_x"] - span["min_x"])
    pad_y = 1e-9 * (span["max_y"] - span["min_y"])
    x0, y0 = span["min_x"] - pad_x, span["min_y"] - pad_y
    sx = (span["max_x"] + pad_x - x0) / nx or 1.0
    sy = (span["max_y"] + pad_y - y0) / ny or 1.0
    u, v = F.col("u"), F.col("v")
    cells = points.select(
        ((F.col("x") - F.lit(x0)) / F.lit(sx)).alias("u"),
        ((F.col("y") - F.lit(y0)) / F.lit(sy)).alias("v"),
    ).select(
        F.rint(u).alias("u1"), F.rint(v).alias("v1"),
        (F.floor(u) + F.lit(0.5)).alias("u2"), (F.floor(v) + F.lit(0.5)).alias("v2"),
        "u", "v",
    )
    near = ((u - F.col("u1")) * (u - F.col("u1")) + 3 * (v - F.col("v1")) * (v - F.col("v1"))
            < (u - F.col("u2")) * (u - F.col("u2")) + 3 * (v - F.col("v2")) * (v - F.col("v2")))
    return (
        cells.select(
            F.when(near, F.col("u1")).otherwise(F.col("u2")).alias("u"),
            F.when(near, F.col("v1")).otherwise(F.col("v2")).alias("v"))
        .groupBy("u", "v").agg(F.count("*").alias("count"))
        .select(
            (F.col("u") * F.lit(sx) + F.lit(x0)).alias("x"),
            (F.col("v") * F.lit(sy) + F.lit(y0)).alias("y"),
            "count", F.log10("count").alias("log10_count"))
    )


def histogram(df: DataFrame, x: str | Column, bins: int) -> DataFrame:
    """Counts in ``bins`` equal-width bins, the last one closed. Empty bins are
    not listed."""
    values = df.select(clean(x).alias("x")).na.drop()
    span = _span(values, "x")
    low, high = span["min_x"] or 0.0, span["max_x"] or 0.0
    width = (high - low) / bins or 1.0
    index = F.least(F.floor((F.col("x") - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
    return (
        values.groupBy(index.cast("int").alias("bin")).agg(F.count("*").alias("count"))
        .select("bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("low"),
                (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("high"), "count")
    )


def box_stats(df: DataFrame, group: str, y: str) -> DataFrame:
    """Quartiles, whiskers within 1.5 interquartile ranges, and outlier counts."""
    edges = quantile_edges(df, y, [0.25, 0.5, 0.75], by=[group])
    quartiles = edges.select(
        group, *[F.get("edges", F.lit(i)).alias(q) for i, q in enumerate(("q1", "median", "q3"))])
    rows = attach(df.select(group, clean(y).alias("__y")), quartiles, [group])
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = (F.col("__y") >= F.col("q1") - reach) & (F.col("__y") <= F.col("q3") + reach)
    fenced = F.when(inside, F.col("__y"))
    return grouped(
        rows, [group],
        F.first("q1", True).alias("q1"), F.first("median", True).alias("median"),
        F.first("q3", True).alias("q3"),
        F.min(fenced).alias("low_whisker"), F.max(fenced).alias("high_whisker"),
        F.count(F.when(~inside, 1)).alias("outliers"), F.count("__y").alias("count"),
    ).where("count > 0")


def mean_band(df: DataFrame, key: str, y: str) -> DataFrame:
    """Mean per key with the band of one standard deviation around it."""
    return group_stats(df, [key], y).select(
        key, "mean", "std", (F.col("mean") - F.col("std")).alias("low"),
        (F.col("mean") + F.col("std")).alias("high"))
