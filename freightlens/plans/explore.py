"""The exploratory table and the reports drawn from it.

:func:`explore_features` is the shared input; store it once (``persist`` or a
written table) and call any reports on it. Each report is a DataFrame.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightlens import constants as c
from freightlens.functions import clean, clip_upper, flag, log1p, ratio
from freightlens.operators.binning import bin_of, cut, probabilities, qcut
from freightlens.operators.lookup import attach, attach_aggregate, stored
from freightlens.operators.quantiles import quantile, quantile_edges, quantiles
from freightlens.operators.stats import flag_contrast, group_stats
from freightlens.plans.domain import Domain
from freightlens.plans.encoders import base_features
from freightlens.session import store

Y = c.TARGET


def explore_features(
    star: DataFrame, domain: Domain | None = None, volumes: bool = True
) -> DataFrame:
    """Base features plus the sizes of each row's route and seller."""
    df = base_features(star, domain or Domain())
    return with_volumes(df) if volumes else df


def with_volumes(df: DataFrame) -> DataFrame:
    """Rows per route and per seller on every row, and distance per route row."""
    df = attach_aggregate(df, ["state_pair"], F.count("order_id").alias("route_frequency"))
    df = attach_aggregate(df, ["seller_id"], F.count("order_id").alias("seller_order_volume"))
    return df.withColumn("distance_route_ratio", ratio("real_distance_km", "route_frequency"))


def decile_stats(df: DataFrame, x: str, bins: int = 10, clip: float | None = None) -> DataFrame:
    """Target statistics per quantile bin of ``x``; values may be held at an
    upper quantile first."""
    pairs = store(df.select(clean(x).alias("__v"), F.col(Y)))
    if clip is not None:
        pairs = pairs.withColumn("__v", clip_upper("__v", F.lit(
            quantile(pairs, "__v", clip, keep=False))))
    return group_stats(qcut(pairs, "__v", bins, keep=False), ["bin"], Y)


def weight_stats(df: DataFrame) -> DataFrame:
    """Target statistics per weight class."""
    return group_stats(df.withColumn("bin", cut("product_weight_g", c.WEIGHT_EDGES)), ["bin"], Y)


# Flags set by a quantile of a column, and the side they are on.
QUANTILE_FLAGS = {
    "rare_route_flag": ("route_frequency", 0.25, "below"),
    "high_volume_seller_flag": ("seller_order_volume", 0.75, "above"),
    "expensive_route_flag": ("freight_per_km", 0.75, "above"),
    "premium_product": ("price", 0.9, "above"),
}


def with_quantile_flags(
    df: DataFrame, flags: Mapping[str, tuple[str, float, str]] = QUANTILE_FLAGS,
    keep: bool = True,
) -> DataFrame:
    """Flags of the side of a quantile that a row is on. ``keep=False`` is for inputs
    cheap to read (see ``quantile_edges``)."""
    added = {}
    columns = {column for column, _, _ in flags.values()}
    narrow = df.select(*[clean(c).alias(c) for c in sorted(columns)])
    narrow = store(narrow) if keep else narrow
    # All columns are located at once, as groups of one long column.
    wanted = sorted({prob for _, prob, _ in flags.values()})
    edges = {r["column"]: r["edges"] for r in quantile_edges(
        narrow.unpivot([], sorted(columns), "column", "value"), "value", wanted, by=["column"],
        keep=False).collect()}
    absent = [None] * len(wanted)
    bounds = {name: edges.get(column, absent)[wanted.index(prob)]
              for name, (column, prob, _) in flags.items()}
    for name, (column, _, side) in flags.items():
        bound = F.lit(bounds[name])
        value = clean(column)
        added[name] = flag(value < bound if side == "below" else value > bound)
    return df.withColumns(added)


# Flags of the summary report and of the plain contrasts.
SUMMARY_FLAGS = ["heavy_item_flag", "rare_route_flag", "high_volume_seller_flag",
                 "remote_state_flag", "expensive_route_flag"]
PLAIN_FLAGS = ["heavy_item_flag", "remote_state_flag", "ultra_cheap_freight", "long_heavy",
               "short_heavy", "extreme_longhaul_flag", "holiday_pressure", "fast_season",
               "end_of_year", "seller_remote_flag", "same_region", "north_involved",
               "southeast_seller", "multi_item_order"]


def flag_summary(df: DataFrame) -> DataFrame:
    """Contrast of every flag, plain and by quantile."""
    columns = sorted({column for column, _, _ in QUANTILE_FLAGS.values()})
    # Stored once: the bounds and the contrast both read it.
    narrow = store(df.select(Y, *PLAIN_FLAGS, *columns))
    flagged = with_quantile_flags(narrow, keep=False)
    return flag_contrast(flagged, PLAIN_FLAGS + list(QUANTILE_FLAGS), Y)


def route_stats(df: DataFrame, rows: int = c.MIN_ROUTE_ROWS) -> DataFrame:
    """Target statistics of the routes that have enough rows."""
    return group_stats(df, ["state_pair"], Y, rows=rows)


def extreme_routes(df: DataFrame, most: bool, top: int = 10) -> DataFrame:
    """The most or least variable routes."""
    order = F.col("std").desc_nulls_last() if most else F.col("std").asc_nulls_last()
    return route_stats(df).orderBy(order, "state_pair").limit(top)


def with_route_variability(df: DataFrame, rows: int = c.MIN_ROUTE_ROWS) -> DataFrame:
    """Variability of each row's route; routes with too few rows get the mean of
    the others."""
    routes, _ = stored(route_stats(df, rows).select(
        "state_pair", F.col("std").alias("route_variability")))
    mean = F.lit(routes.agg(F.avg("route_variability")).first()[0])
    return attach(df, routes, ["state_pair"]).withColumn(
        "route_variability", F.coalesce("route_variability", mean))


def top_zip_areas(df: DataFrame, top: int = 20) -> DataFrame:
    stats = group_stats(df, ["customer_zip_prefix_bin"], Y)
    return stats.orderBy(F.desc("mean"), "customer_zip_prefix_bin").limit(top)


def residuals_by_bin(scored: DataFrame, x: str, bins: int = 10) -> DataFrame:
    edges = quantiles(scored, x, probabilities(bins))
    return group_stats(
        scored.withColumn("bin", bin_of(clean(x), edges)), ["bin"], "residual")


# Features that get a correlation with the target, by report name.
CORRELATED = {
    "real_distance_km": "real_distance_km",
    "log_distance": "log_distance",
    "product_weight_g": "product_weight_g",
    "freight_value": "freight_value",
    "log_freight": "log_freight",
    "seller_order_volume": "seller_order_volume",
    "product_density": "product_density",
    "product_volume": "product_volume",
    "distance_weight": "distance_weight",
    "volume_distance_interaction": "volume_distance_interaction",
    "distance_route_ratio": "distance_route_ratio",
    "price": "price",
    "log_price": "log_clv",
    "customer_zip_code_prefix": "customer_zip_code_prefix",
    "order_item_id": "order_item_id",
    "compactness_ratio": "compactness_ratio",
}


def clipped_pair(df: DataFrame, x: str, log: bool = False, prob: float = 0.99) -> DataFrame:
    """``x`` held at an upper quantile (and logged) with the target: the input of
    the two-dimensional counts and smooth curves."""
    # Stored before the filter, which would else be computed again inside the joins of df.
    values = store(df.select(clean(x).alias("x"), F.col(Y).alias("y"))).na.drop()
    held = clip_upper("x", F.lit(quantile(values, "x", prob, keep=False)))
    return values.select((log1p(held) if log else held).alias("x"), "y")
