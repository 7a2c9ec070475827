"""Candidate features and the report that keeps or drops them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightlens import constants as c
from freightlens.functions import clean, days_between, fill, log1p, ratio
from freightlens.operators.binning import above, cut_width, distinct_edges, probabilities
from freightlens.operators.lookup import attach, attach_aggregate, stored
from freightlens.operators.quantiles import quantile_edges
from freightlens.operators.ranks import code_of, value_codes
from freightlens.operators.stats import corr_table, grouped
from freightlens.plans.domain import Domain
from freightlens.plans.encoders import base_features
from freightlens.plans.features import DIMENSIONS, order_features, with_order_totals
from freightlens.plans.star import store_columns
from freightlens.session import store

# Names of the screened features.
SCREENED = [
    "category_x_customer_region", "category_x_purchase_month", "category_x_seller_region",
    "customer_in_capital_city", "customer_zip_prefix_x_seller_state_cat",
    "days_since_platform_launch", "days_until_end_of_month", "installment_coverage_ratio",
    "is_neighboring_state", "is_oversized", "is_same_city", "is_single_payment",
    "items_per_seller", "log_days_since_launch", "log_order_total_price_x_installments",
    "log_order_total_volume", "log_payment_value_x_installments", "log_surface_area",
    "order_max_dimension", "order_price_x_unique_sellers", "order_total_price_x_installments",
    "order_total_volume", "payment_value_per_item", "payment_value_x_installments",
    "product_length_to_height_ratio", "product_max_to_min_dimension_ratio",
    "product_surface_area", "product_weight_to_volume_ratio", "purchase_hour_bucket",
    "purchase_quarter_x_dayofweek", "purchase_week_of_year", "seller_avg_approval_hour",
    "seller_customer_state_pair_frequency", "seller_in_capital_city", "seller_night_order_ratio",
    "seller_to_customer_direction", "seller_weekend_order_ratio", "seller_zip_prefix_bin",
    "seller_zip_to_customer_zip_ratio",
]
QUINTILES = 5
PRICE_BINS = 5


def seller_habits(df: DataFrame) -> DataFrame:
    """Per seller: shares of weekend and night orders, mean approval hour, first
    sale and mean review."""
    def share(condition):
        return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))

    return grouped(
        df, ["seller_id"],
        share(F.col("purchase_dayofweek") >= 5).alias("seller_weekend_order_ratio"),
        share(F.col("purchase_hour").between(0, 7)).alias("seller_night_order_ratio"),
        F.avg(F.hour("order_approved_at")).alias("seller_avg_approval_hour"),
        F.min("order_purchase_timestamp").alias("seller_first_sale"),
        F.avg("review_score").alias("seller_avg_review"),
    )


# Columns of the star with order totals that the screened features are made of.
READ_COLUMNS = [
    "order_id", "seller_id", "order_purchase_timestamp", "order_approved_at", "review_score",
    "customer_zip_code_prefix", "seller_zip_code_prefix", "customer_city", "seller_city",
    "customer_state", "seller_state", "customer_lat", "customer_lng", "seller_lat", "seller_lng",
    "product_category_name", "price", "payment_installments", "payment_value",
    *DIMENSIONS, "product_weight_g", "items_per_order", "unique_sellers_per_order",
    "order_total_price", "total_volume", "order_max_dimension",
]


def screening_features(
    star: DataFrame, domain: Domain | None = None, carry: Sequence[str] | None = None
) -> DataFrame:
    """Star rows with all candidate features; group figures are of these rows. The star
    is stored, since every group figure and the result read it. ``carry`` names columns
    of the star that the caller reads beside the screened features: no others are stored
    then."""
    star = with_order_totals(star)
    rows = store(star) if carry is None else store_columns(
        star, list(dict.fromkeys([*READ_COLUMNS, *carry])))
    df = base_features(rows, domain or Domain())
    habits, sellers = stored(seller_habits(df))
    df = attach(df, habits, ["seller_id"], sellers)
    df = attach_aggregate(
        df, ["seller_state", "customer_state"],
        F.count("*").alias("seller_customer_state_pair_frequency"))
    for side in ("seller_state", "customer_state"):
        codes, _ = stored(value_codes(df, side, f"{side}_cat"))
        df = code_of(df, codes, side, f"{side}_cat")
    df = order_features(cut_width(df, "price", PRICE_BINS, "price_bin"))
    complexity = F.col("category_complexity")
    age = days_between("order_purchase_timestamp", "seller_first_sale")
    return df.withColumns({
        "seller_weekend_order_ratio": fill("seller_weekend_order_ratio", 0.0),
        "seller_night_order_ratio": fill("seller_night_order_ratio", 0.0),
        "seller_avg_approval_hour": fill("seller_avg_approval_hour", 12.0),
        "seller_avg_review": fill("seller_avg_review", 3.0),
        "seller_age_days": age,
        "log_seller_age": log1p(age),
        "installment_coverage_ratio": ratio("payment_installments", "price_bin"),
        "customer_zip_prefix_x_seller_state_cat": F.col("customer_zip_prefix_bin") * F.col(
            "seller_state_cat"),
        "category_x_purchase_month": complexity * F.col("purchase_month"),
        "category_x_seller_region": complexity * F.col("seller_state_cat"),
        "category_x_customer_region": complexity * F.col("customer_state_cat"),
    })


def _binned(long: DataFrame, edges: Mapping[str, Sequence[float]], bins: int) -> DataFrame:
    """The long rows with their quantile bin. The edges are a small table, not literals:
    those of all features would make one method that the JVM does not compile. Features
    with fewer than two different edges have no bin."""
    names = [f"__e{i}" for i in range(bins + 1)]
    rows = []
    for feature, found in edges.items():
        bounds = distinct_edges(found)
        if len(bounds) > 1:
            rows.append((feature, *bounds, *[None] * (len(names) - len(bounds))))
    schema = ", ".join(["feature string", *[f"{name} double" for name in names]])
    table = long.sparkSession.createDataFrame(rows, schema)
    index = F.greatest(F.lit(1), above(F.col("value"), [F.col(name) for name in names]))
    return long.join(F.broadcast(table), "feature").withColumn("bin", index)


def screening_report(
    df: DataFrame, features: Sequence[str] = SCREENED, y: str = c.TARGET, bins: int = QUINTILES
) -> tuple[DataFrame, DataFrame]:
    """Verdict per feature, and its bin statistics.

    The feature columns are stored once. Correlations take one pass for all of
    them; quantiles and bin statistics take the features as rows, produced while
    reading and summed before the shuffle.
    """
    features = list(features)
    wide = store(df.select(
        F.col(y).cast("double").alias("__y"), *[clean(f).alias(f) for f in features],
    )).where("__y is not null")
    long = wide.unpivot(["__y"], features, "feature", "value").where("value is not null")
    correlations, _ = stored(corr_table(wide, features, "__y"))
    edges = {
        row["feature"]: row["edges"]  # one row per feature
        for row in quantile_edges(
            long, "value", probabilities(bins), by=["feature"], keep=False).collect()
    }
    stats, _ = stored(grouped(
        _binned(long, edges, bins), ["feature", "bin"],
        F.avg("__y").alias("mean"), F.stddev_samp("__y").alias("std"),
        F.count("__y").alias("count")))

    spreads = stats.groupBy("feature").agg((F.max("mean") - F.min("mean")).alias("spread"))
    few = F.col("rows") < c.MIN_SCREENING_ROWS
    strong = F.abs("r") > c.MIN_ABS_R
    report = correlations.join(spreads, "feature", "left").withColumn(
        "spread", F.when(few, F.lit(0.0)).otherwise(F.col("spread")))
    report = report.select(
        "feature", "r", "rows", "spread",
        F.when(strong, "YES").otherwise("WEAK").alias("keep"),
        F.when(strong & (F.col("spread") > c.MIN_SPREAD_DAYS), "YES").otherwise("NO").alias("add"),
    )
    shown = correlations.where((F.abs("r") >= c.MIN_ABS_R) & ~few).select("feature", "r")
    return report, stats.join(shown, "feature")


def by_strength(report: DataFrame) -> DataFrame:
    """The strongest features first."""
    return report.orderBy(F.abs("r").desc_nulls_last(), "feature")


__all__ = ["SCREENED", "by_strength", "screening_features", "screening_report"]
