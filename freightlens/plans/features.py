"""Feature catalogue, one builder per theme.

A builder is a function from DataFrame to DataFrame that adds columns by plain
expressions. Group aggregates come in through :mod:`freightlens.operators.lookup`
or the fitted encoder, never as windows over the fact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightlens import constants as c
from freightlens.functions import (
    add, days_between, days_left_in_month, direction_code, fill, flag, floor_div, haversine_km,
    hours_between, iso_week, log1p, one_of, product, ratio, weekday,
)
from freightlens.operators.binning import cut
from freightlens.operators.lookup import literal_map, pair_map
from freightlens.plans.domain import Domain

DIMENSIONS = ("product_length_cm", "product_height_cm", "product_width_cm")


def geo_features(df: DataFrame, domain: Domain) -> DataFrame:
    """Distances, zip areas, states and regions of the two ends of a delivery."""
    seller, customer = ("seller_lat", "seller_lng"), ("customer_lat", "customer_lng")
    hub_lat, hub_lng = (F.lit(float(v)) for v in domain.hub_point)
    df = df.withColumns({
        "real_distance_km": haversine_km(*seller, *customer),
        "seller_hub_distance": haversine_km(*seller, hub_lat, hub_lng),
        "seller_customer_lat_diff": F.abs(F.col("customer_lat") - F.col("seller_lat")),
        "seller_customer_lng_diff": F.abs(F.col("customer_lng") - F.col("seller_lng")),
        "seller_to_customer_direction": direction_code(*seller, *customer),
        "zip_distance": F.abs(
            F.col("customer_zip_code_prefix") - F.col("seller_zip_code_prefix")),
        "customer_zip_prefix_bin": floor_div("customer_zip_code_prefix", 10_000),
        "seller_zip_prefix_bin": floor_div("seller_zip_code_prefix", 10_000),
        "seller_zip_to_customer_zip_ratio": ratio(
            "seller_zip_code_prefix", "customer_zip_code_prefix"),
        "same_state": flag(F.col("seller_state") == F.col("customer_state")),
        "state_pair": F.concat("seller_state", F.lit("_"), "customer_state"),
        "seller_region": literal_map("seller_state", domain.region_of_state),
        "customer_region": literal_map("customer_state", domain.region_of_state),
        "seller_remote_flag": one_of("seller_state", domain.remote_seller_states),
        "seller_in_capital_city": one_of(F.lower("seller_city"), domain.capital_cities),
        "customer_in_capital_city": one_of(F.lower("customer_city"), domain.capital_cities),
        "is_same_city": flag(F.lower("seller_city") == F.lower("customer_city")),
        "is_neighboring_state": flag(
            pair_map("seller_state", "customer_state", domain.neighbours_of_state)),
    })
    remote_seller = F.col("seller_region") == domain.remote_region
    remote_customer = F.col("customer_region") == domain.remote_region
    return df.withColumns({
        "log_distance": log1p("real_distance_km"),
        "same_region": flag(F.col("seller_region") == F.col("customer_region")),
        "north_involved": F.greatest(flag(remote_seller), flag(remote_customer)),
        "remote_state_flag": flag(remote_customer),
        "southeast_seller": flag(F.col("seller_region") == domain.core_region),
        "extreme_longhaul_flag": flag(F.col("real_distance_km") > c.LONGHAUL_KM),
    })


def product_features(df: DataFrame, domain: Domain) -> DataFrame:
    """Size, weight, freight and price of the item; needs the distances."""
    length, height, width = (F.col(d) for d in DIMENSIONS)
    df = df.withColumns({
        "product_volume": length * height * width,
        "max_dimension_cm": F.greatest(*DIMENSIONS),
        "product_surface_area": 2 * (length * height + length * width + height * width),
        "category_complexity": fill(
            literal_map("product_category_name", domain.complexity_of_category),
            domain.default_complexity),
    })
    km, grams = F.col("real_distance_km"), F.col("product_weight_g")
    return df.withColumns({
        "product_density": ratio("product_weight_g", "product_volume"),
        "product_weight_to_volume_ratio": ratio("product_weight_g", "product_volume"),
        "product_length_to_height_ratio": ratio("product_length_cm", "product_height_cm"),
        "product_max_to_min_dimension_ratio": ratio("max_dimension_cm", F.least(*DIMENSIONS)),
        "compactness_ratio": ratio("product_weight_g", F.cbrt("product_volume")),
        "is_oversized": flag(F.col("max_dimension_cm") > c.OVERSIZED_CM),
        "heavy_item_flag": flag(grams > c.HEAVY_GRAMS),
        "long_heavy": flag((km > c.LONG_HEAVY["km"]) & (grams > c.LONG_HEAVY["grams"])),
        "short_heavy": flag((km < c.SHORT_HEAVY["km"]) & (grams > c.SHORT_HEAVY["grams"])),
        "local_heavy": flag((F.col("same_state") == 1) & (grams > c.HEAVY_GRAMS)),
        "log_weight": log1p("product_weight_g"),
        "log_total_weight": log1p("product_weight_g"),
        "log_volume": log1p("product_volume"),
        "log_surface_area": log1p("product_surface_area"),
        "distance_weight": product("real_distance_km", "product_weight_g"),
        "volume_distance_interaction": product("product_volume", "real_distance_km"),
        "freight_ratio": ratio("freight_value", "price"),
        "freight_per_km": ratio("freight_value", "real_distance_km"),
        "freight_per_weight": ratio("freight_value", "product_weight_g"),
        "price_per_km": ratio("price", "real_distance_km"),
        "log_freight": log1p("freight_value"),
        "log_clv": log1p("price"),
        "freight_tier": cut("freight_value", c.FREIGHT_TIER_EDGES),
        "ultra_cheap_freight": flag(F.col("freight_value") < c.CHEAP_FREIGHT),
        "multi_item_order": flag(F.col("order_item_id") > 1),
    })


def time_features(df: DataFrame, domain: Domain) -> DataFrame:
    """Calendar parts of the purchase and the waits around it."""
    bought = "order_purchase_timestamp"
    launch = F.lit(domain.platform_launch).cast("timestamp_ntz")
    df = df.withColumns({
        "purchase_month": F.month(bought),
        "purchase_dayofweek": weekday(bought),
        "purchase_hour": F.hour(bought),
        "purchase_week_of_year": iso_week(bought),
        "quarter": F.quarter(bought),
        "purchase_date": F.to_date(bought),
        "days_until_end_of_month": days_left_in_month(bought),
        "days_since_platform_launch": days_between(bought, launch),
        "shipping_limit_days": days_between("shipping_limit_date", bought),
        "seller_processing_window": hours_between("shipping_limit_date", "order_approved_at"),
        "payment_approval_delay": hours_between("order_approved_at", bought),
    })
    return df.withColumns({
        "purchase_quarter_x_dayofweek": F.col("quarter") * F.col("purchase_dayofweek"),
        "purchase_hour_bucket": cut("purchase_hour", c.HOUR_BUCKET_EDGES),
        "holiday_pressure": one_of("purchase_month", c.HOLIDAY_MONTHS),
        "fast_season": one_of("purchase_month", c.FAST_MONTHS),
        "end_of_year": one_of("purchase_month", c.YEAR_END_MONTHS),
        "log_days_since_launch": log1p("days_since_platform_launch"),
        "log_approval_delay": log1p("payment_approval_delay"),
    })


def holiday_features(df: DataFrame) -> DataFrame:
    """For tables that bring the days to the next holiday."""
    return df.withColumns({
        "pre_holiday_flag": flag(F.col("days_to_holiday") <= 7),
        "holiday_window": cut("days_to_holiday", c.HOLIDAY_WINDOW_EDGES),
    })


def order_totals(df: DataFrame) -> DataFrame:
    """What an order contains, one row per order; needs the item volumes."""
    return df.where("order_id is not null").groupBy("order_id").agg(
        F.count("order_item_id").alias("items_per_order"),
        # Sets of one order are small, and need no copy of the rows for each of them.
        F.size(F.collect_set("seller_id")).cast("long").alias("unique_sellers_per_order"),
        F.size(F.collect_set("product_category_name")).cast("long").alias("order_item_diversity"),
        F.coalesce(F.sum("product_weight_g"), F.lit(0.0)).alias("total_weight"),
        F.coalesce(F.sum("product_volume"), F.lit(0.0)).alias("total_volume"),
        F.coalesce(F.sum("price"), F.lit(0.0)).alias("order_total_price"),
        F.max("product_length_cm").alias("order_max_dimension"),
        F.max("price").alias("max_item_price"),
    )


def with_order_totals(star: DataFrame) -> DataFrame:
    """Star rows with the totals of their order. Right behind the star's own join, rows
    and totals are partitioned by the order key already, and nothing is moved again."""
    length, height, width = (F.col(d) for d in DIMENSIONS)
    totals = order_totals(star.withColumn("product_volume", length * height * width))
    return star.join(totals, "order_id", "left")


def order_features(df: DataFrame) -> DataFrame:
    """Order totals, unless they are there, and payment figures on every item. Both sides
    of the join are partitioned by the order key."""
    if "items_per_order" not in df.columns:
        df = df.join(order_totals(df), "order_id", "left")
    return df.withColumns({
        "order_unique_sellers": F.col("unique_sellers_per_order"),
        "order_item_count": F.col("items_per_order"),
        "order_total_volume": F.col("total_volume"),
        "log_total_order_weight": log1p("total_weight"),
        "log_order_total_volume": log1p("total_volume"),
        "items_per_seller": ratio("items_per_order", "unique_sellers_per_order"),
        "order_diversity_x_sellers": F.col("order_item_diversity") * F.col(
            "unique_sellers_per_order"),
        "order_price_x_unique_sellers": product("order_total_price", "unique_sellers_per_order"),
        "order_total_price_x_installments": product("order_total_price", "payment_installments"),
        "payment_value_per_item": ratio("payment_value", "items_per_order"),
        "payment_value_vs_order_value": ratio("payment_value", "order_total_price"),
        "payment_value_x_installments": product("payment_value", "payment_installments"),
        "avg_installment_value": ratio("payment_value", "payment_installments"),
        "is_single_payment": flag(F.col("payment_installments") == 1),
        "log_installments": log1p("payment_installments"),
        "weekend_purchase_x_installments": flag(F.col("purchase_dayofweek") >= 5) * F.col(
            "payment_installments"),
        "payment_sequential_x_complexity": product("payment_sequential", "category_complexity"),
        "log_review_comment": log1p(fill("review_comment_length", 0.0)),
    }).withColumns({
        "log_payment_value_x_installments": log1p("payment_value_x_installments"),
        "log_order_total_price_x_installments": log1p("order_total_price_x_installments"),
    })


# Interaction features and the columns they multiply. Those of the
# second table build on the first.
FIRST_PRODUCTS = {
    "clv_x_complexity": ("log_clv", "category_complexity"),
    "complex_heavy_order": ("category_complexity", "log_total_order_weight"),
    "freight_burden": ("freight_ratio", "log_total_order_weight"),
    "high_complexity_installment": ("category_complexity", "payment_installments"),
    "installment_approval_lag": ("payment_installments", "log_approval_delay"),
    "shipping_window_x_complexity": ("shipping_limit_days", "category_complexity"),
    "weight_x_sellers": ("log_total_order_weight", "unique_sellers_per_order"),
}
SECOND_PRODUCTS = {
    "city_density_x_clv": ("log_city_density", "log_clv"),
    "city_density_x_operational_stress": ("log_city_density", "operational_stress"),
    "city_density_x_seller_age": ("log_city_density", "log_seller_age"),
    "city_density_x_weight_sellers": ("log_city_density", "weight_x_sellers"),
    "high_installment_x_shipping_window": ("high_complexity_installment", "shipping_limit_days"),
    "load_x_shipping_window": ("log_rolling_7d", "shipping_limit_days"),
    "payment_complexity_x_processing": (
        "payment_value_vs_order_value", "seller_processing_window"),
    "pressure_x_operational_stress": ("daily_order_count", "operational_stress"),
    "pressure_x_weight_sellers": ("rolling_7d_orders", "weight_x_sellers"),
    "processing_window_x_clv_complexity": ("seller_processing_window", "clv_x_complexity"),
    "processing_window_x_complexity": ("seller_processing_window", "category_complexity"),
    "processing_window_x_installments": ("seller_processing_window", "log_installments"),
    "processing_window_x_seller_age": ("seller_processing_window", "log_seller_age"),
    "processing_window_x_weight": ("seller_processing_window", "log_total_order_weight"),
    "seller_hub_distance_x_complexity": ("seller_hub_distance", "category_complexity"),
    "seller_hub_distance_x_review": ("seller_hub_distance", "seller_avg_review"),
    "seller_hub_distance_x_seller_age": ("seller_hub_distance", "log_seller_age"),
    "seller_hub_distance_x_shipping_window": ("seller_hub_distance", "shipping_limit_days"),
    "seller_reach_x_hub_distance": ("seller_customer_state_reach", "seller_hub_distance"),
    "shipping_window_x_city_density": ("shipping_window_x_complexity", "log_city_density"),
    "shipping_window_x_clv": ("shipping_window_x_complexity", "log_clv"),
    "shipping_window_x_installment_lag": ("shipping_limit_days", "installment_approval_lag"),
    "shipping_window_x_operational_stress": ("shipping_limit_days", "operational_stress"),
    "shipping_window_x_seller_age": ("shipping_limit_days", "log_seller_age"),
    "shipping_window_x_seller_review": ("shipping_limit_days", "seller_avg_review"),
}


def _products(table: dict[str, tuple[str, ...]]) -> dict[str, Column]:
    return {name: product(*factors) for name, factors in table.items()}


def interaction_features(df: DataFrame) -> DataFrame:
    """Products of features, and the sum that measures operational stress."""
    stress = add(
        fill("log_approval_delay", 0.0), fill("unique_sellers_per_order", 1),
        fill("log_installments", 0.0))
    return df.withColumns(
        {**_products(FIRST_PRODUCTS), "operational_stress": stress}
    ).withColumns(_products(SECOND_PRODUCTS))
