"""Registered queries: each takes (spark, folder) and returns a DataFrame.

All of them run over the whole tables. Derived doubles are rounded, so that two
engines that add in a different order give the same values.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freightlens.constants import TARGET as Y
from freightlens.functions import clean, clip_upper
from freightlens.models.artifact import Artifact, artifact_name
from freightlens.models.components import principal_components
from freightlens.models.inputs import CATEGORY_INPUTS, COMPONENT_INPUTS, NUMERIC_INPUTS
from freightlens.models.preprocess import fit_preprocessing, impute_and_scale
from freightlens.models.trees import (
    cross_validate_trees, fit_boosted_trees, forest_residuals, validation_gap,
)
from freightlens.operators import densities, graph, ranks, sampling, smooth, stats, summaries
from freightlens.operators.binning import cut_width
from freightlens.operators.lookup import attach, attach_aggregate, stored
from freightlens.operators.quantiles import quantile, quantiles
from freightlens.plans import explore
from freightlens.plans.domain import Domain
from freightlens.plans.encoders import (
    FeatureEncoder, base_features, clean_training_rows, daily_series,
)
from freightlens.plans.features import (
    DIMENSIONS, FIRST_PRODUCTS, SECOND_PRODUCTS, holiday_features, order_features, order_totals,
    with_order_totals,
)
from freightlens.plans.screening import SCREENED, screening_features, screening_report
from freightlens.plans.star import (
    build_star, geo_centroids, payments_per_order, reviews_per_order, store_columns, with_target,
)
from freightlens.session import ensure_checkpoint_dir, store, tune
from freightlens.sources import read_category_translation
from freightlens.sources.fixture import fixture_tables

REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
STATES = [f"NATION_{k}" for k in range(25)]

FIXTURE_DOMAIN = Domain(
    region_of_state={state: REGIONS[k % 5] for k, state in enumerate(STATES)},
    remote_region="AFRICA",
    core_region="AMERICA",
    remote_seller_states=("NATION_0", "NATION_5", "NATION_10"),
    complexity_of_category={"economy": 5, "large": 4, "medium": 3, "promo": 2, "small": 1},
    capital_cities=tuple(f"city_{k}" for k in range(10)),
    neighbours_of_state={
        f"NATION_{k}": [f"NATION_{(k + 1) % 25}", f"NATION_{(k + 5) % 25}"] for k in range(10)},
    platform_launch="1995-01-01",
)
ROW = ["order_id", "order_item_id", "product_id", "seller_id"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def key_mix(modulus: int) -> Column:
    """Arithmetic on the row keys in place of a hash, so that SQL can repeat it."""
    mix = F.col("order_id") * 7919 + F.col("order_item_id") * 104729
    return F.pmod(mix, F.lit(modulus))


class Inputs:
    """The derived tables of one data folder; nothing is read until used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.tables = tune(spark), fixture_tables(spark, folder)

    @cached_property
    def plain_star(self) -> DataFrame:
        """Without payments and reviews, as the exploratory reports use it."""
        return with_target(build_star(self.tables, payments=False, reviews=False))

    @cached_property
    def star(self) -> DataFrame:
        return with_target(build_star(self.tables))

    @cached_property
    def base(self) -> DataFrame:
        return base_features(self.plain_star, FIXTURE_DOMAIN)

    @cached_property
    def full_base(self) -> DataFrame:
        return base_features(self.star, FIXTURE_DOMAIN)

    def stored_star(self, columns: list[str]) -> DataFrame:
        """The ``columns`` of the star with order totals, written once for all steps of a
        query, which reads no others."""
        return store_columns(with_order_totals(self.star), columns)

    @property
    def volumes(self) -> DataFrame:
        return explore.with_volumes(self.base)

    def model_volumes(self) -> DataFrame:
        """What the component and residual models take of ``volumes``, from items that are
        joined and written once."""
        made = ("route_frequency", "seller_order_volume")
        columns = [c for c in COMPONENT_INPUTS if c not in made]
        return explore.with_volumes(store(self.base.select(*ROW, Y, "state_pair", *columns)))

    def routed(self) -> DataFrame:
        return attach_aggregate(
            self.base, ["state_pair"], F.count("order_id").alias("route_frequency"))

    def sold(self) -> DataFrame:
        return attach_aggregate(
            self.base, ["seller_id"], F.count("order_id").alias("seller_order_volume"))


SINGLE = -1


_PLANS: dict[tuple[str, str], Inputs] = {}


def inputs(spark: SparkSession, folder: str) -> Inputs:
    """The plans over one folder, built once per session; they hold no data."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _PLANS:
        _PLANS[key] = Inputs(spark, folder)
    return _PLANS[key]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to decimals, or with ``SINGLE`` to single precision, where decimal
    values such as prices lie on no rounding boundary."""
    def short(column: Column) -> Column:
        if digits == SINGLE:
            return column.cast("float").cast("double")
        return F.round(column, digits)

    return df.select(*[
        short(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType)
        else F.col(f.name) for f in df.schema.fields
    ])


def query(name: str, digits: int = 6):
    def register(build: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return rounded(build(inputs(spark, folder)), digits)

        run.__name__ = name
        QUERIES[name] = run
        return build

    return register


# Joins to the item grain

@query("geo_centroid")
def _(t):
    return geo_centroids(t.tables.geolocation)


@query("payments_per_order", 4)
def _(t):
    return payments_per_order(t.tables.order_payments)


@query("reviews_per_order")
def _(t):
    return reviews_per_order(t.tables.order_reviews)


@query("star_join")
def _(t):
    return build_star(t.tables)


@query("category_translation")
def _(t):
    """Category names go out to CSV under a marked header and come back in."""
    ensure_checkpoint_dir(t.spark)
    folder = f"{t.spark.sparkContext.getCheckpointDir()}/translation-{uuid4().hex}"
    names = t.tables.products.where("product_category_name is not null").select(
        "product_category_name").distinct()
    names.select(
        F.col("product_category_name").alias("\ufeffproduct_category_name"),
        F.upper("product_category_name").alias("product_category_name_english"),
    ).coalesce(1).write.csv(folder, header=True)
    table = read_category_translation(t.spark, folder)
    items = t.tables.order_items.join(t.tables.products, "product_id")
    return items.join(table, "product_category_name", "left").groupBy(
        "product_category_name_english").agg(
        F.count("*").alias("items"), F.sum(F.round("price", 4)).alias("revenue")).withColumn(
        "revenue", F.round("revenue", 2))


# Scalar expressions

def row_query(name: str, columns: list[str], digits: int = 4, full: bool = False):
    @query(name, digits)
    def _(t):
        return (t.full_base if full else t.base).select(*ROW, *columns)


row_query("haversine_km", ["real_distance_km"])
row_query("hub_distance", ["seller_hub_distance"])
row_query("delivery_days", [Y, "shipping_limit_days", "days_since_platform_launch"])
row_query("approval_hours", ["payment_approval_delay", "seller_processing_window"])
row_query("calendar_parts", [
    "purchase_month", "purchase_dayofweek", "purchase_hour", "purchase_week_of_year", "quarter",
    "purchase_date", "days_until_end_of_month"])
row_query("dims_features", [
    "product_volume", "max_dimension_cm", "product_surface_area", "compactness_ratio",
    "product_length_to_height_ratio", "product_max_to_min_dimension_ratio", "is_oversized"])
row_query("direction_code", ["seller_to_customer_direction"])
row_query("text_flags", [
    "seller_in_capital_city", "customer_in_capital_city", "is_same_city", "state_pair"])
row_query("safe_ratios", [
    "freight_ratio", "freight_per_km", "freight_per_weight", "price_per_km", "product_density"], 9)
row_query("log_features", [
    "log_distance", "log_weight", "log_volume", "log_freight", "log_clv", "log_surface_area",
    "log_days_since_launch", "log_approval_delay"])


# Filters, samples, splits

@query("dropna_clean", 4)
def _(t):
    return clean_training_rows(t.base).select(*ROW, "product_weight_g", "freight_value", "price")


@query("exact_sample", 4)
def _(t):
    return sampling.exact_sample(
        t.plain_star.select(*ROW, "price"), 1000, order=[key_mix(1_000_003), *ROW, "price"])


@query("hash_split", 4)
def _(t):
    train, test = sampling.hash_split(t.plain_star, ROW[:2], bucket=key_mix(100))
    parts = [df.agg(F.lit(side).alias("part"), F.count("*").alias("rows"),
                    F.sum(Y).alias("days")) for side, df in (("train", train), ("test", test))]
    return parts[0].unionByName(parts[1])


@query("clip_q99", 4)
def _(t):
    bound = F.lit(quantile(t.base, "freight_per_km", 0.99))
    return t.base.select(*ROW, clip_upper(clean("freight_per_km"), bound).alias("freight_per_km"))


@query("inf_clean", 4)
def _(t):
    endless = F.when(F.col("price") == 0, F.lit(float("inf"))).otherwise(
        F.col("freight_value") / F.nullif("price", F.lit(0.0)))
    return t.base.select(*ROW, clean(endless).alias("freight_ratio"))


# Lookups

row_query("region_map", [
    "seller_region", "customer_region", "same_region", "north_involved", "remote_state_flag",
    "southeast_seller", "seller_remote_flag"])
row_query("complexity_map", ["category_complexity"])
row_query("neighbour_flag", ["is_neighboring_state"])


@query("pair_frequency")
def _(t):
    return attach_aggregate(t.base, ["seller_state", "customer_state"],
                            F.count("*").alias("pair_frequency")).select(*ROW, "pair_frequency")


@query("map_with_mean_fill")
def _(t):
    return explore.with_route_variability(t.base, rows=100).select(*ROW, "route_variability")


@query("date_lookup")
def _(t):
    days, _ = stored(daily_series(t.base))
    return attach(t.base, days, ["purchase_date"]).select(
        *ROW, "purchase_date", "daily_order_count",
        F.coalesce("rolling_7d_orders", F.lit(0.0)).alias("rolling_7d_orders"))


@query("category_codes")
def _(t):
    df = t.base
    for column in ("seller_state", "customer_state", "state_pair"):
        codes, _ = stored(ranks.value_codes(df, column, f"{column}_cat"))
        df = ranks.code_of(df, codes, column, f"{column}_cat")
    return df.select(*ROW, "seller_state_cat", "customer_state_cat", "state_pair_cat")


# Group figures on rows

@query("route_frequency")
def _(t):
    return t.routed().select(*ROW, "state_pair", "route_frequency")


@query("rolling_7d_orders")
def _(t):
    return daily_series(t.base)


@query("seller_age")
def _(t):
    df = screening_features(t.star, FIXTURE_DOMAIN)
    return df.select(*ROW, "seller_age_days", "log_seller_age")


@query("seller_attached_stats", 4)
def _(t):
    return attach_aggregate(
        t.plain_star, ["seller_id"], F.max("price").alias("seller_max_price"),
        (F.max("price") - F.min("price")).alias("seller_price_range"),
        F.count_distinct("customer_state").alias("seller_customer_state_reach"),
    ).select(*ROW, "seller_max_price", "seller_price_range", "seller_customer_state_reach")


# Aggregates

def stats_query(name: str, *keys: str):
    @query(name)
    def _(t):
        return stats.group_stats(t.base, keys, Y)


stats_query("stats_by_month", "purchase_month")
stats_query("stats_by_region", "customer_region")
stats_query("stats_by_seller_state", "seller_state")
stats_query("stats_by_zip_bin", "customer_zip_prefix_bin")
stats_query("stats_by_item_no", "order_item_id")


@query("stats_by_weekday")
def _(t):
    return stats.group_means(t.base, ["purchase_dayofweek"], Y)


@query("stats_by_region_pair")
def _(t):
    return stats.group_stats(t.base, ["seller_region", "customer_region"], Y).select(
        "seller_region", "customer_region", "mean", "count")


@query("stats_by_route_min10")
def _(t):
    return explore.route_stats(t.base)


@query("flag_contrast")
def _(t):
    return explore.flag_summary(t.volumes)


@query("order_rollup", 4)
def _(t):
    return order_totals(t.base)


@query("seller_shares")
def _(t):
    late = F.coalesce(F.col("payment_installments") > 3, F.lit(False)).cast("double")
    df = t.full_base
    return stats.grouped(
        df, ["seller_id"], F.avg(late).alias("high_installment_rate"),
        F.avg((F.col("purchase_dayofweek") >= 5).cast("double")).alias("weekend_ratio"),
        F.avg((F.col("purchase_hour") < 8).cast("double")).alias("night_ratio"),
        F.avg(F.hour("order_approved_at")).alias("approval_hour"),
        F.avg("review_score").alias("avg_review"),
        F.stddev_samp("review_score").alias("review_volatility"))


@query("seller_price_range", 4)
def _(t):
    return stats.grouped(t.plain_star, ["seller_id"],
                         (F.max("price") - F.min("price")).alias("price_range"))


@query("seller_reach")
def _(t):
    return stats.grouped(t.plain_star, ["seller_id"],
                         F.count_distinct("customer_state").alias("state_reach"))


@query("product_first_sale")
def _(t):
    return stats.grouped(t.plain_star, ["product_id"],
                         F.min("order_purchase_timestamp").alias("first_sale"))


@query("target_encoding")
def _(t):
    return stats.grouped(t.base, ["state_pair"], F.count("order_id").alias("route_frequency"),
                         F.avg(Y).alias("avg_days"), F.stddev_samp(Y).alias("variability"))


@query("daily_orders")
def _(t):
    return daily_series(t.base).select("purchase_date", "daily_order_count")


@query("city_density")
def _(t):
    return stats.grouped(t.plain_star, ["customer_city"], F.count("order_id").alias("orders"),
                         F.count_distinct("seller_state").alias("seller_states"))


@query("state_pivot")
def _(t):
    return stats.pivot_mean(t.base, "seller_state", "customer_state", STATES, Y)


@query("region_pivot")
def _(t):
    return stats.pivot_mean(t.base, "seller_region", "customer_region", REGIONS, Y)


@query("describe_target")
def _(t):
    return stats.describe(t.plain_star, Y)


@query("quantile_vector")
def _(t):
    probs = [0.1, 0.25, 0.5, 0.75, 0.9]
    found = quantiles(t.base, "freight_per_km", probs)
    return t.base.agg(F.count(clean("freight_per_km")).alias("rows"), *[
        F.lit(v).alias(f"q{int(p * 100)}") for p, v in zip(probs, found)])


# Bins

def decile_query(name: str, x: str, bins: int, source: str = "base", clip: float | None = None):
    @query(name)
    def _(t):
        df = {"base": lambda: t.base, "routed": t.routed, "sold": t.sold,
              "volumes": lambda: t.volumes}[source]()
        return explore.decile_stats(df, x, bins, clip)


decile_query("distance_deciles", "real_distance_km", 10)
decile_query("freight_deciles", "freight_value", 10)
decile_query("price_deciles", "price", 10)
decile_query("route_freq_quintiles", "route_frequency", 5, "routed")
decile_query("seller_volume_quintiles", "seller_order_volume", 5, "sold")
decile_query("volume_quintiles", "product_volume", 5)
decile_query("compactness_quintiles", "compactness_ratio", 5, clip=0.99)
decile_query("distance_ratio_deciles", "distance_route_ratio", 10, "volumes", clip=0.99)


@query("weight_bins")
def _(t):
    return explore.weight_stats(t.base)


@query("freight_tiers")
def _(t):
    return stats.group_stats(t.base, ["freight_tier"], Y)


@query("hour_buckets")
def _(t):
    return stats.group_stats(t.base, ["purchase_hour_bucket"], Y)


@query("holiday_windows")
def _(t):
    """Days to the next turn of the year as the distance to a holiday."""
    df = t.base.withColumn("days_to_holiday", F.date_diff(
        F.last_day(F.make_date(F.year("purchase_date"), F.lit(12), F.lit(1))), "purchase_date"))
    return holiday_features(df).groupBy("holiday_window", "pre_holiday_flag").agg(
        F.count("*").alias("rows"), F.avg(Y).alias("mean"))


@query("price_width_bins")
def _(t):
    return stats.group_stats(cut_width(t.base, "price", 5), ["bin"], Y)


# Correlations

@query("corr_table")
def _(t):
    return stats.corr_table(t.volumes, {
        name: F.col(column) for name, column in explore.CORRELATED.items()}, Y)


@query("pearson_test", 9)
def _(t):
    return stats.pearson_test(t.base, "customer_zip_code_prefix", Y).select(
        F.round("r", 6).alias("r"), "rows", F.round("t", 4).alias("t"), "p")


@query("spearman", 9)
def _(t):
    return ranks.spearman(t.base, "real_distance_km", Y).select(
        F.round("r", 6).alias("r"), "rows", F.round("t", 4).alias("t"), "p")


@query("screening_report")
def _(t):
    return screening_report(screening_features(t.star, FIXTURE_DOMAIN, [Y]))[0]


@query("screening_bins")
def _(t):
    return screening_report(screening_features(t.star, FIXTURE_DOMAIN, [Y]))[1]


# Top lists

@query("variable_routes_top10")
def _(t):
    return explore.extreme_routes(t.base, most=True)


@query("stable_routes_top10")
def _(t):
    return explore.extreme_routes(t.base, most=False)


@query("top_corridors")
def _(t):
    edges = graph.route_edges(t.plain_star, "seller_state", "customer_state")
    return edges.orderBy(F.desc("weight"), "src", "dst").limit(35)


@query("top_zip_bins")
def _(t):
    return explore.top_zip_areas(t.base)


# Chart tables

@query("hexbin_counts")
def _(t):
    return summaries.hexbin(t.plain_star, "price", Y, 50)


@query("hexbin_log_volume")
def _(t):
    pair = t.base.select(F.col("product_volume"), F.col(Y).alias("y"))
    return summaries.hexbin(pair, F.log1p("product_volume"), "y", 50).select("count").groupBy(
        "count").agg(F.count("*").alias("hexagons"))


@query("histogram")
def _(t):
    return summaries.histogram(t.routed(), "route_frequency", 50)


@query("histogram_route_std")
def _(t):
    return summaries.histogram(explore.route_stats(t.base), "std", 40)


@query("box_stats")
def _(t):
    return summaries.box_stats(t.base, "customer_region", Y)


@query("box_by_item_no")
def _(t):
    return summaries.box_stats(t.base.where("order_item_id <= 10"), "order_item_id", "price")


@query("violin_density")
def _(t):
    return densities.violin(t.base, "purchase_month", Y)


@query("kde_1d")
def _(t):
    pair = explore.clipped_pair(t.base, "freight_per_km")
    return densities.kde(pair, "x", points=200, keep=False)


@query("kde_2d", 9)
def _(t):
    pair = explore.clipped_pair(t.base, "product_density")
    return densities.kde_2d(pair, "x", "y", keep=False)


@query("month_band")
def _(t):
    return summaries.mean_band(t.base, "purchase_month", Y)


@query("lowess_curve")
def _(t):
    return smooth.lowess_grid(t.plain_star, "price", Y, frac=0.15)


@query("lowess_robust")
def _(t):
    return smooth.lowess_grid(t.plain_star, "price", Y, frac=0.15, rounds=3)


# Graph

def _edges(t):
    return graph.route_edges(t.plain_star, "seller_state", "customer_state")


@query("route_edges")
def _(t):
    return _edges(t)


@query("degree_centrality")
def _(t):
    return graph.degree_centrality(_edges(t))


@query("pagerank")
def _(t):
    edges, _ = stored(_edges(t))
    return graph.pagerank(edges, tolerance=0.0, rounds=20)


@query("top_nodes")
def _(t):
    edges, _ = stored(_edges(t))
    return graph.top_nodes({
        "degree": (graph.degree_centrality(edges), "centrality"),
        "pagerank": (graph.pagerank(edges, tolerance=0.0, rounds=20), "rank")})


@query("top_betweenness")
def _(t):
    edges, _ = stored(_edges(t))
    nodes = graph.betweenness(edges)
    return graph.top_nodes({"betweenness": (nodes, "betweenness")})


@query("betweenness")
def _(t):
    edges, _ = stored(_edges(t))
    return graph.betweenness(edges)


@query("corridor_sizes")
def _(t):
    edges, _ = stored(_edges(t))
    return graph.corridors(edges, graph.degree_centrality(edges),
                           graph.pagerank(edges, tolerance=0.0, rounds=20))


# Feature layers

GEO = ["real_distance_km", "log_distance", "seller_hub_distance", "seller_customer_lat_diff",
       "seller_customer_lng_diff", "zip_distance", "customer_zip_prefix_bin",
       "seller_zip_prefix_bin", "seller_zip_to_customer_zip_ratio", "same_state",
       "north_involved", "remote_state_flag", "southeast_seller", "seller_remote_flag",
       "extreme_longhaul_flag"]
PRODUCT = ["product_volume", "max_dimension_cm", "category_complexity", "heavy_item_flag",
           "long_heavy", "short_heavy", "local_heavy", "log_weight", "log_volume",
           "distance_weight", "volume_distance_interaction", "freight_ratio", "freight_per_km",
           "freight_per_weight", "price_per_km", "log_freight", "log_clv", "freight_tier",
           "ultra_cheap_freight", "multi_item_order", "compactness_ratio"]
TIME = ["purchase_quarter_x_dayofweek", "purchase_hour_bucket", "holiday_pressure",
        "fast_season", "end_of_year", "shipping_limit_days", "seller_processing_window",
        "payment_approval_delay", "log_approval_delay", "log_days_since_launch"]
ORDER = ["items_per_order", "unique_sellers_per_order", "order_item_diversity", "total_weight",
         "total_volume", "order_total_price", "order_max_dimension", "max_item_price",
         "log_total_order_weight", "log_order_total_volume", "items_per_seller",
         "order_diversity_x_sellers", "order_price_x_unique_sellers",
         "order_total_price_x_installments", "payment_value_per_item",
         "payment_value_vs_order_value", "payment_value_x_installments",
         "avg_installment_value", "is_single_payment", "log_installments",
         "weekend_purchase_x_installments", "payment_sequential_x_complexity",
         "log_review_comment", "log_payment_value_x_installments",
         "log_order_total_price_x_installments"]
LOOKED_UP = ["seller_order_volume", "seller_avg_review", "seller_review_volatility",
             "seller_high_installment_rate", "seller_avg_order_value", "seller_age_days",
             "seller_customer_state_reach", "seller_price_range", "route_frequency",
             "route_variability", "state_pair_avg_days", "state_pair_cat",
             "seller_state_avg_days", "seller_state_cat", "customer_state_avg_days",
             "customer_state_cat", "customer_city_order_density",
             "customer_city_seller_concentration", "daily_order_count", "rolling_7d_orders",
             "product_catalog_age_days", "photos_vs_category_avg", "rare_route_flag",
             "distance_route_ratio", "log_seller_age", "log_city_density", "log_rolling_7d",
             "log_order_value_ratio", "log_distance_route_ratio", "log_catalog_age"]
INTERACTIONS = [*FIRST_PRODUCTS, "operational_stress", *SECOND_PRODUCTS]

# Columns of the layers that hold whole numbers or dates.
INTEGERS = [
    "zip_distance", "customer_zip_prefix_bin", "seller_zip_prefix_bin", "same_state",
    "north_involved", "remote_state_flag", "southeast_seller", "seller_remote_flag",
    "extreme_longhaul_flag", "category_complexity", "heavy_item_flag", "long_heavy",
    "short_heavy", "local_heavy", "freight_tier", "ultra_cheap_freight", "multi_item_order",
    "purchase_quarter_x_dayofweek", "purchase_hour_bucket", "holiday_pressure", "fast_season",
    "end_of_year", "shipping_limit_days", "items_per_order", "unique_sellers_per_order",
    "order_item_diversity", "order_diversity_x_sellers", "is_single_payment",
    "weekend_purchase_x_installments", "seller_order_volume", "seller_age_days",
    "seller_customer_state_reach", "route_frequency", "state_pair_cat", "seller_state_cat",
    "customer_state_cat", "customer_city_order_density", "customer_city_seller_concentration",
    "daily_order_count", "product_catalog_age_days", "rare_route_flag",
]

row_query("feature_layer_geo", GEO, SINGLE)
row_query("feature_layer_product", PRODUCT, SINGLE)
row_query("feature_layer_time", TIME)


@query("feature_layer_order", SINGLE)
def _(t):
    return order_features(t.full_base).select(*ROW, *ORDER)


# Columns of the star: what lookups are fitted on, and what the layers, with order totals,
# and the models read beside that.
FITTED = [*ROW, "seller_state", "customer_state", "customer_city", "product_category_name",
          "product_photos_qty", "order_purchase_timestamp", "payment_installments",
          "review_score", "price", Y]
POINTS = ["customer_lat", "customer_lng", "seller_lat", "seller_lng"]
CROSSED = [*FITTED, "seller_lat", "seller_lng", "order_approved_at", "shipping_limit_date",
           "freight_value", "payment_value", "total_weight", "unique_sellers_per_order",
           "order_total_price"]
TRAINED = [*FITTED, *POINTS, "order_approved_at", "shipping_limit_date", "freight_value",
           "payment_value", "payment_sequential", "review_comment_length",
           "customer_zip_code_prefix", "seller_zip_code_prefix", "order_delivered_customer_date",
           "product_weight_g", *DIMENSIONS]


@query("feature_layer_seller", 4)
def _(t):
    rows = t.stored_star([*FITTED, *POINTS])
    model = FeatureEncoder(FIXTURE_DOMAIN).fit(rows, kept=True)
    return model.transform(rows).select(*ROW, *LOOKED_UP)


@query("feature_layer_interactions", 2)
def _(t):
    rows = t.stored_star(CROSSED)
    model = FeatureEncoder(FIXTURE_DOMAIN).fit(rows, kept=True)
    return model.transform(rows).select(*ROW, *INTERACTIONS)


@query("feature_layer_screening", SINGLE)
def _(t):
    df = screening_features(t.star, FIXTURE_DOMAIN, ROW)
    return df.select(*ROW, *[F.col(c).cast("double").alias(c) for c in SCREENED])


@query("encoder_transform_test", 4)
def _(t):
    rows = t.stored_star([
        *FITTED, *POINTS, "order_delivered_customer_date", "product_weight_g", "freight_value",
    ]).na.drop(subset=["order_delivered_customer_date"])
    train, test = sampling.hash_split(rows, ROW[:2], bucket=key_mix(100))
    model = FeatureEncoder(FIXTURE_DOMAIN).fit(clean_training_rows(train), kept=True)
    return model.transform(clean_training_rows(test)).select(*ROW, *LOOKED_UP)


# Models

MODEL_NUMERIC = ["real_distance_km", "product_weight_g", "freight_value", "price",
                 "freight_per_km", "purchase_month", "same_state"]


@query("standardise_impute", 4)
def _(t):
    scaler = impute_and_scale(t.base, MODEL_NUMERIC)
    return scaler.transform(t.base).select(*ROW, *[f"{c}__z" for c in MODEL_NUMERIC])


@query("standardise_impute_all", 4)
def _(t):
    """All numeric inputs of the models, over the training rows."""
    _, train, _ = _training(t)
    train, _ = stored(train.select(*ROW, *NUMERIC_INPUTS))
    scaler = impute_and_scale(train, NUMERIC_INPUTS)
    return scaler.transform(train).select(*ROW, *[f"{c}__z" for c in NUMERIC_INPUTS])


@query("one_hot")
def _(t):
    df = store(t.base.select(*CATEGORY_INPUTS))  # read by every stage of the fit
    model = fit_preprocessing(df.withColumn("one", F.lit(1.0)), ["one"], CATEGORY_INPUTS)
    # Sparse vectors are read as they are: their values are few, whatever the width.
    hot = model.transform(df.withColumn("one", F.lit(1.0))).select(
        *CATEGORY_INPUTS, F.unwrap_udt("features").alias("v")).select(
        *CATEGORY_INPUTS,
        F.coalesce("v.size", F.array_size("v.values")).alias("width"),
        F.aggregate("v.values", F.lit(0.0), lambda a, b: a + b).alias("ones"))
    return hot.groupBy(*CATEGORY_INPUTS, "width", "ones").agg(F.count("*").alias("rows"))


@query("pca_regimes", 4)
def _(t):
    found = principal_components(t.model_volumes(), carry=[Y])
    explained = t.spark.createDataFrame(
        [("explained", *found.explained)], ["feature", "pc1", "pc2"])
    return found.loadings.unionByName(explained)


@query("pca_scores", 4)
def _(t):
    return principal_components(t.model_volumes(), carry=[Y]).scores.groupBy(Y).agg(
        F.avg("pc1").alias("pc1"), F.avg("pc2").alias("pc2"), F.count("*").alias("rows"))


@query("forest_residuals", 4)
def _(t):
    scored = forest_residuals(t.model_volumes(), ROW[:2], bucket=key_mix(100))
    by_bin = explore.residuals_by_bin(scored, "real_distance_km").select(
        F.col("bin").cast("string").alias("part"), "mean", "std", F.col("count").alias("rows"))
    return by_bin.unionByName(stats.residual_summary(scored, "residual").select(
        F.lit("all").alias("part"), "mean", "std", "rows"))


def _split(t):
    """The encoder, and the star rows of training and test. Order totals are those of the
    rows on each side."""
    rows = store_columns(t.star, TRAINED).na.drop(subset=["order_delivered_customer_date"])
    train, test = sampling.hash_split(rows, ROW[:2], bucket=key_mix(100))
    train, test = clean_training_rows(train), clean_training_rows(test)
    return FeatureEncoder(FIXTURE_DOMAIN).fit(train, kept=True), train, test


def _training(t):
    model, train, test = _split(t)
    return model, model.transform(train), model.transform(test)


# All inputs, the operators' own depth, rounds and folds; only `cv_scores` bounds its rounds.
BOOSTED = {"numeric": NUMERIC_INPUTS, "categories": CATEGORY_INPUTS}
MODEL_COLUMNS = [*NUMERIC_INPUTS, *CATEGORY_INPUTS, Y]


@query("boosted_rmse", 4)
def _(t):
    _, train, test = _training(t)
    train, _ = stored(train.select(*MODEL_COLUMNS))
    model = fit_boosted_trees(train, **BOOSTED)
    return stats.rmse(model.transform(test), Y, "prediction")


@query("cv_scores", 4)
def _(t):
    """Ten folds and the model of all training rows, grown together; the gap is to the
    test rows."""
    _, train, test = _training(t)
    train, _ = stored(train.select(*MODEL_COLUMNS, sampling.fold_of(ROW[:2], 10).alias("fold")))
    scores, model = cross_validate_trees(train, "fold", whole=True, **BOOSTED, rounds=3)
    return validation_gap(scores, stats.rmse(model.transform(test), Y, "prediction"))


@query("model_roundtrip", 4)
def _(t):
    """Figures of the test rows from the loaded artifact, and how far its predictions
    are from those of the model in memory."""
    encoder, train, test = _training(t)
    train, _ = stored(train.select(*MODEL_COLUMNS))
    model = fit_boosted_trees(train, **BOOSTED)
    test, _ = stored(model.transform(test).select(*ROW, Y, "prediction"))
    error = stats.rmse(test, Y, "prediction").first()["rmse"]
    ensure_checkpoint_dir(t.spark)
    folder = f"{t.spark.sparkContext.getCheckpointDir()}/{artifact_name(uuid4().hex, error or 0.0)}"
    Artifact(encoder, model, BOOSTED["numeric"], BOOSTED["categories"],
             {"test_rmse": error, "rounds": len(model.trees)}).save(folder)
    loaded = Artifact.load(t.spark, folder, FIXTURE_DOMAIN)
    scored = loaded.score(t.star).select(*ROW, F.col("prediction").alias("again"))
    both = test.join(scored, ROW)
    return both.agg(
        F.sqrt(F.avg(F.pow(F.col(Y) - F.col("again"), 2))).alias("rmse"),
        F.max(F.abs(F.col("prediction") - F.col("again"))).alias("largest_difference"),
        F.lit(loaded.figures["test_rmse"]).cast("double").alias("stored_rmse"),
        F.lit(len(loaded.model.trees)).alias("trees"), F.count("*").alias("rows"))
