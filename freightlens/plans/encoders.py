"""Lookups fitted on training rows and applied to any rows."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freightlens.constants import TARGET
from freightlens.functions import days_between, flag, log1p, ratio
from freightlens.operators.lookup import attach, is_small, stored
from freightlens.operators.quantiles import quantiles
from freightlens.operators.ranks import value_codes
from freightlens.plans.domain import Domain
from freightlens.plans.features import (
    geo_features, interaction_features, order_features, product_features, time_features,
)
from freightlens.session import store

# Lookup tables by name, with their key columns.
KEYS = {
    "seller": ["seller_id"],
    "route": ["state_pair"],
    "seller_state": ["seller_state"],
    "customer_state": ["customer_state"],
    "city": ["customer_city"],
    "product": ["product_id"],
    "category": ["product_category_name"],
    "day": ["purchase_date"],
}
WINDOW_DAYS = 7
FITTED_COLUMNS = [
    "order_id", "product_id", "seller_id", "seller_state", "customer_state", "state_pair",
    "customer_city", "product_category_name", "product_photos_qty", "purchase_date",
    "order_purchase_timestamp", "payment_installments", "review_score", "price", TARGET,
]


def daily_series(df: DataFrame, day: str = "purchase_date") -> DataFrame:
    """Rows per day and their mean over seven consecutive active days; NULL until
    seven days are there. The window runs on the daily table."""
    days = df.where(F.col(day).isNotNull()).groupBy(day).agg(
        F.count("*").alias("daily_order_count"))
    trailing = Window.orderBy(day).rowsBetween(1 - WINDOW_DAYS, 0)
    full = F.count("*").over(trailing) == WINDOW_DAYS
    return days.withColumn(
        "rolling_7d_orders", F.when(full, F.avg("daily_order_count").over(trailing)))


def _per(df: DataFrame, key: str, *aggregates: Column) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*aggregates)


def _lookup_tables(train: DataFrame) -> dict[str, DataFrame]:
    """One aggregation per key; everything that shares a key shares a pass."""
    bought, y = "order_purchase_timestamp", F.col(TARGET)
    latest = train.agg(F.max(bought).alias("m")).scalar()
    often = F.coalesce(F.col("payment_installments") > 3, F.lit(False)).cast("double")
    sellers = _per(
        train, "seller_id",
        F.count("order_id").alias("seller_order_volume"),
        F.avg("review_score").alias("seller_avg_review"),
        F.stddev_samp("review_score").alias("seller_review_volatility"),
        F.avg(often).alias("seller_high_installment_rate"),
        F.avg("price").alias("seller_avg_order_value"),
        F.min(bought).alias("__first"),
        F.count_distinct("customer_state").alias("seller_customer_state_reach"),
        (F.max("price") - F.min("price")).alias("seller_price_range"),
    ).withColumn("seller_age_days", days_between(latest, "__first")).drop("__first")
    codes = {
        side: value_codes(train, side, f"{side}_cat") for side in ("seller_state", "customer_state")
    }
    means = {
        side: _per(train, side, F.avg(y).alias(f"{side}_avg_days"))
        for side in ("seller_state", "customer_state")
    }
    routes = _per(
        train, "state_pair", F.count("order_id").alias("route_frequency"),
        F.avg(y).alias("state_pair_avg_days"), F.stddev_samp(y).alias("route_variability"))
    # The routes are the sorted distinct pairs already.
    order = Window.orderBy("state_pair")
    return {
        "seller": sellers,
        "route": routes.withColumn(
            "state_pair_cat", (F.row_number().over(order) - 1).cast("int")),
        "seller_state": means["seller_state"].join(codes["seller_state"], "seller_state"),
        "customer_state": means["customer_state"].join(codes["customer_state"], "customer_state"),
        "city": _per(
            train, "customer_city", F.count("order_id").alias("customer_city_order_density"),
            F.count_distinct("seller_state").alias("customer_city_seller_concentration")),
        "product": _per(train, "product_id", F.min(bought).alias("product_first_sale")),
        "category": _per(
            train, "product_category_name",
            F.avg("product_photos_qty").alias("category_avg_photos")),
        "day": daily_series(train),
    }


# What a key unseen at fitting gets; "mean" is the mean over the
# groups of the lookup table.
MISSING = {
    "seller_order_volume": 0, "seller_avg_review": 3.0, "seller_review_volatility": 0.0,
    "seller_high_installment_rate": 0.0, "seller_avg_order_value": "mean", "seller_age_days": 0,
    "route_frequency": 0, "route_variability": "mean", "state_pair_avg_days": "mean",
    "seller_state_avg_days": "mean", "customer_state_avg_days": "mean",
    "state_pair_cat": -1, "seller_state_cat": -1, "customer_state_cat": -1,
    "customer_city_order_density": 0, "customer_city_seller_concentration": 0,
    "daily_order_count": 0, "rolling_7d_orders": 0.0,
}
MEAN_FILLED = {
    "seller_avg_order_value": "seller", "route_variability": "route",
    "state_pair_avg_days": "route", "seller_state_avg_days": "seller_state",
    "customer_state_avg_days": "customer_state",
}


def base_features(star: DataFrame, domain: Domain) -> DataFrame:
    """Everything that needs no other row: geography, product, time."""
    return time_features(product_features(geo_features(star, domain), domain), domain)


@dataclass
class EncoderModel:
    """Fitted lookup tables with their sizes, and the fitted scalars."""

    domain: Domain
    tables: dict[str, DataFrame]
    rows: dict[str, int]
    scalars: dict[str, float | None] = field(default_factory=dict)

    def transform(self, star: DataFrame, base: bool = True) -> DataFrame:
        """Add all features to star rows, in one pass over them plus the order
        totals. Lookup tables come from fitting only, also for training rows."""
        # The joins that move the rows come first, while these are narrow.
        moving = [name for name, keys in KEYS.items() if set(keys) <= set(star.columns)
                  and not is_small(self.tables[name], self.rows[name])]
        for name in moving:
            star = attach(star, self.tables[name], KEYS[name])
        df = order_features(base_features(star, self.domain) if base else star)
        for name, keys in KEYS.items():
            if name not in moving:
                df = attach(df, self.tables[name], keys, self.rows[name])
        df = df.withColumns({
            column: F.coalesce(column, F.lit(
                self.scalars[f"mean_{column}"] if default == "mean" else default))
            for column, default in MISSING.items()
        })
        return interaction_features(self._derived(df))

    def _derived(self, df: DataFrame) -> DataFrame:
        rare = self.scalars["rare_route_bound"]
        age = days_between("order_purchase_timestamp", "product_first_sale")
        return df.withColumns({
            "distance_route_ratio": ratio("real_distance_km", "route_frequency"),
            "rare_route_flag": flag(F.col("route_frequency") < F.lit(rare)),
            "product_catalog_age_days": age,
            "photos_vs_category_avg": ratio("product_photos_qty", "category_avg_photos"),
            "log_rolling_7d": log1p("rolling_7d_orders"),
            "daily_order_pressure": F.col("daily_order_count"),
            "log_seller_age": log1p("seller_age_days"),
            "log_city_density": log1p("customer_city_order_density"),
            "log_order_value_ratio": log1p(ratio("price", "seller_avg_order_value")),
        }).withColumns({
            "log_distance_route_ratio": log1p("distance_route_ratio"),
            "log_catalog_age": log1p(F.coalesce("product_catalog_age_days", F.lit(0))),
        })

    def save(self, folder: str) -> None:
        """Tables as Parquet under ``maps``, sizes and scalars as one JSON row."""
        spark = self.tables["seller"].sparkSession
        for name, table in self.tables.items():
            table.write.mode("overwrite").parquet(f"{folder}/maps/{name}")
        meta = json.dumps({"rows": self.rows, "scalars": self.scalars})
        spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode(
            "overwrite").text(f"{folder}/scalars")

    @classmethod
    def load(cls, spark: SparkSession, folder: str, domain: Domain | None = None) -> EncoderModel:
        meta = json.loads(spark.read.text(f"{folder}/scalars").first()[0])
        tables = {name: spark.read.parquet(f"{folder}/maps/{name}") for name in KEYS}
        return cls(domain or Domain(), tables, meta["rows"], meta["scalars"])


@dataclass
class FeatureEncoder:
    """Fits the lookups on training rows of the star table."""

    domain: Domain = field(default_factory=Domain)

    def fit(self, train: DataFrame, base: bool = False, kept: bool = False) -> EncoderModel:
        """``base`` says that the base features are already there, ``kept`` that reading
        ``train`` again joins nothing."""
        df = train if base else base_features(train, self.domain)
        # Eight aggregations read the same few columns: stored for the time being.
        df = df.select(*FITTED_COLUMNS) if kept else store(df.select(*FITTED_COLUMNS))
        tables, rows = {}, {}
        for name, table in _lookup_tables(df).items():
            tables[name], rows[name] = stored(table)
        scalars = {
            f"mean_{column}": tables[name].agg(F.avg(column)).first()[0]
            for column, name in MEAN_FILLED.items()
        }
        scalars["rare_route_bound"] = self._rare_bound(tables["route"])
        return EncoderModel(self.domain, tables, rows, scalars)

    @staticmethod
    def _rare_bound(routes: DataFrame) -> float | None:
        """First quartile of the route frequency over rows: every route counts as
        often as it has rows."""
        return quantiles(routes, "route_frequency", [0.25], weight="route_frequency")[0]


def clean_training_rows(
    star: DataFrame, needed: Sequence[str] = ("product_weight_g", "freight_value", "price")
) -> DataFrame:
    """Rows with the fields a model cannot do without."""
    return star.na.drop(subset=list(needed))
