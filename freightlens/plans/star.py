"""The item-grain table: one row per order item with everything known about it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightlens.constants import TARGET
from freightlens.functions import days_between, text_length
from freightlens.session import store
from freightlens.sources import Tables


def geo_centroids(geolocation: DataFrame) -> DataFrame:
    """Mean point of every zip prefix."""
    return geolocation.where("geolocation_zip_code_prefix is not null").groupBy(
        F.col("geolocation_zip_code_prefix").alias("zip_code_prefix"),
    ).agg(F.avg("geolocation_lat").alias("lat"), F.avg("geolocation_lng").alias("lng"))


def payments_per_order(payments: DataFrame) -> DataFrame:
    """One row per order; of equally frequent payment types the smallest counts."""
    return payments.where("order_id is not null").groupBy("order_id").agg(
        F.max("payment_installments").alias("payment_installments"),
        F.mode("payment_type", deterministic=True).alias("payment_type"),
        F.sum("payment_value").alias("payment_value"),
        F.max("payment_sequential").alias("payment_sequential"),
    )


def reviews_per_order(reviews: DataFrame) -> DataFrame:
    """One row per order; the comment length is over the reviews with a comment."""
    return reviews.where("order_id is not null").groupBy("order_id").agg(
        F.avg("review_score").alias("review_score"),
        F.avg(text_length("review_comment_message")).alias("review_comment_length"),
    )


def _located(df: DataFrame, role: str, centroids: DataFrame) -> DataFrame:
    side = centroids.select(
        F.col("zip_code_prefix").alias(f"{role}_zip_code_prefix"),
        F.col("lat").alias(f"{role}_lat"), F.col("lng").alias(f"{role}_lng"),
    )
    return df.join(side, f"{role}_zip_code_prefix")


def build_star(tables: Tables, payments: bool = True, reviews: bool = True) -> DataFrame:
    """Join the source tables on order items.

    Everything that has one row per order is put together first: the customer with
    its point, and payments and reviews reduced to one row per order, which keeps
    the item grain. The items, by far the largest table, meet products and sellers
    while they are narrow, then the orders in a single join: their many columns are
    not moved again, and the rows end up dealt by order.
    """
    centroids = geo_centroids(tables.geolocation)
    sellers = _located(tables.sellers, "seller", centroids)
    customers = _located(tables.customers, "customer", centroids)
    orders = tables.orders.join(customers, "customer_id")
    if payments:
        orders = orders.join(payments_per_order(tables.order_payments), "order_id", "left")
    if reviews:
        orders = orders.join(reviews_per_order(tables.order_reviews), "order_id", "left")
    return (
        tables.order_items.join(tables.products, "product_id")
        .join(sellers, "seller_id")
        .join(orders, "order_id")
    )


def store_columns(star: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``star`` of which only ``columns`` are written and moved. The others keep their
    places, so that builders of features find them by name; to read one is an error."""
    def absent(name: str, kind) -> Column:
        return F.raise_error(F.lit(f"{name} was not stored")).cast(kind).alias(name)

    kept = store(star.select(*columns))
    return kept.select(*[
        F.col(f.name) if f.name in columns else absent(f.name, f.dataType)
        for f in star.schema.fields])


def with_target(star: DataFrame, delivered_only: bool = False) -> DataFrame:
    """Add the promised delivery time in days; rows without it are dropped."""
    needed = [TARGET] + (["order_delivered_customer_date"] if delivered_only else [])
    days = days_between("order_estimated_delivery_date", "order_purchase_timestamp")
    return star.withColumn(TARGET, days).na.drop(subset=needed)
