"""Readers and writers of the source tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freightlens.sources.schemas import MULTI_LINE_TABLES, SCHEMAS

BOM = "\ufeff"


@dataclass(frozen=True)
class Tables:
    """The source tables of one load. Ids may have any type."""

    orders: DataFrame
    order_items: DataFrame
    order_payments: DataFrame
    order_reviews: DataFrame
    products: DataFrame
    sellers: DataFrame
    customers: DataFrame
    geolocation: DataFrame

    @classmethod
    def names(cls) -> list[str]:
        return [field.name for field in fields(cls)]


def _read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Columns are found by header name, so their order in the file and further
    columns do not matter; only the used ones are parsed."""
    raw = spark.read.csv(
        path, header=True, escape='"', multiLine=table in MULTI_LINE_TABLES,
    )
    named = {name.lstrip(BOM): name for name in raw.columns}
    return raw.select(*[
        F.col(f"`{named[column]}`").cast(kind).alias(column)
        for column, kind in SCHEMAS[table].items()
    ])


def read_csv_tables(spark: SparkSession, paths: Mapping[str, str]) -> Tables:
    """``paths`` maps every table name of :class:`Tables` to a CSV path."""
    return Tables(**{name: _read_csv(spark, paths[name], name) for name in Tables.names()})


def read_parquet_tables(spark: SparkSession, folder: str) -> Tables:
    """Tables stored by :func:`write_parquet_tables`; the scan reads only the
    columns and row groups a query needs."""
    return Tables(**{
        name: spark.read.parquet(f"{folder}/{name}").select(*SCHEMAS[name])
        for name in Tables.names()
    })


def write_parquet_tables(tables: Tables, folder: str) -> None:
    """Turn the CSV tables into splittable, prunable Parquet once."""
    for name in Tables.names():
        getattr(tables, name).write.mode("overwrite").parquet(f"{folder}/{name}")


def read_category_translation(spark: SparkSession, path: str) -> DataFrame:
    """Category names and their English form; tolerates a byte-order mark."""
    raw = spark.read.csv(path, header=True)
    return raw.toDF(*[name.lstrip(BOM).strip() for name in raw.columns])
