"""Average ranks, Spearman correlation and codes of sorted values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightlens.functions import clean
from freightlens.operators.lookup import attach, stored
from freightlens.operators.quantiles import _log_cell, _sub_cell
from freightlens.operators.stats import t_statistic, with_p_value
from freightlens.session import store


def average_ranks(counts: DataFrame, value: str, weight: str) -> tuple[DataFrame, int]:
    """Rank of every distinct value, ties sharing their mean rank, and the number
    of distinct values.

    ``counts`` holds values with row counts. Cells of the value range are summed
    first and the windows run inside narrow cells, at every size.
    """
    values, rows = stored(
        counts.groupBy(F.col(value).alias("__x")).agg(F.sum(weight).alias("__n")))
    values, before = _with_offsets(values)
    rank = before + (F.col("__n") + 1) / 2
    return values.select(F.col("__x").alias(value), rank.alias("rank")), rows


def _with_offsets(values: DataFrame) -> tuple[DataFrame, Column]:
    def preceding(*keys: str):
        return Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)

    celled = values.withColumn("__c", _log_cell(F.col("__x")))
    cells = celled.groupBy("__c").agg(
        F.sum("__n").alias("__cn"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    # At most two times 710 e-folds of cells exist, whatever the data.
    cells = cells.withColumn("__a", F.coalesce(
        F.sum("__cn").over(preceding().orderBy("__c")), F.lit(0))).drop("__cn")
    fine = celled.join(cells, "__c").withColumn("__s", F.when(
        F.col("__lo") < F.col("__hi"), _sub_cell(F.col("__x"), F.col("__lo"), F.col("__hi")),
    ).otherwise(F.lit(0)))
    subs = fine.groupBy("__c", "__s").agg(F.sum("__n").alias("__sn"))
    subs = subs.withColumn("__b", F.coalesce(
        F.sum("__sn").over(preceding("__c").orderBy("__s")), F.lit(0))).drop("__sn")
    inside = F.coalesce(F.sum("__n").over(preceding("__c", "__s").orderBy("__x")), F.lit(0))
    return fine.join(subs, ["__c", "__s"]), F.col("__a") + F.col("__b") + inside


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman rho over the rows where both sides are known, with its t
    statistic and p-value.

    Rows are reduced to distinct pairs; deviations are from the mean rank, which
    is known exactly, so large ranks lose no digits.
    """
    pairs, _ = stored(
        df.select(clean(x).alias("x"), clean(y).alias("y")).na.drop()
        .groupBy("x", "y").agg(F.count("*").alias("n")))
    ranked = pairs
    for side in ("x", "y"):
        ranks, rows = average_ranks(pairs, side, "n")
        ranked = attach(ranked, ranks.withColumnRenamed("rank", f"r{side}"), [side])
    total = pairs.agg(F.sum("n").alias("t")).scalar()
    moved = ranked.select(
        F.col("n").cast("double").alias("n"),
        *[(F.col(f"r{s}") - (total + 1) / 2).alias(f"d{s}") for s in ("x", "y")])
    n, dx, dy = F.col("n"), F.col("dx"), F.col("dy")
    norm = F.sqrt(F.sum(n * dx * dx)) * F.sqrt(F.sum(n * dy * dy))
    rho = moved.agg(
        (F.sum(n * dx * dy) / F.nullif(norm, F.lit(0.0))).alias("r"),
        F.sum(n).cast("bigint").alias("rows"))
    return with_p_value(rho.withColumn("t", t_statistic(F.col("r"), F.col("rows"))))


def value_codes(df: DataFrame, column: str, name: str) -> DataFrame:
    """Codes 0, 1, ... of the sorted distinct values of a category column.

    The values are parted by ranges and stored, the partitions counted, and each value
    gets its place in its partition behind the values of all earlier ones.
    """
    distinct = df.where(F.col(column).isNotNull()).select(column).distinct()
    # One range a partition: equal parts of the order, none of them a single task's lot.
    parted = store(distinct.repartitionByRange(column).withColumn(
        "__part", F.spark_partition_id()))
    sizes = {r["__part"]: r["n"] for r in parted.groupBy("__part").agg(
        F.count("*").alias("n")).collect()}  # one row a partition
    before, total = [], 0
    for part in sorted(sizes):
        before.append((part, total))
        total += sizes[part]
    starts = df.sparkSession.createDataFrame(before, "__part int, __before long")
    place = F.row_number().over(Window.partitionBy("__part").orderBy(column)) - 1
    return parted.withColumn("__place", place).join(starts, "__part").select(
        column, (F.col("__before") + F.col("__place")).cast("int").alias(name))


def code_of(df: DataFrame, codes: DataFrame, column: str, name: str) -> DataFrame:
    """Attach fitted codes; values not seen at fitting get -1."""
    return attach(df, codes, [column]).withColumn(name, F.coalesce(name, F.lit(-1)))
