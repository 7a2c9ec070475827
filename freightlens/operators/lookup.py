"""Attaching lookup tables to facts.

A lookup table has one row per key. It is stored before it is joined, so that its
size is known to the optimizer.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freightlens.session import store


def dimension(spark: SparkSession, values: Mapping, key: str, name: str) -> DataFrame:
    """A literal dictionary as a two-column table."""
    return spark.createDataFrame([(k, v) for k, v in values.items()], [key, name])


def literal_map(key, values: Mapping) -> Column:
    """Look ``key`` up in a literal dictionary inside the expression: no join.
    The dictionary is part of the program, so its size does not grow with data."""
    column = F.col(key) if isinstance(key, str) else key
    entries = [F.lit(part) for pair in values.items() for part in pair]
    return F.try_element_at(F.create_map(*entries), column) if entries else F.lit(None)


def pair_map(left, right, pairs: Mapping[str, Sequence[str]]) -> Column:
    """Whether ``right`` is listed under ``left`` in a literal dictionary."""
    entries = []
    for key, members in pairs.items():
        entries += [F.lit(key), F.array(*[F.lit(m) for m in members])]
    listed = F.try_element_at(F.create_map(*entries), F.col(left))
    return F.array_contains(listed, F.col(right))


MOST_BROADCAST = 48 << 20  # bytes of a lookup table in memory


def is_small(table: DataFrame, rows: int) -> bool:
    """Whether ``rows`` rows of ``table`` may be broadcast, by their size in memory."""
    return rows * (8 + table._jdf.schema().defaultSize()) <= MOST_BROADCAST


def attach(
    fact: DataFrame, table: DataFrame, keys: Sequence[str], rows: int | None = None
) -> DataFrame:
    """Left join of a lookup table. Spark broadcasts the table if its size allows, and
    adaptive execution splits the partitions of hot keys otherwise, so the fact is
    read once however many lookups are stacked. With its number of ``rows`` a table is
    also broadcast up to ``MOST_BROADCAST``, which spares moving the fact."""
    if rows is not None and is_small(table, rows):
        table = F.broadcast(table)
    return fact.join(table, list(keys), "left")


def _all_known(keys: Sequence[str]) -> Column:
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    return known


def stored(table: DataFrame) -> tuple[DataFrame, int]:
    """A table written to the checkpoint folder, and its row count."""
    kept = store(table)
    return kept, kept.count()


def attach_aggregate(fact: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Give every row the aggregates of its group.

    The groups are reduced first and joined back, not gathered in a window: a
    window would bring all rows of a hot group into one task.
    """
    keys = list(keys)
    table, rows = stored(fact.where(_all_known(keys)).groupBy(*keys).agg(*aggregates))
    return attach(fact, table, keys, rows)
