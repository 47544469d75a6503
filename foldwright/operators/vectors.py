"""Distinct feature vectors with multiplicity, their groups, and lookups back onto rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.constants import GROUP, LABEL, ROW
from foldwright.functions.columns import group_key

# Rows that one task should hold of a single group.
HOT_ROWS = 5_000_000

# Hot keys that may be broadcast.
HOT_KEYS = 100_000


def with_group_id(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumn(GROUP, group_key(features))


def count_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row count ``n`` and positives ``pos`` per key. Copies collapse map-side, so a key that
    fills a third of the table shuffles as one row per map task."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(LABEL).cast("long")).alias("pos"))


def vector_table(df: DataFrame, features: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """One row per distinct full vector (and ``extra`` tag) with ``n``, ``pos`` and the group key,
    which is hashed once per vector, not once per row."""
    return count_rows(df, [*features, *extra]).withColumn(GROUP, group_key(features))


def group_table(vectors: DataFrame) -> DataFrame:
    """One row per group key. Two vectors may share a 48-bit key, so this is its own aggregate."""
    return vectors.groupBy(GROUP).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def attach_by_group(rows: DataFrame, lookup: DataFrame, columns: Sequence[str], on: Sequence[str] = (GROUP,),
                    hot_rows: int = HOT_ROWS, row_key: str = ROW) -> DataFrame:
    """Inner join ``columns`` of a lookup (one row per ``on`` key, with its row count ``n``) onto rows.

    A key with more than ``hot_rows`` rows is dealt over ceil(n / hot_rows) salted copies of
    its lookup row. Those keys, fewer than rows / hot_rows, are counted: up to ``HOT_KEYS`` are
    broadcast, more are joined by a shuffle that splits skewed keys at run time.
    """
    parts = F.ceil(F.col("n") / F.lit(hot_rows)).cast("int")
    hot = lookup.where(F.col("n") > hot_rows).select(*on, parts.alias("_parts"))
    hot = F.broadcast(hot) if hot.count() <= HOT_KEYS else hot
    salted = rows.join(hot, list(on), "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(row_key), F.col("_parts")).cast("int"), F.lit(0)))
    copies = lookup.select(*on, *columns, F.explode(F.sequence(F.lit(0), parts - 1)).alias("_salt"))
    return salted.join(copies, [*on, "_salt"]).select(*rows.columns, *columns)
