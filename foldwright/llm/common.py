"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.session import materialize, scratch_path

__all__ = ["bounded_batches", "bounded_sample", "broadcast_within", "free_name", "materialize", "scratch_path", "small_enough", "table"]

#: Rows of a narrow table that may be broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes of a table that may be broadcast when its values are of any length.
BROADCAST_BYTES = 32 << 20
#: Rows and bytes of one Arrow batch: long texts must not pile up in a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold at most ``BATCH_ROWS`` rows and about ``BATCH_BYTES``."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or that name with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def bounded_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """At most ``rows`` rows of ``df`` by a hash of ``keys``; all of them if ``df`` has no more.

    A threshold on the hash leaves about four times as many before the cut, so that tasks send few to the driver.
    """
    total = df.count()
    draw = free_name(df, "draw")
    drawn = df.withColumn(draw, F.pmod(F.xxhash64(*keys), F.lit(1 << 40)))
    if total > 4 * rows:
        drawn = drawn.where(F.col(draw) < (4 * rows << 40) // total)
    return drawn.orderBy(draw, *keys).limit(rows).drop(draw)


def small_enough(df: DataFrame) -> DataFrame:
    """``df``, a written table of a few narrow columns, marked for broadcast if it has at most ``BROADCAST_ROWS`` rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def broadcast_within(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, a written table, marked for broadcast if its values as text, with 16 bytes for each, are within ``limit`` bytes."""
    each = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in df.columns]
    size = df.agg(F.sum(sum(each[1:], each[0]).cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df
