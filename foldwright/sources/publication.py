"""Published tables: the data is written first, a manifest that names it last.

A published table is a folder with one sub-folder of files per version below ``data`` and one manifest per version below
``manifests``. Readers follow the manifest with the greatest version, so they see the old version until the new one
is whole, and a run that was cut off leaves files that no manifest names. Nothing is renamed, which stores of objects
cannot do at once. Two writers of one version cannot both succeed: the second manifest finds its folder taken.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foldwright.session import delete_path, small_table

MANIFEST = "folder string, format string, files bigint, bytes bigint, rows bigint, checksum bigint, layout string"
# Versions that stay when a new one is published: readers of the last one may still be at work.
KEPT_VERSIONS = 2


def _checksum(columns: Sequence[str]):
    """Exclusive or of the hash of every row's values as text, so that it is the same in every format."""
    texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns]
    return F.coalesce(F.bit_xor(F.xxhash64(*texts)), F.lit(0).cast("long"))


def manifests(spark: SparkSession, path: str) -> list[Row]:
    """The manifests of all versions, oldest first; a table has few. None if nothing was published."""
    try:
        found = spark.read.schema(f"{MANIFEST}, version int").json(f"{path}/manifests").collect()
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    return sorted(found, key=lambda r: r.version)


def publish(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
            keep: int = KEPT_VERSIONS) -> Row:
    """Write ``df`` as the next version of the table at ``path`` and return its manifest.

    Rows and checksum are counted while the rows are written, files and bytes are read off what was written. Versions before the
    last ``keep`` are deleted, manifest first.
    """
    spark = df.sparkSession
    before = manifests(spark, path)
    version = before[-1].version + 1 if before else 1
    folder = f"data/{version}-{uuid.uuid4().hex}"
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows"), _checksum(df.columns).alias("checksum")).write
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    writer.format(fmt).option("header", True).save(f"{path}/{folder}")
    files = (_reader(spark, fmt).schema(df.schema).load(f"{path}/{folder}").select("_metadata.file_path", "_metadata.file_size").distinct()
             .agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes")).first())
    record = (folder, fmt, files.files, files.bytes, seen.get["rows"], seen.get["checksum"], df.schema.json())
    small_table(spark, [record], MANIFEST).coalesce(1).write.mode("error").json(f"{path}/manifests/version={version}")
    for old in before[:max(0, len(before) + 1 - keep)]:
        delete_path(spark, f"{path}/manifests/version={old.version}")
        delete_path(spark, f"{path}/{old.folder}")
    return manifests(spark, path)[-1]


def _reader(spark: SparkSession, fmt: str) -> DataFrameReader:
    return spark.read.format(fmt).option("header", True)


def published(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The last version of a published table, or the one asked for, with the types it was written with."""
    found = [m for m in manifests(spark, path) if version in (None, m.version)]
    if not found:
        raise FileNotFoundError(f"nothing published at {path}" + (f" as version {version}" if version else ""))
    schema = StructType.fromJson(json.loads(found[-1].layout))
    return _reader(spark, found[-1].format).schema(schema).load(f"{path}/{found[-1].folder}").select(*schema.names)


def is_whole(spark: SparkSession, path: str) -> bool:
    """Whether the last version holds the rows that its manifest counts."""
    last = manifests(spark, path)[-1]
    df = published(spark, path)
    got = df.agg(F.count(F.lit(1)).alias("rows"), _checksum(df.columns).alias("checksum")).first()
    return (got.rows, got.checksum) == (last.rows, last.checksum)
