"""Session for local runs, and the shared scratch folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "foldwright") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The folder the cluster shares through ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: executors on other
    machines could not read it.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="foldwright-"))
        return context.getCheckpointDir()
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")


def in_parallel(spark: SparkSession, work: Callable, items: Sequence, parallelism: int) -> list:
    """Submit independent Spark jobs from a few driver threads; results keep the item order."""
    with ThreadPool(max(1, min(parallelism, len(items)))) as pool:
        return pool.map(inheritable_thread_target(spark)(work), items)


def tasks_for(spark: SparkSession, items: int, per_task: int) -> int:
    """Tasks for a small but compute-heavy table: by its size, up to the width of the session."""
    widest = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(1, min(widest, -(-items // per_task)))


# Folders of the runs that are under way, innermost last; tables written meanwhile lie below the last one.
_runs: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    folder = _runs[-1] if _runs else f"{scratch_dir(spark)}/foldwright"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def replace_path(spark: SparkSession, path: str, by: str) -> None:
    """Put a scratch file or folder in the place of another one, without reading it."""
    delete_path(spark, by)
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, by))
    if not source.getFileSystem(spark._jsc.hadoopConfiguration()).rename(source, target):
        raise OSError(f"{path} could not become {by}")


def delete_path(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder of any store that Spark writes to; False if there was none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch_run(spark: SparkSession, name: str = "run") -> Iterator[str]:
    """A folder of its own for the intermediate tables written inside the block, deleted when it ends, also by an error.

    Tables that read from it must be written elsewhere, or collected, before the block ends.
    """
    folder = scratch_path(spark, name)
    _runs.append(folder)
    try:
        yield folder
    finally:
        _runs.remove(folder)
        delete_path(spark, folder)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The copy cuts the lineage, outlives lost executors and keeps column pruning and
    partition pruning for every later read.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def small_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A few driver-side rows (names, parameters, fold scores) as a table without Python tasks."""
    fields = StructType.fromDDL(schema)
    records = [dict(zip(fields.names, row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(records, schema=to_arrow_schema(fields)), schema=fields)
