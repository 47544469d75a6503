"""Dense attribute-relation text files of small integers."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from foldwright.constants import ROW
from foldwright.session import materialize

# Blocks up to this number are numbered through a broadcast (16 bytes each).
BROADCAST_BLOCKS = 1_000_000


def attribute_names(spark: SparkSession, path: str) -> list[str]:
    """Attribute names in header order. Reads lines from the front until the data marker."""
    lines, wanted = [], 64
    while True:
        got = [r.value.strip() for r in spark.read.text(path).take(wanted)]
        if len(got) == len(lines) or any(g.lower() == "@data" for g in got):
            break
        lines, wanted = got, wanted * 2
    names = []
    for line in got:
        if line.lower() == "@data":
            break
        m = re.match(r"""@attribute\s+(?:'([^']+)'|"([^"]+)"|(\S+))""", line, re.IGNORECASE)
        if m:
            names.append(next(g for g in m.groups() if g))
    return names


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its file, its block and a running id."""
    return spark.read.text(path).select(
        F.col("value"), F.trim("value").alias("line"),
        F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("_block"),
        F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_place"))


def _offsets(lines: DataFrame, place: str, by: Sequence[str] = ()) -> DataFrame:
    """(_block, _first, _offset): the first id of each block, and the lines in the blocks before it within ``by``."""
    blocks = lines.groupBy("_block", "_path", "_start").agg(F.count(F.lit(1)).alias("rows"), F.min(place).alias("_first"))
    before = Window.partitionBy(*by or [F.lit(1)]).orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("_block", "_first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_offset"))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """The data lines with their ``row_index`` in file order.

    The row number is the number of data rows in earlier blocks plus the place within the block, so the text is
    neither sorted nor collected into one task.
    """
    lines = _lines(spark, path)
    # A data row's place counts data rows only, so the running id is taken after the filter.
    data = lines.where((F.col("line") != "") & ~F.col("line").rlike("^[%@]")).withColumn("_id", F.monotonically_increasing_id())
    offsets = _offsets(data, "_id")
    if data.rdd.getNumPartitions() + len(data.inputFiles()) <= BROADCAST_BLOCKS:
        offsets = F.broadcast(offsets)
    return data.join(offsets, "_block").withColumn(ROW, F.col("_offset") + F.col("_id") - F.col("_first")).drop(
        "_offset", "_first", "_id")


def _field(i: int) -> Column:
    return F.trim(F.translate(F.get(F.split("line", r"\s*,\s*"), F.lit(i)), "'\"", ""))


def load_ternary(spark: SparkSession, path: str) -> DataFrame:
    """All attributes as tinyint plus a 0-based ``row_index`` in file order; a value that is none is an error.

    ``path`` is one file or a folder of files with the same header.
    """
    names = attribute_names(spark, path)
    return _numbered(spark, path).select(ROW, *[_field(i).cast("tinyint").alias(n) for i, n in enumerate(names)])


@dataclass(frozen=True)
class Loaded:
    """The good rows, the bad lines (file, line, text) and how many there are of each."""

    rows: DataFrame
    bad: DataFrame
    n_rows: int
    n_bad: int


def load_checked(spark: SparkSession, path: str) -> Loaded:
    """The same where lines may be bad: with another number of fields than attributes, or a value that is no tinyint.

    Good and bad lines are written and counted in one pass. Rows keep the place that they have among all data lines. Only if
    there are bad lines, the lines of the files are counted once more to number them, from 1.
    """
    names = attribute_names(spark, path)
    values = [F.expr(f"try_cast(_f{i} AS tinyint)").alias(n) for i, n in enumerate(names)]
    cut = _numbered(spark, path).select("*", *[_field(i).alias(f"_f{i}") for i in range(len(names))],
                                        F.size(F.split("line", ",")).alias("_fields"))
    read = cut.select(ROW, "_path", "_start", "_block", "_place", F.col("value").alias("_text"), "_fields", *values)
    is_bad = (F.col("_fields") != len(names)) | F.greatest(*[F.col(f"`{n}`").isNull().cast("int") for n in names], F.lit(0)).cast("boolean")
    marked = read.withColumn("_bad", is_bad).withColumn("_text", F.when(F.col("_bad"), F.col("_text")))
    seen = Observation()
    stored = materialize(marked.observe(seen, F.count(F.lit(1)).alias("lines"), F.count_if("_bad").alias("bad")), "loaded", ["_bad"])
    counts = seen.get
    bad = stored.where("_bad")
    if counts["bad"]:
        number = F.col("_offset") + F.col("_place") - F.col("_first") + 1
        bad = bad.join(_offsets(_lines(spark, path), "_place", ["_path"]), "_block").withColumn("line", number)
    else:
        bad = bad.withColumn("line", F.lit(0).cast("long"))
    return Loaded(stored.where("NOT _bad").select(ROW, *[f"`{n}`" for n in names]),
                  bad.select(F.col("_path").alias("file"), "line", F.col("_text").alias("text")),
                  counts["lines"] - counts["bad"], counts["bad"])


def write_ternary(df: DataFrame, path: str, relation: str, row: str = ROW, files: int | None = None) -> None:
    """Small-integer columns as attribute-relation files in the order of ``row``, each file with the header."""
    names = [c for c in df.columns if c != row]
    header = [f"@relation {relation}", "", *[f"@attribute '{n}' {{ -1,0,1 }}" for n in names], "", "@data"]

    def with_header(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": header})
        yield from batches

    lines = F.concat_ws(",", *[F.col(f"`{n}`").cast("string") for n in names]).alias("value")
    ordered = df.repartitionByRange(*([files] if files else []), row).sortWithinPartitions(row).select(lines)
    ordered.mapInPandas(with_header, "value string").write.mode("overwrite").text(path)
