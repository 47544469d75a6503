"""Clean tables, prediction tables, summaries and reports as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foldwright.constants import EVAL_OOF, EVAL_TEST, METRIC_COLUMNS, METRIC_COUNTS, SPLIT
from foldwright.functions.columns import round_even
from foldwright.operators.metrics import summary_order
from foldwright.sources.publication import manifests, publish, published


def write_clean(clean: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Published as Parquet partitioned by split (so each side is pruned), or as CSV with a header."""
    publish(clean, path, fmt, [SPLIT] if fmt == "parquet" else [])


def load_clean(spark: SparkSession, path: str, schema: StructType | None = None, fmt: str = "parquet") -> DataFrame:
    """A clean table: the last published version, or plain files where nothing was published.

    Plain CSV without a schema costs one extra pass to infer the types.
    """
    if manifests(spark, path):
        return published(spark, path)
    if fmt == "csv":
        reader = spark.read.schema(schema) if schema else spark.read.option("inferSchema", True)
        return reader.csv(path, header=True)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    publish(predictions, path, "csv")


def six_decimals(summary: DataFrame) -> DataFrame:
    """The summary as text with six decimals; an undefined metric is an empty field."""
    return summary.select("evaluation", *[
        F.when(F.col(m).isNotNull(), F.format_string("%.6f", round_even(m, 6))).alias(m)
        for m in METRIC_COLUMNS])


def write_summary(summary: DataFrame, path: str) -> None:
    """Published as one file in the order of ``summary_order``; a summary has one row per evaluation."""
    publish(six_decimals(summary.coalesce(1).sortWithinPartitions(*summary_order())), path, "csv")


def write_report(report: DataFrame, path: str) -> None:
    """A one-row nested report as JSON; nulls are kept, parents are created, errors surface."""
    report.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_report(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A report. With the schema it was written with, undefined metrics keep their type."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("multiLine", True).json(path)


def read_variant(spark: SparkSession, path: str) -> DataFrame:
    """A report as one VARIANT column ``report``: every value keeps the type it has in the file, no schema is needed."""
    return spark.read.text(path).select(F.parse_json("value").alias("report"))


def metric_records(reports: DataFrame) -> DataFrame:
    """The typed metric records of forest reports read by ``read_variant``: hold-out, out-of-fold, folds, comparison runs."""
    def part(path: str, kind: str):
        return F.variant_get("report", path, kind)

    single = F.array(*[F.struct(F.lit(name).alias("evaluation"), part(f"$.{field}", "variant").alias("record"))
                       for name, field in ((EVAL_TEST, "test"), (EVAL_OOF, "train_cv_out_of_fold"))])
    folds = F.transform(part("$.train_cv_folds", "array<variant>"), lambda r: F.struct(
        F.variant_get(r, "$.evaluation", "string").alias("evaluation"), r.alias("record")))
    runs = F.transform(F.map_entries(part("$.leakage_references", "map<string,variant>")), lambda e: F.struct(
        F.concat(F.lit("reference: "), e["key"]).alias("evaluation"), e["value"].alias("record")))
    each = reports.select(F.explode(F.concat(single, folds, runs)).alias("r")).select("r.evaluation", "r.record")
    return each.select("evaluation", *[F.variant_get("record", f"$.{m}", "long" if m in METRIC_COUNTS else "double").alias(m)
                                       for m in METRIC_COLUMNS])


def parameters(reports: DataFrame) -> DataFrame:
    """(name, kind, value): the parameters of forest reports read by ``read_variant`` with the type each has; value as text."""
    entries = F.explode(F.map_entries(F.variant_get("report", "$.best_params", "map<string,variant>"))).alias("e")
    return reports.select(entries).select(F.col("e.key").alias("name"), F.schema_of_variant("e.value").alias("kind"),
                                          F.variant_get("e.value", "$", "string").alias("value"))
