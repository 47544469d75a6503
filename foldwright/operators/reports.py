"""One-row nested reports. Every input has one row per feature, subset size or evaluation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.constants import EVAL_FOLD_PREFIX, EVAL_OOF, EVAL_TEST, METRIC_COLUMNS

REPORT_ROW = ("section", "name", "position", "text", "value")
REPORT_COUNTS = ("n_rows", "exact_duplicate_rows", "conflicting_label_vectors")


def records(df: DataFrame, order: Sequence[Column], columns: Sequence[str] | None = None) -> Column:
    """All rows of a small table as a sorted array of structs, as a scalar subquery."""
    columns = list(columns or df.columns)
    keyed = F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)], F.struct(*columns).alias("row"))
    return df.agg(F.transform(F.sort_array(F.collect_list(keyed)), lambda x: x["row"]).alias("rows")).scalar()


def texts(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def leakage_report(profile: DataFrame, drops: DataFrame, diagnostics: DataFrame, kept: Sequence[str],
                   mode: str) -> DataFrame:
    """Profile counts, every registry entry in force as a map, kept names, diagnostics strongest first."""
    entries = drops.agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("feature", F.struct("category", "reason"))))).alias("m")).scalar()
    return profile.select(
        F.lit(mode).alias("mode"), "n_rows", "exact_duplicate_rows", "conflicting_label_vectors",
        entries.alias("removed"), texts(kept).alias("kept"),
        records(diagnostics, [-F.col("single_feature_auc"), F.col("feature")]).alias("diagnostics"))


def selection_report(choice: DataFrame, ranking: DataFrame, curve: DataFrame, selected: Sequence[str],
                     dropped: Sequence[str], method: str) -> DataFrame:
    def point(name):
        return F.struct(F.col(f"{name}_n_features").alias("n_features"), F.col(f"{name}_cv_auc").alias("cv_auc"))

    return choice.select(
        F.lit(method).alias("method"), texts(selected).alias("selected_features"),
        texts(dropped).alias("dropped_features"), point("best").alias("best"), point("chosen").alias("chosen"),
        records(ranking, [F.col("rfe_rank")]).alias("ranking"),
        records(curve, [-F.col("n_features")], ["n_features", "auc_mean", "auc_se"]).alias("curve"))


def forest_report(spark: SparkSession, metrics: DataFrame, importance: DataFrame, selected: Sequence[str],
                  best_params: Mapping, cv_roc_auc: float, prefix: str = "reference: ") -> DataFrame:
    """Hold-out, pooled and fold records, importances and the comparison runs. Undefined is null, as JSON has no NaN."""
    fields = [*METRIC_COLUMNS, "confusion_matrix"]
    table = metrics.select("evaluation", F.struct(*fields).alias("record"))

    def one(name):
        return table.where(F.col("evaluation") == name).select("record").scalar()

    runs = table.where(F.col("evaluation").startswith(prefix)).agg(F.map_from_entries(F.collect_list(
        F.struct(F.expr(f"substring(evaluation, {len(prefix) + 1})"), F.col("record"))))).scalar()
    folds = metrics.select("evaluation", *fields).where(F.col("evaluation").startswith(EVAL_FOLD_PREFIX))
    weights = importance.agg(F.map_from_entries(F.transform(
        F.sort_array(F.collect_list(F.struct((-F.col("importance")).alias("_k"), "feature", "importance"))),
        lambda x: F.struct(x["feature"], x["importance"])))).scalar()
    params = F.struct(*[F.lit(v).alias(k) for k, v in best_params.items()])
    by_number = [F.length("evaluation"), F.col("evaluation")]
    return spark.range(1).select(
        texts(selected).alias("features"), params.alias("best_params"),
        F.lit(cv_roc_auc).alias("cv_roc_auc"), one(EVAL_TEST).alias("test"),
        one(EVAL_OOF).alias("train_cv_out_of_fold"), records(folds, by_number).alias("train_cv_folds"),
        weights.alias("feature_importance"), runs.alias("leakage_references"))


def leakage_report_rows(reports: DataFrame) -> DataFrame:
    """(section, name, position, text, value): a leakage report in a VARIANT column ``report``, one row per entry."""
    def rows(array: Column, row) -> Column:
        return F.transform(array, lambda x, k: F.struct(*[c.alias(n) for n, c in zip(REPORT_ROW, row(x, k))]))

    def field(value: Column, path: str, kind: str) -> Column:
        return F.variant_get(value, path, kind)

    none, report = F.lit(None), F.col("report")
    counts = rows(F.array(*[F.lit(c) for c in REPORT_COUNTS]), lambda x, k: (
        F.lit("profile"), x, none.cast("int"), none.cast("string"),
        F.try_element_at(F.array(*[field(report, f"$.{c}", "double") for c in REPORT_COUNTS]), k + 1)))
    removed = rows(F.map_entries(field(report, "$.removed", "map<string,variant>")), lambda x, k: (
        F.lit("removed"), x["key"], none.cast("int"),
        F.concat_ws(": ", field(x["value"], "$.category", "string"), field(x["value"], "$.reason", "string")), none.cast("double")))
    kept = rows(field(report, "$.kept", "array<string>"), lambda x, k: (
        F.lit("kept"), x, k.cast("int"), none.cast("string"), none.cast("double")))
    parts = [counts, removed, kept]
    for measure in ("single_feature_auc", "mutual_info"):
        parts.append(rows(field(report, "$.diagnostics", "array<variant>"), lambda x, k, measure=measure: (
            F.lit(measure), field(x, "$.feature", "string"), k.cast("int"),
            F.concat_ws("/", field(x, "$.documented_leaky", "string"), field(x, "$.suspicious", "string")), field(x, f"$.{measure}", "double"))))
    return reports.select(F.explode(F.concat(*parts)).alias("r")).select("r.*")


def selection_report_rows(reports: DataFrame) -> DataFrame:
    """(section, name, position, value): a selection report in a VARIANT column ``report``, one row per entry."""
    def field(value: Column, path: str, kind: str) -> Column:
        return F.variant_get(value, path, kind)

    def row(section: str, name: Column, position: Column, value: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), name.alias("name"), position.cast("int").alias("position"), value.cast("double").alias("value"))

    def texts_of(section: str) -> Column:
        return F.transform(field(report, f"$.{section}", "array<string>"), lambda x, k: row(section, x, k, F.lit(None)))

    def point(section: str) -> Column:
        return F.array(row(section, F.lit("cv_auc"), field(report, f"$.{section}.n_features", "int"),
                           field(report, f"$.{section}.cv_auc", "double")))

    def ranked(measure: str) -> Column:
        return F.transform(field(report, "$.ranking", "array<variant>"), lambda x: row(
            measure, field(x, "$.feature", "string"), field(x, "$.rfe_rank", "int"), field(x, f"$.{measure}", "double")))

    def curve(measure: str) -> Column:
        return F.transform(field(report, "$.curve", "array<variant>"), lambda x, k: row(
            measure, k.cast("string"), field(x, "$.n_features", "int"), field(x, f"$.{measure}", "double")))

    report = F.col("report")
    parts = [*map(texts_of, ("selected_features", "dropped_features")), *map(point, ("best", "chosen")),
             *map(ranked, ("initial_mean_abs_shap", "mutual_info")), *map(curve, ("auc_mean", "auc_se"))]
    return reports.select(F.explode(F.concat(*parts)).alias("r")).select("r.*")
