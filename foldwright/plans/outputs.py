"""Write the tables of the three steps below one folder, one sub-folder per artifact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foldwright.operators.metrics import metrics_display
from foldwright.operators.reports import forest_report, leakage_report, selection_report
from foldwright.plans.audit import Audit
from foldwright.plans.evaluate import Evaluation
from foldwright.plans.select import Selection
from foldwright.sources.models import save_model
from foldwright.sources.tables import write_clean, write_predictions, write_report, write_summary

# Artifact names.
CLEAN, LEAKAGE, SELECTION = "clean_dataset", "leakage_report", "selected_features"
TEST_PREDICTIONS, OOF_PREDICTIONS = "rf_test_predictions", "rf_train_oof_predictions"
MODEL, METRICS, SUMMARY, DISPLAY, CLASS_REPORT = (
    "random_forest", "rf_metrics", "rf_metrics_summary", "rf_results_report", "rf_class_report")
METHOD = "SHAP-based RFE, random forest, 5-fold StratifiedGroupKFold, 1-SE rule"


def write_audit(audit: Audit, folder: str, mode: str = "default", fmt: str = "parquet") -> None:
    write_clean(audit.clean, f"{folder}/{CLEAN}", fmt)
    write_report(leakage_report(audit.profile, audit.drops, audit.diagnostics, audit.kept_names, mode),
                 f"{folder}/{LEAKAGE}")


def write_selection(selection: Selection, folder: str) -> None:
    write_report(selection_report(selection.choice, selection.ranking, selection.curve, selection.selected,
                                  selection.dropped, METHOD), f"{folder}/{SELECTION}")


def write_evaluation(spark: SparkSession, result: Evaluation, folder: str) -> None:
    save_model(spark, result.model, f"{folder}/{MODEL}")
    write_predictions(result.test_predictions, f"{folder}/{TEST_PREDICTIONS}")
    write_predictions(result.oof_predictions, f"{folder}/{OOF_PREDICTIONS}")
    write_report(forest_report(spark, result.metrics, result.importance, result.features, result.best_params,
                               result.cv_roc_auc), f"{folder}/{METRICS}")
    write_summary(result.summary, f"{folder}/{SUMMARY}")
    _write_csv(metrics_display(result.summary), f"{folder}/{DISPLAY}")
    _write_csv(result.class_report, f"{folder}/{CLASS_REPORT}")


def _write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)
