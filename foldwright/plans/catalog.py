"""Every registered query: a callable (spark, sf_dir) -> DataFrame over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from foldwright.constants import (EVAL_FOLD_PREFIX, EVAL_OOF, EVAL_TEST, GROUP, LABEL, N_FOLDS, ROW, SEARCH_DRAWS, SEARCH_SPACE,
                                  SELECTION_FOREST, SPLIT, TARGET)
from foldwright.functions.columns import label_from_target, round_even
from foldwright.operators import cube as C
from foldwright.operators import folds as FO
from foldwright.operators import forest as R
from foldwright.operators import leakage as L
from foldwright.operators import metrics as M
from foldwright.operators import profile as P
from foldwright.operators import reports, sketches
from foldwright.operators import vectors as V
from foldwright.operators.predictions import prediction_table
from foldwright.operators.rate_model import TargetRates, TargetRatesModel
from foldwright.operators.weights import class_weights
from foldwright.plans import audit, rates
from foldwright.plans import evaluate as E
from foldwright.plans import select as S
from foldwright.session import materialize, scratch_path, small_table
from foldwright.sources import attributes, tables
from foldwright.sources.orders import FEATURES, KEPT, LEAKY, PAGE, labelled, ternary_features
from foldwright.sources.publication import published
from foldwright.sources.tables import six_decimals


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[round_even(f.name, digits).alias(f.name) if isinstance(f.dataType, DoubleType)
                       else f.name for f in df.schema])


# Shared steps -----------------------------------------------------------------------------

def _vectors(spark, d):
    return V.vector_table(labelled(spark, d), FEATURES)


def _groups(spark, d):
    return V.group_table(_vectors(spark, d))


def _folds(spark, d):
    return FO.deal_folds(_groups(spark, d), 5)


def _folded(spark, d):
    return audit.tag_folds(_vectors(spark, d))


def _cube(spark, d):
    return C.contingency_cube(_folded(spark, d), FEATURES)


def _diagnostics(spark, d):
    return L.diagnostics(_cube(spark, d), L.registry(spark, LEAKY, PAGE))


def _drops(spark, url_only=False):
    return L.drop_set(L.registry(spark, LEAKY, PAGE), url_only)


def _rows(spark, d):
    return materialize(labelled(spark, d), "rows")


def _rows_with(spark, d, tag):
    """Stored rows, and the groups of their vectors tagged by ``tag``, joined by group key."""
    rows = _rows(spark, d)
    groups = materialize(tag(V.group_table(V.vector_table(rows, FEATURES))), "groups")
    columns = [c for c in groups.columns if c not in (GROUP, "n", "pos")]
    return V.attach_by_group(V.with_group_id(rows, FEATURES), groups, columns)


def _scored_vectors(spark, d):
    folded = materialize(_folded(spark, d), "folds")
    return C.out_of_fold_score(folded, C.out_of_fold_rates(C.contingency_cube(folded, FEATURES)), KEPT)


def _counts(spark, d):
    scored = _scored_vectors(spark, d).withColumn("cv_fold", F.col("fold") + 1)
    return M.fold_and_pooled(M.vector_score_counts(scored, ["cv_fold"]))


def _stored_counts(spark, d):
    return materialize(_counts(spark, d), "score-counts")


def _summary(spark, d):
    return M.metrics_summary(rates.evaluate_rates(_rows(spark, d), FEATURES, KEPT))


# Queries ----------------------------------------------------------------------------------

def label_encode(spark, d):
    return ternary_features(spark, d).select(ROW, TARGET, label_from_target().alias(LABEL))


def group_id(spark, d):
    return V.with_group_id(ternary_features(spark, d), FEATURES).select(ROW, GROUP)


def dup_stats(spark, d):
    return P.profile(_vectors(spark, d))


def duplicate_rows(spark, d):
    return P.duplicate_rows(labelled(spark, d), FEATURES)


def conflict_vectors(spark, d):
    return P.conflict_groups(_groups(spark, d))


def row_folds(spark, d):
    return _rows_with(spark, d, lambda g: FO.deal_folds(g, 5)).select(ROW, GROUP, LABEL, "fold")


def split_audit(spark, d):
    return P.split_audit(FO.holdout_groups(_groups(spark, d), 5))


def group_overlap(spark, d):
    split = rates.split_vectors(labelled(spark, d), FEATURES)
    return P.shared_keys(split, FEATURES, "full vector").unionByName(
        P.shared_keys(split, KEPT, "kept features"))


def stratified_random_split(spark, d):
    return FO.random_holdout(materialize(labelled(spark, d).select(ROW, LABEL), "rows"))


def mutual_information(spark, d):
    return rounded(C.mutual_information(C.contingency_cube(_vectors(spark, d), FEATURES, tags=())))


def single_feature_auc(spark, d):
    return rounded(C.single_feature_auc(C.out_of_fold_rates(_cube(spark, d))))


def kept_features(spark, d, url_only=False):
    return rounded(L.kept_features(_diagnostics(spark, d), _drops(spark, url_only), FEATURES))


def removed_features(spark, d, url_only=False):
    return rounded(L.removed_features(_diagnostics(spark, d), _drops(spark, url_only)))


def _held_rows(spark, d):
    return _rows_with(spark, d, lambda g: FO.holdout_groups(g, 5))


def clean_dataset(spark, d):
    return _held_rows(spark, d).select(ROW, *KEPT, LABEL, GROUP, SPLIT)


def clean_dataset_url_only(spark, d):
    kept = [f for f in KEPT if f not in PAGE]
    return _held_rows(spark, d).select(ROW, *kept, LABEL, GROUP, SPLIT)


def _scored_rows(spark, d):
    rows = _rows(spark, d)
    folded = audit.stored_folds(rows, FEATURES)
    rated = C.out_of_fold_rates(C.contingency_cube(folded, FEATURES))
    tagged = V.attach_by_group(V.with_group_id(rows, FEATURES), audit.group_columns(folded, ["fold"]), ["fold"])
    return C.out_of_fold_score(tagged, rated, KEPT)


def oof_score(spark, d):
    return _scored_rows(spark, d).select(ROW, GROUP, LABEL, "fold", "score")


def predictions(spark, d):
    scored = _scored_rows(spark, d).withColumn("cv_fold", F.col("fold") + 1)
    return prediction_table(scored, KEPT, "train_oof", ["cv_fold"])


def test_predictions(spark, d):
    """Hold-out rows scored by the rates of the train vectors; one broadcast row, no shuffle of the rows."""
    clean = materialize(clean_dataset(spark, d), "clean", [SPLIT])
    train = V.count_rows(clean.where(F.col(SPLIT) == "train"), KEPT)
    scored = C.held_out_score(clean.where(F.col(SPLIT) == "test"), C.contingency_cube(train, KEPT, tags=()), KEPT)
    return prediction_table(scored, KEPT, "test")


def confusion_matrix(spark, d):
    return M.confusion_matrix(_counts(spark, d)).drop("confusion_matrix")


def threshold_metrics(spark, d):
    return rounded(M.threshold_metrics(M.confusion_matrix(_counts(spark, d))))


def roc_auc(spark, d):
    return rounded(M.ranking_metrics(_stored_counts(spark, d)).select("evaluation", "roc_auc"))


def average_precision(spark, d):
    return rounded(M.ranking_metrics(_stored_counts(spark, d)).select("evaluation", "pr_auc"))


def class_report(spark, d):
    return rounded(M.class_report(M.confusion_matrix(_counts(spark, d))))


def _fold_metrics(spark, d):
    metrics = M.compute_metrics(_stored_counts(spark, d)).drop("confusion_matrix")
    return metrics.where(F.col("evaluation").startswith(EVAL_FOLD_PREFIX))


def metrics_summary_text(spark, d):
    return six_decimals(_summary(spark, d))


def leakage_report(spark, d):
    """The audit as one nested row."""
    folded = materialize(_folded(spark, d), "folds")
    diag = materialize(L.diagnostics(C.contingency_cube(folded, FEATURES), L.registry(spark, LEAKY, PAGE)), "diagnostics")
    return reports.leakage_report(P.profile(folded), _drops(spark), diag, KEPT, "default")


def selection_report(spark, d):
    """The mean-rate selection as one nested row."""
    curve, choice, ranking = rates.select_by_rates(labelled(spark, d), FEATURES, KEPT)
    ranking = materialize(ranking, "ranking")
    # One row per feature: names for the header of the report.
    names = {r.feature for r in ranking.where("selected").select("feature").collect()}
    return reports.selection_report(choice, ranking, curve, [f for f in KEPT if f in names],
                                    [f for f in KEPT if f not in names], "mean-rate RFE, 5 group folds, 1-SE rule")


# Files: written whole, read back ---------------------------------------------------------------

def attribute_file(spark, d):
    path = scratch_path(spark, "attributes")
    attributes.write_ternary(ternary_features(spark, d), path, "orders")
    return attributes.load_ternary(spark, path)


def _clean_file(fmt):
    def run(spark, d):
        path = scratch_path(spark, "clean-files")
        tables.write_clean(clean_dataset(spark, d), path, fmt)
        return tables.load_clean(spark, path)
    return run


def prediction_files(spark, d):
    path = scratch_path(spark, "prediction-files")
    tables.write_predictions(predictions(spark, d), path)
    return published(spark, path)


def summary_file(spark, d):
    path = scratch_path(spark, "summary-file")
    tables.write_summary(_summary(spark, d), path)
    return published(spark, path)


def _reread(report, name):
    path = scratch_path(report.sparkSession, name)
    tables.write_report(report, path)
    return tables.read_variant(report.sparkSession, path)


def forest_report_metrics(spark, d):
    """Metric records of the mean-rate score, written as a forest report and read back as VARIANT."""
    metrics = materialize(rates.evaluate_rates(_rows(spark, d), FEATURES, KEPT), "metrics")
    importance = small_table(spark, [(f, 1.0 / len(KEPT)) for f in KEPT], "feature string, importance double")
    report = reports.forest_report(spark, metrics, importance, KEPT, {"score": "mean rate", "folds": N_FOLDS}, 0.5)
    return rounded(tables.metric_records(_reread(report, "forest-report")))


def leakage_report_entries(spark, d):
    return rounded(reports.leakage_report_rows(_reread(leakage_report(spark, d), "leakage-report")))


def selection_report_entries(spark, d):
    return rounded(reports.selection_report_rows(_reread(selection_report(spark, d), "selection-report")))


def saved_rates(spark, d):
    folded = materialize(_folded(spark, d), "folds")
    path = scratch_path(spark, "saved-rates")
    TargetRates(features=FEATURES).fit(folded).save(path)
    return rounded(TargetRatesModel.load(path).rates())


def saved_rates_predictions(spark, d):
    """Hold-out rows scored by the saved and reloaded rates of the train vectors."""
    clean = materialize(clean_dataset(spark, d), "clean", [SPLIT])
    train = V.count_rows(clean.where(F.col(SPLIT) == "train"), KEPT).withColumn("fold", F.lit(0))
    path = scratch_path(spark, "saved-rates")
    TargetRates(features=KEPT).fit(train).save(path)
    return prediction_table(TargetRatesModel.load(path).transform(clean.where(F.col(SPLIT) == "test")), KEPT, "test")


def sketched_ranking(spark, d):
    """Ranking metrics from summaries of each fold that are merged for the pooled evaluation."""
    scored = _scored_vectors(spark, d).withColumn("cv_fold", F.col("fold") + 1)
    folds = materialize(sketches.score_sketch(M.vector_score_counts(scored, ["cv_fold"]), ["cv_fold"]), "sketches")
    tags = F.array(F.lit(EVAL_OOF), F.concat(F.lit(EVAL_FOLD_PREFIX), F.col("cv_fold").cast("string")))
    each = folds.select(F.explode(tags).alias("evaluation"), "bucket", "pos", "neg")
    return rounded(sketches.sketched_ranking(sketches.merged(each)))


def _selection(part):
    def run(spark, d):
        return rounded(rates.select_by_rates(labelled(spark, d), FEATURES, KEPT)[part])
    return run


def sql_checked() -> dict:
    return {
        "ternary_features": ternary_features,
        "label_encode": label_encode,
        "group_id": group_id,
        "dup_stats": dup_stats,
        "duplicate_rows": duplicate_rows,
        "conflict_vectors": conflict_vectors,
        "class_counts": lambda s, d: P.class_counts(labelled(s, d)),
        "class_weights": lambda s, d: rounded(class_weights(P.class_counts(labelled(s, d)))),
        "group_folds": _folds,
        "row_folds": row_folds,
        "fold_balance": lambda s, d: rounded(P.fold_balance(_folds(s, d))),
        "group_holdout": lambda s, d: FO.holdout_groups(_groups(s, d), 5),
        "split_audit": split_audit,
        "group_overlap": group_overlap,
        "stratified_random_split": stratified_random_split,
        "contingency_cube": _cube,
        "mutual_information": mutual_information,
        "oof_target_rate": lambda s, d: rounded(C.out_of_fold_rates(_cube(s, d))),
        "single_feature_auc": single_feature_auc,
        "leakage_diagnostics": lambda s, d: rounded(_diagnostics(s, d)),
        "removed_features": removed_features,
        "removed_features_url_only": lambda s, d: removed_features(s, d, True),
        "kept_features": kept_features,
        "kept_features_url_only": lambda s, d: kept_features(s, d, True),
        "flagged_kept": lambda s, d: rounded(L.flagged_kept(_diagnostics(s, d), _drops(s))),
        "clean_dataset": clean_dataset,
        "clean_dataset_url_only": clean_dataset_url_only,
        "oof_score": oof_score,
        "prediction_table": predictions,
        "test_prediction_table": test_predictions,
        "confusion_matrix": confusion_matrix,
        "threshold_metrics": threshold_metrics,
        "roc_auc": roc_auc,
        "average_precision": average_precision,
        "log_loss_brier": lambda s, d: rounded(M.losses(_counts(s, d))),
        "class_report": class_report,
        "fold_metrics": lambda s, d: rounded(_fold_metrics(s, d)),
        "fold_mean_std": lambda s, d: rounded(M.fold_statistics(_fold_metrics(s, d))),
        "metrics_summary": lambda s, d: rounded(_summary(s, d)),
        "metrics_summary_text": metrics_summary_text,
        "metrics_display": lambda s, d: M.metrics_display(_summary(s, d)),
        "selection_curve": _selection(0),
        "one_se_choice": _selection(1),
        "feature_ranking": _selection(2),
        "attribute_file": attribute_file,
        "clean_file_csv": _clean_file("csv"),
        "clean_file_parquet": _clean_file("parquet"),
        "prediction_files": prediction_files,
        "summary_file": summary_file,
        "forest_report_metrics": forest_report_metrics,
        "leakage_report_entries": leakage_report_entries,
        "selection_report_entries": selection_report_entries,
        "saved_rates": saved_rates,
        "saved_rates_predictions": saved_rates_predictions,
        "sketched_ranking": sketched_ranking,
    }


# Learned models: whole tables, forests of the size that the selection uses ------------------

# Rows that stand for the copies of one (vector, label) pair in the fits of the elimination, which keep the weight of all.
ELIMINATION_COPIES = 32

TRIAL = {"n_estimators": SELECTION_FOREST["numTrees"], "max_depth": SELECTION_FOREST["maxDepth"],
         "max_features": SELECTION_FOREST["featureSubsetStrategy"], "criterion": "gini"}


def _clean(spark, d):
    return materialize(clean_dataset(spark, d), "clean", [SPLIT])


def _train_vectors(spark, d):
    """Fold-tagged vectors of the train side, straight from the split vector table."""
    train = rates.split_vectors(labelled(spark, d), FEATURES).where(F.col(SPLIT) == "train").drop(SPLIT)
    return materialize(audit.tag_folds(train), "train-vectors", ["fold"])


def forest_fold_auc(spark, d):
    vectors = _train_vectors(spark, d)
    return R.fold_aucs(R.fit_folds(vectors, KEPT, SELECTION_FOREST, range(5)), vectors)


def mean_abs_contribution(spark, d):
    return S.cv_step(_train_vectors(spark, d), KEPT, SELECTION_FOREST, range(5))[1]


def forest_importance(spark, d):
    return R.feature_importance(spark, R.fit_forest(_train_vectors(spark, d), KEPT, R.spark_params(TRIAL)[0]))


def forest_test_predictions(spark, d):
    clean = _clean(spark, d)
    train = V.count_rows(clean.where(F.col(SPLIT) == "train"), KEPT)
    model = R.fit_forest(train, KEPT, R.spark_params(TRIAL)[0])
    return E.test_predictions(clean, model, KEPT)


def forest_oof_predictions(spark, d):
    clean = _clean(spark, d)
    vectors = S.train_vectors(clean, KEPT)
    models = R.fit_folds(vectors, KEPT, R.spark_params(TRIAL)[0], range(5))
    return E.oof_predictions(clean, materialize(R.score_folds(models, vectors), "oof-scores"), KEPT)


def leakage_comparison(spark, d):
    rows = _rows(spark, d)
    split = rates.split_vectors(rows, FEATURES)
    counts = E.leakage_runs(rows, split, FEATURES, KEPT, TRIAL).unionByName(
        E.reference_run(split, KEPT, TRIAL, EVAL_TEST))
    return rounded(M.compute_metrics(materialize(counts, "score-counts")).drop("confusion_matrix"))


def rfe_history(spark, d):
    """Every step of the elimination with the forest of the selection: an AUC per subset and fold, and what it drops."""
    steps = S.eliminate(_train_vectors(spark, d), KEPT, SELECTION_FOREST, copies=ELIMINATION_COPIES)
    return small_table(spark, S.history_rows(steps), S.HISTORY_SCHEMA)


def search_trials(spark, d):
    """All draws of the search: an AUC per trial and fold."""
    return R.search(_train_vectors(spark, d), KEPT, range(N_FOLDS), SEARCH_SPACE, SEARCH_DRAWS).trials


def without_twin() -> dict:
    """Nested reports and learned models: rows only."""
    return {f.__name__: f for f in (
        leakage_report, selection_report,
        forest_fold_auc, mean_abs_contribution, forest_importance,
        forest_test_predictions, forest_oof_predictions, leakage_comparison)}
