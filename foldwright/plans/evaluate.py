"""Step 3: search a forest, score hold-out and out-of-fold rows, measure what leakage adds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.constants import (EVAL_OOF, EVAL_TEST, GROUP, LABEL, N_FOLDS, ROW, SEARCH_DRAWS, SEARCH_SPACE,
                                  SPLIT)
from foldwright.functions.columns import feature_cols, label_from_target
from foldwright.operators.folds import random_holdout
from foldwright.operators.forest import (COPIES, feature_importance, fit_folds, fit_forest, in_parallel, score, score_folds, search,
                                         spark_params)
from foldwright.operators.metrics import (class_report, compute_metrics, confusion_matrix, fold_and_pooled,
                                          metrics_summary, union_all, vector_score_counts)
from foldwright.operators.predictions import prediction_table
from foldwright.operators.vectors import attach_by_group, count_rows, vector_table
from foldwright.plans.rates import reference_names
from foldwright.plans.select import train_vectors
from foldwright.session import materialize


@dataclass
class Evaluation:
    model: PipelineModel
    features: list[str]
    best_params: dict
    cv_roc_auc: float
    trials: DataFrame
    test_predictions: DataFrame
    oof_predictions: DataFrame
    metrics: DataFrame
    summary: DataFrame
    class_report: DataFrame
    importance: DataFrame


def evaluate(model: PipelineModel, vectors: DataFrame, name: str = EVAL_TEST) -> DataFrame:
    """Score counts under ``name`` of a model on a vector table with ``n`` and ``pos``, from which its metric record follows."""
    return vector_score_counts(score(model, vectors).withColumn("evaluation", F.lit(name)), ["evaluation"])


def reference_run(vectors: DataFrame, features: Sequence[str], trial: Mapping, name: str,
                  copies: int = COPIES) -> DataFrame:
    """Fit on the train side of a split vector table, score the test side: score counts under ``name``."""
    params, balanced = spark_params(trial)
    model = fit_forest(vectors.where(F.col(SPLIT) == "train"), features, params, balanced, copies=copies)
    return evaluate(model, vectors.where(F.col(SPLIT) == "test"), name)


def leakage_runs(rows: DataFrame, split: DataFrame, features: Sequence[str], selected: Sequence[str],
                 trial: Mapping, prefix: str = "reference: ", copies: int = COPIES) -> DataFrame:
    """Score counts of the three comparison runs, refitted with the same parameters.

    ``rows`` has all features and the label, ``split`` is the group-split vector table.
    """
    names = reference_names(len(features))
    loose = materialize(vector_table(random_holdout(rows), features, [SPLIT]), "random-vectors")
    runs = [(loose, features, "all_random"), (split, features, "all_group"), (loose, selected, "selected_random")]
    return union_all(in_parallel(
        rows.sparkSession, lambda run: reference_run(run[0], run[1], trial, prefix + names[run[2]], copies), runs, len(runs)))


def test_predictions(clean: DataFrame, model: PipelineModel, selected: Sequence[str]) -> DataFrame:
    """Prediction of every test row. Trees are walked once per distinct (group, vector); its rows get the score by a join."""
    test = clean.where(F.col(SPLIT) == "test").select(ROW, *selected, LABEL, GROUP)
    scored = materialize(score(model, count_rows(test, [GROUP, *selected])), "test-scores")
    return prediction_table(attach_by_group(test, scored, ["score"], on=[GROUP, *selected]), selected, "test")


def oof_predictions(clean: DataFrame, scored: DataFrame, selected: Sequence[str]) -> DataFrame:
    """Out-of-fold prediction of every train row.

    ``scored`` holds one score per (group, vector). Rows need a join to learn their fold
    anyway; the score rides along, so no tree is walked once per copy.
    """
    train = clean.where(F.col(SPLIT) == "train").select(ROW, *selected, LABEL, GROUP)
    rows = attach_by_group(train, scored, ["fold", "score"], on=[GROUP, *selected])
    return prediction_table(rows.withColumn("cv_fold", F.col("fold") + 1), selected, "train_oof", ["cv_fold"])


def train_and_evaluate(clean: DataFrame, raw: DataFrame, selected: Sequence[str],
                       n_iter: int = SEARCH_DRAWS, space: Mapping = SEARCH_SPACE, k: int = N_FOLDS,
                       parallelism: int = N_FOLDS, copies: int = COPIES, ledger: str | None = None) -> Evaluation:
    """``clean`` is the output of step 1, ``raw`` its input, ``selected`` the outcome of step 2.

    ``copies`` bounds the rows of one (vector, label) pair in every fit, see ``forest.training_rows``; ``ledger`` is a folder
    from which a search that was cut off goes on, see ``forest.search``.
    """
    spark, selected = clean.sparkSession, list(selected)
    vectors = train_vectors(clean, selected, k)
    test = clean.where(F.col(SPLIT) == "test")

    found = search(vectors, selected, range(k), space, n_iter, parallelism=parallelism, copies=copies, ledger=ledger)
    best, (params, balanced) = found.best, spark_params(found.best)
    model = fit_forest(vectors, selected, params, balanced, copies=copies)

    # The fold forests of the winning trial are the out-of-fold forests: same rows, same seed.
    fold_models = fit_folds(vectors, selected, params, range(k), balanced, parallelism, copies)
    scored = materialize(score_folds(fold_models, vectors), "oof-scores")

    rows = raw.withColumn(LABEL, label_from_target())
    features = feature_cols(raw)
    # The side of a group is read off the clean table, so both steps share one split.
    sides = clean.groupBy(GROUP).agg(F.min(SPLIT).alias(SPLIT))
    split = materialize(vector_table(rows, features).join(sides, GROUP), "split-vectors")
    counts = materialize(union_all([
        evaluate(model, count_rows(test, selected)),
        fold_and_pooled(vector_score_counts(scored.withColumn("cv_fold", F.col("fold") + 1), ["cv_fold"]),
                        pooled=EVAL_OOF),
        leakage_runs(rows, split, features, selected, best, copies=copies),
    ]), "score-counts")
    metrics = materialize(compute_metrics(counts), "metrics")
    return Evaluation(
        model=model, features=selected, best_params=best, cv_roc_auc=found.best_auc, trials=found.trials,
        test_predictions=test_predictions(clean, model, selected),
        oof_predictions=oof_predictions(clean, scored, selected),
        metrics=metrics, summary=metrics_summary(metrics),
        class_report=class_report(confusion_matrix(counts.where(F.col("evaluation") == EVAL_TEST))),
        importance=feature_importance(spark, model))
