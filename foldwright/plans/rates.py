"""Evaluation of the mean-rate score: the same tables as for a forest, without a learned model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.constants import EVAL_TEST, N_FOLDS, SPLIT
from foldwright.operators.cube import (contingency_cube, held_out_score, mutual_information,
                                       out_of_fold_rates, out_of_fold_score)
from foldwright.operators.folds import holdout_groups, random_holdout
from foldwright.operators.metrics import (compute_metrics, fold_and_pooled, ranking_metrics, union_all,
                                          vector_score_counts)
from foldwright.operators.selection import (additive_elimination, feature_ranking, nested_scores,
                                            one_se_choice, rate_contributions, selection_curve)
from foldwright.operators.vectors import group_table, vector_table
from foldwright.plans.audit import tag_folds
from foldwright.session import materialize


def reference_names(n_features: int) -> dict[str, str]:
    # Names of the leakage comparison runs.
    return {
        "all_random": f"all_{n_features}_features_random_split (leaky features + duplicate leakage)",
        "all_group": f"all_{n_features}_features_group_split (leaky features)",
        "selected_random": "selected_features_random_split (duplicate leakage)",
    }


def split_vectors(df: DataFrame, features: Sequence[str], n_folds: int = N_FOLDS) -> DataFrame:
    """Stored vectors with their hold-out side."""
    vectors = materialize(vector_table(df, features), "vectors")
    sides = holdout_groups(group_table(vectors), n_folds).select("group_id", SPLIT)
    return materialize(vectors.join(sides, "group_id").select(*vectors.columns, SPLIT), "split-vectors")


def train_folds(split: DataFrame) -> DataFrame:
    """Stored train vectors with folds dealt among the train groups only."""
    return materialize(tag_folds(split.where(F.col(SPLIT) == "train").drop(SPLIT)), "train-folds")


def oof_counts(folded: DataFrame, selected: Sequence[str]) -> DataFrame:
    """Score counts per 1-based fold of the out-of-fold mean-rate score."""
    rates = out_of_fold_rates(contingency_cube(folded, selected))
    scored = out_of_fold_score(folded, rates, selected).withColumn("cv_fold", F.col("fold") + 1)
    return vector_score_counts(scored, ["cv_fold"])


def held_out_counts(split: DataFrame, selected: Sequence[str], name: str) -> DataFrame:
    cube = contingency_cube(split.where(F.col(SPLIT) == "train"), selected, tags=())
    scored = held_out_score(split.where(F.col(SPLIT) == "test"), cube, selected)
    return vector_score_counts(scored.withColumn("evaluation", F.lit(name)), ["evaluation"])


def evaluate_rates(df: DataFrame, features: Sequence[str], selected: Sequence[str]) -> DataFrame:
    """Metric records of hold-out, out-of-fold, every fold and the three comparison runs."""
    split = split_vectors(df, features)
    loose = materialize(vector_table(random_holdout(df), features, [SPLIT]), "random-vectors")
    names = reference_names(len(features))
    counts = union_all([
        held_out_counts(split, selected, EVAL_TEST),
        fold_and_pooled(oof_counts(train_folds(split), selected)),
        held_out_counts(loose, features, f"reference: {names['all_random']}"),
        held_out_counts(split, features, f"reference: {names['all_group']}"),
        held_out_counts(loose, selected, f"reference: {names['selected_random']}"),
    ])
    return compute_metrics(materialize(counts, "score-counts"))


def select_by_rates(df: DataFrame, features: Sequence[str], candidates: Sequence[str]):
    """Curve, one-row choice and ranking of the recursive elimination with the mean-rate score."""
    folded = train_folds(split_vectors(df, features))
    cube = materialize(contingency_cube(folded, candidates), "cube")
    rates = out_of_fold_rates(cube)
    importance = rate_contributions(rates, candidates)
    steps = additive_elimination(importance, candidates)
    counts = materialize(vector_score_counts(nested_scores(folded, rates, steps, candidates),
                                             ["n_features", "fold"]), "nested-counts")
    aucs = ranking_metrics(counts, ["n_features", "fold"]).withColumnRenamed("roc_auc", "auc")
    curve = materialize(selection_curve(aucs), "curve")
    choice = one_se_choice(curve)
    return curve, choice, feature_ranking(steps, importance, mutual_information(cube), choice)
