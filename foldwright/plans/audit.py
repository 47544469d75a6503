"""Step 1: profile a raw table, diagnose leaks, drop documented ones, freeze the hold-out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.constants import GROUP, LABEL, N_FOLDS, ROW, SPLIT
from foldwright.functions.columns import feature_cols, label_from_target
from foldwright.operators.cube import contingency_cube
from foldwright.operators.folds import deal_folds, holdout_groups
from foldwright.operators.leakage import (diagnostics, drop_set, flagged_kept, kept_features,
                                          removed_features)
from foldwright.operators.profile import profile, split_audit
from foldwright.operators.vectors import attach_by_group, group_table, vector_table, with_group_id
from foldwright.session import materialize


def tag_folds(vectors: DataFrame, k: int = N_FOLDS) -> DataFrame:
    """Add ``fold`` to a vector table through its groups. The vectors are stored, as they are read again for their groups."""
    vectors = materialize(vectors, "vectors")
    folds = deal_folds(group_table(vectors), k).select(GROUP, "fold")
    return vectors.join(folds, GROUP).select(*vectors.columns, "fold")


def stored_folds(df: DataFrame, features: Sequence[str], k: int = N_FOLDS) -> DataFrame:
    return materialize(tag_folds(vector_table(df, features), k), "folds")


def group_columns(tagged: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Group lookup (key, ``n`` and ``columns``) of a tagged vector table."""
    return tagged.groupBy(GROUP, *columns).agg(F.sum("n").alias("n"))


@dataclass
class Audit:
    """Tables of step 1; all lazy but the stored ``clean`` table."""

    profile: DataFrame
    diagnostics: DataFrame
    drops: DataFrame
    removed: DataFrame
    kept: DataFrame
    flagged: DataFrame
    split_audit: DataFrame
    clean: DataFrame
    kept_names: list[str]


def remove_leaky(raw: DataFrame, entries: DataFrame, url_only: bool = False,
                 n_folds: int = N_FOLDS) -> Audit:
    """``raw`` has a unique row number, ternary features and the target code.

    Only documented features are dropped; the diagnostics never drop one. Groups hash the
    full original vector, before anything is removed.
    """
    features = feature_cols(raw)
    rows = raw.withColumn(LABEL, label_from_target())
    vectors = materialize(vector_table(rows, features), "vectors")
    groups = group_table(vectors)
    diag = materialize(diagnostics(contingency_cube(tag_folds(vectors), features), entries), "diagnostics")
    drops = drop_set(entries, url_only)
    # One row per registry entry: driver metadata that fixes the schema of the clean table.
    names = {r.feature for r in drops.select("feature").collect()}
    kept = [c for c in features if c not in names]
    splits = materialize(holdout_groups(groups, n_folds), "splits")
    clean = attach_by_group(with_group_id(rows, features), splits, [SPLIT]).select(
        ROW, *kept, LABEL, GROUP, SPLIT)
    return Audit(
        profile=profile(vectors),
        diagnostics=diag.orderBy(F.desc("single_feature_auc"), "feature"),
        drops=drops,
        removed=removed_features(diag, drops),
        kept=kept_features(diag, drops, features),
        flagged=flagged_kept(diag, drops),
        split_audit=split_audit(splits),
        clean=materialize(clean, "clean", [SPLIT]),
        kept_names=kept,
    )
