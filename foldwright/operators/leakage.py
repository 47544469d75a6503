"""Leakage diagnostics, the registry of documented leaks, and what gets removed or kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.constants import (LEAKY_FEATURES, PAGE_CATEGORY, PAGE_FEATURES, PAGE_REASON,
                                  SUSPICIOUS_AUC)
from foldwright.operators.cube import mutual_information, out_of_fold_rates, single_feature_auc
from foldwright.session import small_table

DEFAULT_MODE, URL_ONLY_MODE = "default", "url-only"
REGISTRY_SCHEMA = "feature string, category string, reason string, mode string"


def registry(spark: SparkSession, leaky: Sequence[tuple] = tuple(LEAKY_FEATURES),
             page_features: Sequence[str] = tuple(PAGE_FEATURES)) -> DataFrame:
    """Documented leaks plus the page features that only url-only mode removes."""
    documented = small_table(spark, [(*r, DEFAULT_MODE) for r in leaky], REGISTRY_SCHEMA)
    page = small_table(spark, [(f, PAGE_CATEGORY, PAGE_REASON, URL_ONLY_MODE) for f in page_features],
                                 REGISTRY_SCHEMA)
    return documented.unionByName(page)


def drop_set(entries: DataFrame, url_only: bool) -> DataFrame:
    """Registry entries in force; in url-only mode a page entry replaces a documented one."""
    if not url_only:
        return entries.where(F.col("mode") == DEFAULT_MODE)
    latest = F.max_by(F.struct("category", "reason", "mode"), F.col("mode") == URL_ONLY_MODE)
    return entries.groupBy("feature").agg(latest.alias("_e")).select("feature", "_e.*")


def diagnostics(cube: DataFrame, entries: DataFrame, threshold: float = SUSPICIOUS_AUC) -> DataFrame:
    """AUC, mutual information and flags per feature, strongest first."""
    documented = entries.where(F.col("mode") == DEFAULT_MODE).select("feature", F.lit(True).alias("_doc"))
    auc = single_feature_auc(out_of_fold_rates(cube))
    return (
        auc.join(mutual_information(cube), "feature")
        .join(F.broadcast(documented), "feature", "left")
        .select("feature", "single_feature_auc", "mutual_info",
                F.coalesce("_doc", F.lit(False)).alias("documented_leaky"),
                (F.col("single_feature_auc") >= threshold).alias("suspicious"))
        .orderBy(F.desc("single_feature_auc"), "feature")
    )


def removed_features(diag: DataFrame, drops: DataFrame) -> DataFrame:
    """Features of the table that the drop set names, with category and reason."""
    return diag.join(F.broadcast(drops), "feature").select(
        "feature", "category", "reason", "single_feature_auc", "mutual_info")


def kept_features(diag: DataFrame, drops: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features outside the drop set with their place in the original column order."""
    place = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature")) - 1
    return (diag.join(F.broadcast(drops), "feature", "left_anti")
            .select(place.cast("int").alias("position"), "feature", "single_feature_auc", "mutual_info")
            .orderBy("position"))


def flagged_kept(diag: DataFrame, drops: DataFrame) -> DataFrame:
    """Suspiciously strong features that stay, because no entry documents them as leaks."""
    return diag.where("suspicious").join(F.broadcast(drops), "feature", "left_anti").select(
        "feature", "single_feature_auc", "mutual_info")
