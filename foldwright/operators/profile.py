"""Counts that describe a labelled table: classes, copies, conflicts, split balance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.constants import GROUP, LABEL, SPLIT


def _long_sum(cond):
    return F.sum(cond.cast("long"))


def profile(vectors: DataFrame) -> DataFrame:
    """One row of totals from the vector table.

    A row is an exact duplicate when an earlier row has the same features and label, so
    every (vector, label) pair that occurs leaves all its rows but one as duplicates.
    """
    pairs = (F.col("pos") > 0).cast("long") + (F.col("pos") < F.col("n")).cast("long")
    groups = vectors.groupBy(GROUP).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"),
                                        F.sum(pairs).alias("pairs"))
    mixed = (F.col("pos") > 0) & (F.col("pos") < F.col("n"))
    return groups.agg(
        F.sum("n").alias("n_rows"),
        F.sum("pos").alias("n_phishing"),
        F.sum(F.col("n") - F.col("pos")).alias("n_legitimate"),
        F.sum(F.col("n") - F.col("pairs")).alias("exact_duplicate_rows"),
        F.count(F.lit(1)).alias("distinct_vectors"),
        _long_sum(mixed).alias("conflicting_label_vectors"),
    )


def class_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n"))


def duplicate_rows(df: DataFrame, features: list[str]) -> DataFrame:
    """(vector, label) pairs that occur more than once, with the number of surplus rows."""
    return (df.groupBy(*features, LABEL).agg(F.count(F.lit(1)).alias("copies"))
            .where(F.col("copies") > 1)
            .withColumn("duplicate_rows", F.col("copies") - 1))


def conflict_groups(groups: DataFrame) -> DataFrame:
    return groups.where((F.col("pos") > 0) & (F.col("pos") < F.col("n")))


def fold_balance(folds: DataFrame) -> DataFrame:
    """Groups, rows, positives and positive rate per fold of a dealt group table."""
    return folds.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_rows"), F.sum("pos").alias("n_phishing"),
    ).withColumn("phishing_rate", F.col("n_phishing") / F.col("n_rows"))


def split_audit(splits: DataFrame) -> DataFrame:
    """Groups, rows and positives per side of a split group table."""
    return splits.groupBy(SPLIT).agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_rows"), F.sum("pos").alias("n_phishing"))


def shared_keys(df: DataFrame, key: list[str], view: str) -> DataFrame:
    """How many key values occur, and how many occur on both sides of the split.

    One aggregate instead of an intersection of two distinct lists.
    """
    sides = df.groupBy(*key).agg((F.min(SPLIT) < F.max(SPLIT)).alias("both"), F.sum("n").alias("n"))
    return sides.agg(
        F.lit(view).alias("view"),
        F.count(F.lit(1)).alias("n_keys"),
        _long_sum(F.col("both")).alias("shared_keys"),
        F.sum(F.when(F.col("both"), F.col("n")).otherwise(0)).alias("shared_rows"),
    )
