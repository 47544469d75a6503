"""Per-row prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.constants import DECISION_THRESHOLD, GROUP, LABEL, ROW, SPLIT
from foldwright.functions.columns import class_name, outcome, predicted, rounded_sql


def prediction_table(scored: DataFrame, features: Sequence[str], split, extra: Sequence[str] = (),
                     score: str = "score", threshold: float = DECISION_THRESHOLD) -> DataFrame:
    """The eleven prediction columns, then ``extra`` (such as ``cv_fold``), then the features.

    A projection of the scored rows: features travel with the score, so nothing is joined.
    """
    y, p = F.col(LABEL), F.col(score)
    pred = predicted(p, threshold)
    return scored.select(
        F.col(ROW), F.col(GROUP), (split if hasattr(split, "cast") else F.lit(split)).alias(SPLIT),
        y.alias("true_label"), class_name(y).alias("true_class"),
        pred.alias("predicted_label"), class_name(pred).alias("predicted_class"),
        F.expr(rounded_sql(score, 6)).alias("prob_phishing"),
        F.expr(rounded_sql(f"1 - {score}", 6)).alias("prob_legitimate"),
        (y == pred).alias("correct"), outcome(y, pred).alias("outcome"),
        *extra, *features)
