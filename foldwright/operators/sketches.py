"""Mergeable summaries of bounded size: ranking metrics with a proven error, and counts of distinct vectors.

Scores are counted in buckets of equal width on the log-odds scale, so scores near 0 and 1 are told apart however skewed they are.
Log-odds are clipped where the log loss clips, so a summary has at most ``2 * 34.6 / width`` buckets, whatever the table. Summaries of
two tables add up to that of both. Only the order of rows of one bucket is unknown, which bounds the error:

* ROC-AUC counts a pair of one bucket as a tie, so it is off by at most half the share of such pairs.
* Average precision lies between its values when the positives of each bucket come last and first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwright.functions.columns import clipped

# Width of a bucket in log-odds.
WIDTH = 0.01

# Twice the logarithm of the registers of a distinct count: its relative standard error is about 1.04 / sqrt(2^LG).
LG = 12


def score_sketch(counts: DataFrame, by: Sequence[str] = ("evaluation",), width: float = WIDTH) -> DataFrame:
    """(by, bucket, pos, neg) from counts of positives and negatives per score, or from rows with such columns."""
    p = clipped(F.col("score"))
    bucket = F.floor(F.ln(p / (1 - p)) / F.lit(width)).cast("int")
    return counts.groupBy(*by, bucket.alias("bucket")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def merged(sketches: DataFrame, by: Sequence[str] = ("evaluation",)) -> DataFrame:
    """One summary per ``by`` from the rows of several."""
    return sketches.groupBy(*by, "bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def sketched_ranking(sketch: DataFrame, by: Sequence[str] = ("evaluation",)) -> DataFrame:
    """(by, roc_auc, roc_auc_error, pr_auc_low, pr_auc_high): the exact metrics lie within these bounds.

    Windows run over buckets, whose number is bounded. Null for a single class; average precision is 0 without positives.
    """
    down = Window.partitionBy(*by).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    ahead = sketch.select(*by, pos.alias("pos"), neg.alias("neg"), F.coalesce(F.sum(pos).over(down), F.lit(0.0)).alias("p"),
                          F.coalesce(F.sum(neg).over(down), F.lit(0.0)).alias("q"))
    # With p positives and q negatives ahead of a bucket, its k-th positive has the precision (p + k) / (p + k + negatives up to it):
    # at least with all negatives of the bucket, where it is concave in k, so that the sum is no less than the mean of its
    # ends times its terms; at most with none of them and all positives of the bucket.
    def least(place):
        return F.try_divide(F.col("p") + place, F.col("p") + place + F.col("q") + F.col("neg"))

    low = F.when(F.col("pos") > 0, F.col("pos") * (least(F.lit(1.0)) + least(F.col("pos"))) / 2)
    high = F.col("pos") * F.try_divide(F.col("p") + F.col("pos"), F.col("p") + F.col("pos") + F.col("q"))
    all_pos, all_neg = F.sum("pos"), F.sum("neg")
    return ahead.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("neg") * (F.col("p") + F.col("pos") / 2)), all_pos * all_neg).alias("roc_auc"),
        F.try_divide(F.sum(F.col("pos") * F.col("neg")) / 2, all_pos * all_neg).alias("roc_auc_error"),
        F.coalesce(F.try_divide(F.sum(F.coalesce(low, F.lit(0.0))), all_pos), F.lit(0.0)).alias("pr_auc_low"),
        F.coalesce(F.try_divide(F.sum(F.coalesce(high, F.lit(0.0))), all_pos), F.lit(0.0)).alias("pr_auc_high"))


def distinct_sketch(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, sketch) of the distinct vectors of rows; copies cost nothing and no vector is shuffled."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(F.xxhash64(*features), F.lit(LG)).alias("sketch"))


def distinct_vectors(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, distinct_vectors) from the rows of several sketches."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_vectors"))
