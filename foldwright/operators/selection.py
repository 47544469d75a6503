"""Selection curve, one-standard-error choice and feature ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwright.functions.columns import round_even, rounded_sql
from foldwright.operators.cube import value_map


def selection_curve(fold_aucs: DataFrame) -> DataFrame:
    """Mean and standard error of the fold AUCs per subset size."""
    return fold_aucs.groupBy("n_features").agg(
        F.avg("auc").alias("auc_mean"),
        (F.stddev_samp("auc") / F.sqrt(F.count(F.lit(1)))).alias("auc_se"))


def one_se_choice(curve: DataFrame) -> DataFrame:
    """Best size and the smallest size within one standard error of it, as one row.

    The curve has one row per feature, so it is folded into a single aggregate. On a tie
    the larger subset counts as best, as it comes first in the elimination.
    """
    point = F.struct("n_features", "auc_mean", "auc_se")
    whole = curve.agg(F.max_by(point, F.struct("auc_mean", "n_features")).alias("best"),
                      F.collect_list(point).alias("points"))
    bar = F.col("best.auc_mean") - F.col("best.auc_se")
    whole = whole.withColumn("threshold", bar)
    chosen = F.array_min(F.filter("points", lambda p: p["auc_mean"] >= F.col("threshold")))
    return whole.withColumn("chosen", chosen).select(
        F.col("best.n_features").alias("best_n_features"), F.col("best.auc_mean").alias("best_cv_auc"),
        "threshold", F.col("chosen.n_features").alias("chosen_n_features"),
        F.col("chosen.auc_mean").alias("chosen_cv_auc"))


def feature_ranking(steps: DataFrame, importance: DataFrame, mutual_info: DataFrame,
                    choice: DataFrame) -> DataFrame:
    """Rank by reversed elimination order, with importance, mutual information and choice.

    ``steps`` is (feature, elim_step), ``importance`` (feature, initial_mean_abs_shap); all
    inputs have one row per feature, ``choice`` has one row. Subsets are nested, so a
    feature is selected when its rank is within the chosen size.
    """
    last_first = Window.partitionBy(F.lit(1)).orderBy(F.desc("elim_step"))
    ranked = steps.select("feature", F.row_number().over(last_first).alias("rfe_rank"))
    return (
        ranked.join(F.broadcast(importance), "feature").join(F.broadcast(mutual_info), "feature")
        .select("feature", "rfe_rank", "initial_mean_abs_shap", "mutual_info",
                (F.col("rfe_rank") <= choice.select("chosen_n_features").scalar()).alias("selected"))
        .orderBy("rfe_rank")
    )


def rate_contributions(rates: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean absolute contribution of every feature to the mean-rate score, averaged over folds.

    The score is additive, so the contribution of a feature to a row is its rate minus the
    fold mean of that rate, divided by the number of features: no model walk is needed.
    """
    fold = Window.partitionBy("feature", "fold")
    total = F.sum("n").over(fold)
    centre = F.sum(F.col("rate") * F.col("n")).over(fold) / total
    part = F.abs(F.col("rate") - centre) * F.col("n") / total / F.lit(float(len(features)))
    per_fold = rates.where(F.col("feature").isin(*features)).select("feature", "fold", part.alias("part")).groupBy(
        "feature", "fold").agg(F.sum("part").alias("part"))
    return per_fold.groupBy("feature").agg(F.avg("part").alias("initial_mean_abs_shap"))


def additive_elimination(importance: DataFrame, features: Sequence[str]) -> DataFrame:
    """Elimination steps of an additive score: weakest first, earlier column first on a tie.

    Dropping a feature rescales the contributions of the others by the same factor, so the
    recursive order is the order of the first step. Importance is compared at 9 decimals.
    """
    place = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature"))
    weakest = Window.partitionBy(F.lit(1)).orderBy(round_even("initial_mean_abs_shap", 9), place)
    return importance.select("feature", F.row_number().over(weakest).alias("elim_step"))


def nested_scores(vectors: DataFrame, rates: DataFrame, steps: DataFrame, features: Sequence[str]) -> DataFrame:
    """Out-of-fold mean-rate score of every nested subset: (n_features, fold, score, n, pos).

    One pass over the fold-tagged vectors scores all subset sizes from a broadcast table of
    one row per fold.
    """
    total = len(features)
    ranked = rates.join(F.broadcast(steps), "feature")
    entry = f"struct({total + 1} - elim_step AS rank, rate)"
    lookup = ranked.groupBy("fold").agg(*[value_map(f, entry) for f in features])
    by_rank = F.expr("sort_array(array(" + ", ".join(f"element_at(`_r_{f}`, `{f}`)" for f in features) + "))")
    scored = (vectors.join(F.broadcast(lookup), "fold")
              .select("fold", "n", "pos", by_rank.alias("_by_rank"))
              .select("fold", "n", "pos", "_by_rank",
                      F.explode(F.sequence(F.lit(1), F.lit(total))).alias("n_features")))
    mean = "aggregate(slice(_by_rank, 1, n_features), 0D, (acc, e) -> acc + e.rate) / n_features"
    return scored.select("n_features", "fold", F.expr(rounded_sql(mean, 9)).alias("score"), "n", "pos")
