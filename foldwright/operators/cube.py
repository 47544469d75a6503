"""The contingency cube (feature, value, fold) and everything read off it.

A ternary table has at most three values per feature (a byte at most 256), so the cube
holds at most features x 256 x folds rows whatever the size of the table. Rates, single
feature AUCs and mutual information of all features come from this one aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwright.functions.columns import ratio, rounded_sql


def contingency_cube(vectors: DataFrame, features: Sequence[str], tags: Sequence[str] = ("fold",)) -> DataFrame:
    """Rows and positives per (feature, value) and tag, from distinct vectors with multiplicity."""
    long = vectors.unpivot([*tags, "n", "pos"], list(features), "feature", "value")
    return long.groupBy("feature", "value", *tags).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def mutual_information(cube: DataFrame) -> DataFrame:
    """Discrete mutual information with the label, in nats, never below zero."""
    cells = cube.groupBy("feature", "value").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    w = Window.partitionBy("feature")
    total, positives = F.sum("n").over(w).cast("double"), F.sum("pos").over(w).cast("double")
    cells = cells.select("feature", F.col("n").cast("double").alias("n"), F.col("pos").cast("double").alias("pos"),
                         total.alias("total"), positives.alias("positives"))

    def term(joint, margin):
        return F.when(joint > 0, joint / F.col("total") * F.ln(joint * F.col("total") / (F.col("n") * margin))
                      ).otherwise(0.0)

    both = term(F.col("pos"), F.col("positives")) + term(
        F.col("n") - F.col("pos"), F.col("total") - F.col("positives"))
    return cells.groupBy("feature").agg(F.greatest(F.sum(both), F.lit(0.0)).alias("mutual_info"))


def out_of_fold_rates(cube: DataFrame) -> DataFrame:
    """Add ``rate``: the positive rate of the value over all other folds.

    Learned as total minus own fold. A value that the other folds lack falls back to their
    overall positive rate.
    """
    value, fold, whole = (Window.partitionBy(*c) for c in (["feature", "value"], ["feature", "fold"], ["feature"]))
    others = {m: F.sum(m).over(value) - F.col(m) for m in ("n", "pos")}
    rest = {m: F.sum(m).over(whole) - F.sum(m).over(fold) for m in ("n", "pos")}
    return cube.select("*", F.coalesce(ratio(others["pos"], others["n"]),
                                       ratio(rest["pos"], rest["n"])).alias("rate"))


def train_rates(cube: DataFrame) -> DataFrame:
    """Positive rate per (feature, value) over the whole cube."""
    cells = cube.groupBy("feature", "value").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    return cells.withColumn("rate", ratio(F.col("pos"), F.col("n")))


def single_feature_auc(rates: DataFrame) -> DataFrame:
    """ROC-AUC of every feature's out-of-fold rate, symmetrised around one half.

    Cells with equal rates are one tie. At most 256 x folds scores per feature are sorted.
    """
    scores = rates.groupBy("feature", "rate").agg(
        F.sum("pos").cast("double").alias("pos"), F.sum(F.col("n") - F.col("pos")).cast("double").alias("neg"))
    below = Window.partitionBy("feature").orderBy("rate").rowsBetween(Window.unboundedPreceding, -1)
    ranked = scores.withColumn("below", F.coalesce(F.sum("neg").over(below), F.lit(0.0)))
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    auc = F.try_divide(wins, F.sum("pos") * F.sum("neg"))
    return ranked.groupBy("feature").agg(auc.alias("_auc")).select(
        "feature", F.greatest(F.col("_auc"), 1 - F.col("_auc")).alias("single_feature_auc"))


def value_map(feature: str, entry: str = "rate"):
    """Aggregate: map from the values of one feature to an expression over its cube cell."""
    return F.expr(f"map_from_entries(collect_list(CASE WHEN feature = '{feature}' "
                  f"THEN struct(value, {entry}) END)) AS `_r_{feature}`")


def rate_lookup(rates: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per fold with a value -> rate map per feature.

    At most folds x features x 256 entries, so it can always be broadcast.
    """
    return rates.groupBy("fold").agg(*[value_map(f) for f in features])


def mean_rate_score(features: Sequence[str], default: str | None = None):
    """Average over the features of the looked-up rate, rounded to 9 decimals so that ties agree."""
    found = [f"try_element_at(`_r_{f}`, `{f}`)" for f in features]
    if default:
        found = [f"coalesce({rate}, {default})" for rate in found]
    return F.expr(rounded_sql(f"({' + '.join(found)}) / {len(found)}D", 9))


def out_of_fold_score(df: DataFrame, rates: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add ``score`` to a fold-tagged table (rows or vectors) from the other folds' rates."""
    lookup = rate_lookup(rates, features)
    return df.join(F.broadcast(lookup), "fold").select(*df.columns, mean_rate_score(features).alias("score"))


def held_out_score(df: DataFrame, train_cube: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add ``score`` from rates learned on a train table; unseen values get its overall rate.

    The rates of all features and the overall rate form a single broadcast row.
    """
    first = f"CASE WHEN feature = '{features[0]}' THEN"
    overall = F.expr(f"try_divide(sum({first} pos END), sum({first} n END)) AS _overall")
    lookup = train_rates(train_cube).agg(*[value_map(f) for f in features], overall, F.expr("max(1) AS _one"))
    tagged = df.withColumn("_one", F.lit(1)).join(F.broadcast(lookup), "_one")
    return tagged.select(*df.columns, mean_rate_score(features, "_overall").alias("score"))
