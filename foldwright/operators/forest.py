"""Random forests: fitting, scoring, fold fits, randomised search and importances.

Trees that split on Gini impurity are trained as regression trees on the 0/1 label: the
variance of a 0/1 label is half its Gini impurity, so the splits are the same, and a leaf
predicts its share of positives. Spark's classification trees merge sibling leaves that
agree on the majority class, which coarsens the probabilities and with them every ranking
metric; the regression trees only merge leaves that predict the same share.

Forests are fitted and evaluated on distinct vectors with row count ``n`` and positives
``pos``; rows are read once, when that table is built, however many fits follow. Regression trees
are grown by ``trees``, which draws how many copies of a vector a tree samples; classification trees (entropy)
by Spark, over the rows behind the vectors.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.constants import LABEL, N_FOLDS, SEED
from foldwright.operators.metrics import ranking_metrics, union_all, vector_score_counts
from foldwright.operators.trees import ForestLearner, fit_forests, fit_trees
from foldwright.operators.weights import with_class_weight
from foldwright.session import in_parallel, materialize, scratch_path, small_table

# Default bound on the rows of one (vector, label) pair that are sampled one by one; see training_rows.
COPIES = 1000

# Training rows per task. Most of a fit is work per node, not per row, and each task adds its own statistics of all nodes to the shuffle.
ROWS_PER_TASK = 6_000

# Deepest tree Spark trains; stands for "unlimited".
MAX_DEPTH = 30


def _learner(params: Mapping):
    params = {"featureSubsetStrategy": "sqrt", "featuresCol": "_x", "labelCol": LABEL, "weightCol": "weight",
              **params}
    impurity = params.pop("impurity", "gini")
    if impurity == "gini":
        return ForestLearner(**params)
    return RandomForestClassifier(impurity=impurity, **params)


def training_partitions(vectors: DataFrame, copies: int = COPIES) -> int:
    """Tasks for a fit, by the number of training rows alone: Spark seeds its row sampling per
    partition, so a number that followed the session would change the forest."""
    rows = vectors.selectExpr(f"sum(least(pos, {copies}) + least(n - pos, {copies})) AS rows").first().rows or 0
    return max(1, -(-rows // ROWS_PER_TASK))


def training_pairs(vectors: DataFrame, features: Sequence[str], balanced: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """(by, features, label, m, class_weight): the row count and the weight of a row of every (vector, label) pair, for each value of ``by``."""
    keys = [*by, *features]
    labels = (vectors.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
              .selectExpr(*[f"`{f}`" for f in keys],
                          f"inline(array(struct(1 AS {LABEL}, pos AS m), struct(0 AS {LABEL}, n - pos AS m)))")
              .where("m > 0"))
    return with_class_weight(labels, by) if balanced else labels.withColumn("class_weight", F.lit(1.0))


def fold_pairs(vectors: DataFrame, features: Sequence[str], folds: Sequence[int], balanced: bool = False) -> DataFrame:
    """The training pairs of all fold fits: those of ``forest`` k are the pairs of the other folds. The vectors are read once."""
    others = F.filter(F.lit(list(folds)), lambda k: k != F.col("fold"))
    return training_pairs(vectors.withColumn("forest", F.explode(others)), features, balanced, ["forest"])


def training_rows(vectors: DataFrame, features: Sequence[str], balanced: bool = False,
                  partitions: int | None = None, copies: int = COPIES) -> DataFrame:
    """The rows behind a vector table as (features, label, weight).

    Trees sample rows, so every copy becomes a row again, with weight one. Only the copies
    of one (vector, label) pair beyond ``copies`` are shared out as weight: the total weight
    is always the number of rows, and a vector that holds a third of the table trains as
    ``copies`` rows. Beyond that bound a leaf's least number of instances counts such heavier
    rows, and sampling takes or leaves them whole; a fit without that costs ``copies`` above the
    largest pair. The explicit repartition spreads the small table before it grows; sorting its
    partitions makes the rows that a seed samples independent of their arrival.
    """
    labels = training_pairs(vectors, features, balanced)
    spread = labels.repartition(partitions or training_partitions(vectors, copies), *features, LABEL)
    return spread.sortWithinPartitions(*features, LABEL).selectExpr(
        *[f"`{f}`" for f in features], LABEL,
        f"explode(array_repeat(class_weight * m / least(m, {copies}), int(least(m, {copies})))) AS weight")


def fit_forest(vectors: DataFrame, features: Sequence[str], params: Mapping, balanced: bool = False,
               partitions: int | None = None, copies: int = COPIES) -> PipelineModel:
    """The forest of a vector table. Regression trees grow over its vectors, classification trees over the rows behind them."""
    assembler, learner = VectorAssembler(inputCols=list(features), outputCol="_x"), _learner(params)
    if isinstance(learner, RandomForestRegressor):
        model = fit_trees(training_pairs(vectors, features, balanced), assembler, learner, copies)
    else:
        rows = training_rows(vectors, features, balanced, partitions, copies)
        model = learner.fit(assembler.transform(rows).drop(*features))
    return PipelineModel([assembler, model])


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``score``, the probability of the positive class (0 if training saw no positive).

    A saved model adds it itself, see ``sources.models``.
    """
    if len(model.stages) > 2:
        return model.transform(df).select(*df.columns, "score")
    if isinstance(model.stages[1], RandomForestRegressionModel):
        p = F.col("prediction")
    else:
        p = F.coalesce(F.try_element_at(vector_to_array("probability"), F.lit(2)), F.lit(0.0))
    return model.transform(df).select(*df.columns, p.alias("score"))


def fit_folds(vectors: DataFrame, features: Sequence[str], params: Mapping, folds: Sequence[int],
              balanced: bool = False, parallelism: int = N_FOLDS, copies: int = COPIES,
              partitions: int | None = None) -> dict[int, PipelineModel]:
    """One forest per fold of a fold-tagged vector table, fitted on the other folds. Regression trees of all folds grow at once."""
    assembler, learner = VectorAssembler(inputCols=list(features), outputCol="_x"), _learner(params)
    if isinstance(learner, RandomForestRegressor):
        grown = fit_forests(fold_pairs(vectors, features, folds, balanced), assembler, learner, copies)
        return {k: PipelineModel([assembler, grown[k]]) for k in folds}
    tasks = partitions or training_partitions(vectors, copies)
    models = in_parallel(
        vectors.sparkSession,
        lambda k: fit_forest(vectors.where(F.col("fold") != k), features, params, balanced, tasks, copies),
        list(folds), parallelism)
    return dict(zip(folds, models))


def score_folds(models: Mapping[int, PipelineModel], df: DataFrame) -> DataFrame:
    """Every row of a fold-tagged table (rows or vectors) scored by the forest that never saw its fold."""
    # Scoring sends a forest to the executors at once, so that of one fold does not wait for the others.
    return union_all(in_parallel(df.sparkSession, lambda k: score(models[k], df.where(F.col("fold") == k)), list(models), len(models)))


def fold_aucs(models: Mapping[int, PipelineModel], vectors: DataFrame) -> DataFrame:
    """(fold, auc) from distinct vectors with multiplicity: one job for all folds."""
    counts = vector_score_counts(score_folds(models, vectors), ["fold"])
    return ranking_metrics(materialize(counts, "fold-counts"), ["fold"]).select(
        "fold", F.col("roc_auc").alias("auc"))


def feature_importance(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """Impurity importance per feature, strongest first. One row per feature."""
    rows = [(f, float(v)) for f, v in zip(model.stages[0].getInputCols(), model.stages[-1].featureImportances.toArray())]
    return small_table(spark, rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


# Randomised search ------------------------------------------------------------------------

def draw_trials(space: Mapping, n_iter: int, seed: int = SEED) -> list[dict]:
    """Seeded independent draws, one value per parameter."""
    rng = random.Random(seed)
    return [{name: rng.choice(values) for name, values in space.items()} for _ in range(n_iter)]


def spark_params(trial: Mapping, seed: int = SEED) -> tuple[dict, bool]:
    """Forest parameters of a trial, and whether classes are balanced.

    There is no split-size limit here, so a minimum split becomes the leaf size that
    guarantees it.
    """
    out = {"seed": seed}
    if "n_estimators" in trial:
        out["numTrees"] = trial["n_estimators"]
    if "max_depth" in trial:
        out["maxDepth"] = MAX_DEPTH if trial["max_depth"] is None else trial["max_depth"]
    if "max_features" in trial:
        out["featureSubsetStrategy"] = "all" if trial["max_features"] is None else str(trial["max_features"])
    if "criterion" in trial:
        out["impurity"] = trial["criterion"]
    leaf, split = trial.get("min_samples_leaf", 1), trial.get("min_samples_split", 2)
    out["minInstancesPerNode"] = max(leaf, math.ceil(split / 2))
    return out, trial.get("class_weight") == "balanced"


@dataclass
class Search:
    """What a search found: a row per trial and fold, the winner, and how many fits this run made and how many it found done."""

    trials: DataFrame
    best: dict
    best_auc: float
    fits: int
    resumed: int


def run_key(vectors: DataFrame, *about) -> str:
    """A name for the work on these vectors with these arguments: only the same work finds the same ledger."""
    columns = sorted(vectors.columns)
    rows = vectors.select(F.xxhash64(*columns).alias("h")).agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first()
    return hashlib.md5(json.dumps([columns, [str(v) for v in rows], *about], default=str).encode()).hexdigest()


def recorded(spark: SparkSession, folder: str, schema: str) -> DataFrame | None:
    """The records of a ledger, one folder each; None if there are none. A write that was cut off has left no record."""
    try:
        found = spark.read.schema(schema).parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return found


def search(vectors: DataFrame, features: Sequence[str], folds: Sequence[int], space: Mapping, n_iter: int, seed: int = SEED,
           parallelism: int = N_FOLDS, copies: int = COPIES, ledger: str | None = None) -> Search:
    """Randomised search by mean fold ROC-AUC; the first trial with the highest mean wins.

    All (trial, fold) fits are submitted at once, each trial to a scheduler pool of its own, ``parallelism`` at a time, so no fit
    waits for the slowest of its trial. A fit leaves the score counts of its fold in ``ledger``; a run that starts with the ledger of
    one that was cut off makes the fits that are missing. The metrics of all fits are then one pass over the ledger, from which
    one AUC per fit reaches the driver. No forest is kept: ``fit_folds`` makes those of the winner again.
    """
    spark, drawn, tasks = vectors.sparkSession, draw_trials(space, n_iter, seed), training_partitions(vectors, copies)
    root = ledger or scratch_path(spark, "search")
    folder = f"{root}/{run_key(vectors, list(features), list(folds), [spark_params(t, seed) for t in drawn], copies)}"
    schema = "score double, pos bigint, neg bigint, trial int, fold int"
    before = recorded(spark, folder, schema)
    done = set() if before is None else {(r.trial, r.fold) for r in before.select("trial", "fold").distinct().collect()}
    todo = [(i, k) for i in range(len(drawn)) for k in folds if (i, k) not in done]

    def fit(job: tuple[int, int]) -> None:
        trial, fold = job
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"trial-{trial}")
        params, balanced = spark_params(drawn[trial], seed)
        model = fit_forest(vectors.where(F.col("fold") != fold), features, params, balanced, tasks, copies)
        counts = vector_score_counts(score(model, vectors.where(F.col("fold") == fold)), ["fold"])
        counts.drop("fold").write.mode("overwrite").parquet(f"{folder}/trial={trial}/fold={fold}")

    in_parallel(spark, fit, todo, parallelism)
    aucs = ranking_metrics(spark.read.schema(schema).parquet(folder), ["trial", "fold"]).select("trial", "fold", "roc_auc")
    found = {(r.trial, r.fold): r.roc_auc for r in aucs.collect()}
    # A fold without rows or with one class has no AUC, whatever the trial.
    defined = [k for k in folds if found.get((0, k)) is not None]
    means = [sum(found[i, k] for k in defined) / max(1, len(defined)) for i in range(len(drawn))]
    best = max(range(len(drawn)), key=lambda i: (means[i], -i))
    rows = [(i, {name: str(v) for name, v in t.items()}, k, found.get((i, k)), means[i]) for i, t in enumerate(drawn) for k in folds]
    table = small_table(spark, rows, "trial int, params map<string,string>, fold int, auc double, mean_auc double")
    return Search(table, drawn[best], means[best], len(todo), len(done))
