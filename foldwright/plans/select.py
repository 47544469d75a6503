"""Step 2: recursive feature elimination by mean absolute contribution, one-standard-error choice."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.constants import GROUP, N_FOLDS, SELECTION_FOREST, SPLIT
from foldwright.functions.columns import feature_cols
from foldwright.operators.contributions import contributions, leaf_table, mean_abs_contribution
from foldwright.operators.cube import contingency_cube, mutual_information
from foldwright.operators.forest import COPIES, fit_folds, fold_aucs, in_parallel, recorded, run_key
from foldwright.operators.selection import feature_ranking, one_se_choice, selection_curve
from foldwright.operators.vectors import count_rows
from foldwright.plans.audit import tag_folds
from foldwright.session import materialize, scratch_path, small_table


def train_vectors(clean: DataFrame, features: Sequence[str], k: int = N_FOLDS) -> DataFrame:
    """Stored (features, group) counts of the train side with their fold.

    The one pass over the train rows of steps 2 and 3: folds, fits, scores and
    contributions depend on nothing else. Stored by fold, so a fold is left out by pruning.
    """
    train = count_rows(clean.where(F.col(SPLIT) == "train"), [*features, GROUP])
    return materialize(tag_folds(train, k), "train-vectors", ["fold"])


def cv_step(vectors: DataFrame, features: Sequence[str], params: Mapping, folds: Sequence[int],
            parallelism: int = N_FOLDS, copies: int = COPIES) -> tuple[DataFrame, DataFrame]:
    """Fold AUCs and mean absolute contributions of the forest on one feature subset."""
    models = fit_folds(vectors, features, params, folds, parallelism=parallelism, copies=copies)
    spark = vectors.sparkSession
    # Neither needs the other.
    aucs, leaves = in_parallel(spark, lambda part: part(), [lambda: fold_aucs(models, vectors), lambda: leaf_table(spark, models)], 2)
    return aucs, mean_abs_contribution(contributions(vectors, leaves, features), features)


def rolled_up(vectors: DataFrame, features: Sequence[str]) -> DataFrame:
    """Fold counts of the vectors of a subset, stored by fold, from those of a wider one."""
    narrow = vectors.groupBy("fold", *features).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    return materialize(narrow, f"subset-{len(features)}", ["fold"])


@dataclass
class Selection:
    history: DataFrame
    curve: DataFrame
    choice: DataFrame
    ranking: DataFrame
    selected: list[str]
    dropped: list[str]


@dataclass(frozen=True)
class Step:
    """What one feature subset achieved: an AUC per fold and a strength per feature, in feature order."""

    aucs: dict[int, float]
    strength: dict[str, float]

    @property
    def features(self) -> list[str]:
        return list(self.strength)

    @property
    def weakest(self) -> str:
        """The first of the features with the least strength."""
        return min(self.strength, key=self.strength.__getitem__)


def measured(vectors: DataFrame, subset: Sequence[str], params: Mapping, folds: Sequence[int],
             parallelism: int = N_FOLDS, copies: int = COPIES) -> Step:
    """The step of one subset. One AUC per fold and one number per feature reach the driver."""
    both = cv_step(vectors, subset, params, folds, parallelism, copies)
    aucs, shap = (dict(map(tuple, rows))
                  for rows in in_parallel(vectors.sparkSession, lambda df: df.collect(), both, 2))
    # The last bits of a sum follow the order of its rows; features that differ by no more are equal, and the first one goes.
    return Step(aucs, {f: round(shap[f], 12) for f in subset})


STEP_SCHEMA = "aucs map<int,double>, features array<string>, strengths array<double>, size int"


def eliminate(vectors: DataFrame, features: Sequence[str], params: Mapping, folds: Sequence[int] = range(N_FOLDS),
              parallelism: int = N_FOLDS, copies: int = COPIES, ledger: str | None = None) -> list[Step]:
    """One step per subset size, largest first; each subset is the one before without its weakest feature.

    The full vectors are read once: the table of each subset is rolled up from that of the step before, so it shrinks
    with the subsets. Each step leaves its record in ``ledger``; a run that starts with the ledger of one that was cut off
    goes on behind its last step.
    """
    spark = vectors.sparkSession
    root = ledger or scratch_path(spark, "elimination")
    folder = f"{root}/{run_key(vectors, list(features), params, list(folds), copies)}"
    before = recorded(spark, folder, STEP_SCHEMA)
    done = [] if before is None else sorted(before.collect(), key=lambda r: -r.size)
    steps = [Step(r.aucs, dict(zip(r.features, r.strengths))) for r in done]
    table = vectors
    while len(steps) < len(features):
        subset = [f for f in steps[-1].features if f != steps[-1].weakest] if steps else list(features)
        table = rolled_up(table, subset)
        step = measured(table, subset, params, folds, parallelism, copies)
        record = (step.aucs, step.features, list(step.strength.values()))
        small_table(spark, [record], "aucs map<int,double>, features array<string>, strengths array<double>").coalesce(1).write.mode(
            "overwrite").parquet(f"{folder}/size={len(subset)}")
        steps.append(step)
    return steps


HISTORY_SCHEMA = "n_features int, fold int, auc double, features array<string>, weakest string"


def history_rows(steps: Sequence[Step]) -> list[tuple]:
    """The rows of ``HISTORY_SCHEMA``: one per step and fold."""
    return [(len(s.features), fold, auc, s.features, s.weakest) for s in steps for fold, auc in s.aucs.items()]


def select_features(clean: DataFrame, params: Mapping = SELECTION_FOREST, k: int = N_FOLDS,
                    parallelism: int = N_FOLDS, copies: int = COPIES, ledger: str | None = None) -> Selection:
    """Selection on the train side of a clean table; the test side is never read.

    ``copies`` bounds the rows of one (vector, label) pair in every fit, see ``forest.training_rows``; ``ledger`` is a folder
    from which a run that was cut off goes on, see ``eliminate``.
    """
    spark = clean.sparkSession
    features = feature_cols(clean)
    vectors = train_vectors(clean, features, k)
    steps = eliminate(vectors, features, params, range(k), parallelism, copies, ledger)
    history = small_table(spark, history_rows(steps), HISTORY_SCHEMA)
    curve = selection_curve(history)
    choice = one_se_choice(curve)
    dropped = small_table(spark, [(s.weakest, i) for i, s in enumerate(steps, 1)], "feature string, elim_step int")
    importance = small_table(spark, list(steps[0].strength.items()), "feature string, initial_mean_abs_shap double")
    ranking = feature_ranking(dropped, importance,
                              mutual_information(contingency_cube(vectors, features, tags=())), choice)
    size = choice.first().chosen_n_features
    survivors = next(set(s.features) for s in steps if len(s.features) == size)
    return Selection(history, curve, choice, ranking,
                     selected=[f for f in features if f in survivors],
                     dropped=[f for f in features if f not in survivors])
