"""Forests and contributions: exactness where it exists, invariants elsewhere."""

import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwright.operators import contributions as contributions_module
from foldwright.operators import forest as R
from foldwright.operators.contributions import contributions, leaf_table, mean_abs_contribution, shapley, unpacked
from foldwright.operators import trees
from foldwright.operators.trees import subset_size
from foldwright.operators.vectors import count_rows
from foldwright.operators.predictions import prediction_table
from foldwright.plans import evaluate as E
from foldwright.plans import select as S
from foldwright.sources.models import decision_of, load_model, save_model
from foldwright.session import scratch_path

FEATURES = ["a", "b", "c"]
FEATURE_NUMBERS = range(3)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(-1, 2, (400, 3))
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 0.7, 400)) > 0).astype(int)
    rows = [(int(i % 3), *map(int, r), int(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "fold int, a byte, b byte, c byte, is_phishing int")
    return count_rows(df, ["fold", *FEATURES]).cache()


@pytest.mark.parametrize("impurity,block,group", [("gini", 1000, 100_000), ("entropy", 1000, 100_000), ("gini", 5, 20)])
def test_contributions_add_up_to_the_score(spark, vectors, impurity, block, group, monkeypatch):
    monkeypatch.setattr(contributions_module, "PART_LEAVES", 4)
    models = R.fit_folds(vectors, FEATURES, {"numTrees": 4, "maxDepth": 4, "seed": 1, "impurity": impurity}, range(3))
    explained = contributions(vectors, leaf_table(spark, models), FEATURES, block, group)
    both = explained.join(R.score_folds(models, vectors).select("fold", *FEATURES, "score"), ["fold", *FEATURES])
    rows = both.collect()
    assert len(rows) == vectors.count()
    for r in rows:
        assert sum(r.phi) + r.bias == pytest.approx(r.score, abs=1e-9)
        assert 0 <= r.score <= 1
    weak = {r.feature: r.mean_abs_shap for r in mean_abs_contribution(explained, FEATURES).collect()}
    want = {f: np.mean([sum(abs(r.phi[i]) * r.n for r in rows if r.fold == k) / sum(r.n for r in rows if r.fold == k)
                        for k in range(3)]) for i, f in enumerate(FEATURES)}
    assert weak == pytest.approx(want)


def tree_value(tree, x, known):
    """Expected leaf value when only the known features of the row are followed."""
    total = 0.0
    for i, value in enumerate(tree["value"]):
        part = value
        for f, low, high, share in zip(tree["feature"][i], tree["low"][i], tree["high"][i], tree["share"][i]):
            padding = np.isinf(low) and np.isinf(high)
            part *= 1.0 if padding else float(low < x[f] <= high) if f in known else share
        total += part
    return total


def test_contributions_are_shapley_values(spark, vectors):
    model = R.fit_forest(vectors, FEATURES, {"numTrees": 3, "maxDepth": 5, "seed": 3, "featureSubsetStrategy": "all"})
    trees = unpacked(leaf_table(spark, {0: model}).orderBy("tree").toPandas())
    assert len(trees) == 3
    for x in ([-1, 0, 1], [1, 1, -1], [0, 0, 0]):
        phi, bias = shapley(trees, np.array([x], float))
        for i in range(3):
            others = [j for j in range(3) if j != i]
            want = 0.0
            for size in range(3):
                for known in itertools.combinations(others, size):
                    gain = sum(tree_value(t, x, {*known, i}) - tree_value(t, x, set(known)) for t in trees) / 3
                    want += math.factorial(size) * math.factorial(2 - size) / 6 * gain
            assert phi[0, i] / 3 == pytest.approx(want, abs=1e-6)
        assert bias / 3 == pytest.approx(sum(tree_value(t, x, set()) for t in trees) / 3, abs=1e-6)


def test_training_rows_keep_the_weight_of_every_copy(spark):
    df = spark.createDataFrame([(1, 2500, 2200), (0, 3, 0)], "a int, n long, pos long")
    rows = R.training_rows(df, ["a"])
    got = {(r.a, r.is_phishing): (r.rows, r.weight) for r in rows.groupBy("a", "is_phishing").agg(
        F.count("*").alias("rows"), F.sum("weight").alias("weight")).collect()}
    assert got == {(1, 1): (1000, pytest.approx(2200)), (1, 0): (300, 300.0), (0, 0): (3, 3.0)}
    balanced = R.training_rows(df, ["a"], balanced=True).groupBy("is_phishing").agg(F.sum("weight").alias("w"))
    assert {r.is_phishing: r.w for r in balanced.collect()} == pytest.approx({0: 2503 / 2, 1: 2503 / 2})


@pytest.mark.parametrize("copies", [1, 7, 5000])
def test_copies_bound_the_rows_and_keep_the_weight(spark, copies):
    df = spark.createDataFrame([(1, 2500, 2200), (0, 3, 0)], "a int, n long, pos long")
    got = {(r.a, r.is_phishing): (r.rows, r.weight) for r in R.training_rows(df, ["a"], copies=copies).groupBy(
        "a", "is_phishing").agg(F.count("*").alias("rows"), F.sum("weight").alias("weight")).collect()}
    assert got == {key: (min(n, copies), pytest.approx(n)) for key, n in {(1, 1): 2200, (1, 0): 300, (0, 0): 3}.items()}


@pytest.mark.parametrize("copies", [2, 1000])
def test_a_seed_gives_one_forest_whatever_the_session_and_the_arrival(spark, vectors, monkeypatch, copies):
    monkeypatch.setattr(R, "ROWS_PER_TASK", 30)
    params = {"numTrees": 4, "maxDepth": 4, "subsamplingRate": 0.8, "seed": 5, "featureSubsetStrategy": "sqrt"}
    old, trees = spark.conf.get("spark.sql.shuffle.partitions"), set()
    try:
        for width in (1, 4, 8, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(width))
            arrival = vectors.repartition(width + 1).orderBy(F.xxhash64(*FEATURES, F.lit(width)))
            trees.add(R.fit_forest(arrival, FEATURES, params, copies=copies).stages[-1].toDebugString.split("\n", 1)[1])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(trees) == 1


def test_trees_without_sampling_are_those_of_spark(spark, vectors):
    params = {"numTrees": 2, "maxDepth": 5, "bootstrap": False, "featureSubsetStrategy": "all", "seed": 3, "minInstancesPerNode": 3}
    model, rows = R.fit_forest(vectors, FEATURES, params), R.training_rows(vectors, FEATURES)
    want = R._learner(params).fit(model.stages[0].transform(rows).drop(*FEATURES))
    assert model.stages[1].totalNumNodes == want.totalNumNodes
    assert model.stages[1].featureImportances.toArray() == pytest.approx(want.featureImportances.toArray())
    both = R.score(model, vectors).withColumnRenamed("score", "own")
    for r in want.transform(model.stages[0].transform(both)).collect():
        assert r.own == pytest.approx(r.prediction, abs=1e-12)


@pytest.mark.parametrize("bootstrap", [False, True])
def test_a_fit_costs_no_row_per_copy_and_samples_the_share_of_them(spark, bootstrap):
    df = spark.createDataFrame([(1, 10**9, 8 * 10**8), (0, 10**9, 10**8)], "a int, n long, pos long")
    params = {"numTrees": 3, "maxDepth": 2, "subsamplingRate": 0.5, "bootstrap": bootstrap, "seed": 1}
    model = R.fit_forest(df, ["a"], params, copies=10**9)
    for r in leaf_table(spark, {0: model}).collect():
        assert r.leaves == 2
    for tree in model.stages[1].trees:
        root = tree._call_java("rootNode").impurityStats()
        assert root.count() == pytest.approx(10**9, rel=1e-3) and root.count() != 10**9
    assert {r.a: r.score for r in R.score(model, df).collect()} == pytest.approx({1: 0.8, 0: 0.1}, abs=1e-3)


def test_a_forest_does_not_depend_on_tasks(spark, vectors):
    params = {"numTrees": 4, "maxDepth": 4, "subsamplingRate": 0.8, "bootstrap": False, "seed": 5}
    one, other = (R.fit_forest(vectors, FEATURES, params, partitions=n).stages[-1].toDebugString.split("\n", 1)[1] for n in (1, 3))
    assert one == other


@pytest.mark.parametrize("balanced", [False, True])
def test_forests_of_folds_grow_at_once_and_are_those_of_single_fits(spark, vectors, monkeypatch, balanced):
    params, levels, best_cuts = {"numTrees": 3, "maxDepth": 3, "subsamplingRate": 0.8, "bootstrap": False, "seed": 5}, [], trees.best_cuts
    single = {k: R.fit_forest(vectors.where(F.col("fold") != k), FEATURES, params, balanced) for k in range(3)}
    monkeypatch.setattr(trees, "best_cuts", lambda *args: levels.append(1) or best_cuts(*args))
    together = R.fit_folds(vectors, FEATURES, params, range(3), balanced)
    assert len(levels) <= 3
    # Sums of fractional class weights follow the order of rows in their last bits.
    text = [{k: re.sub(r"\d+\.\d+", lambda n: f"{float(n[0]):.9f}", m.stages[1].toDebugString.split("\n", 1)[1])
             for k, m in models.items()} for models in (single, together)]
    assert text[0] == text[1] and len(set(text[0].values())) == 3


def test_hashes_of_arrays_are_those_of_spark(spark):
    seeds = {"int": (np.int32, [42, -7]), "bigint": (np.int64, [2**40, -2**62])}
    for kind, (dtype, values) in seeds.items():
        rows = [(s, t, n, f) for s in values for t in (0, 299) for n in (1, 2**30 + 5) for f in range(3)]
        df = spark.createDataFrame(rows, f"s {kind}, t int, n bigint, f int")
        columns = [np.array(c, d) for c, d in zip(zip(*rows), (dtype, np.int32, np.int64, np.int32))]
        assert [r.h for r in df.select(F.xxhash64("s", "t", "n", "f").alias("h")).collect()] == trees.hashed(*columns).tolist()


def forest_text(model):
    return re.sub(r"\d+\.\d+", lambda n: f"{float(n[0]):.9f}", model.stages[1].toDebugString.split("\n", 1)[1])


@pytest.mark.parametrize("params", [{"seed": 5}, {"seed": 2**40, "minInstancesPerNode": 4, "minInfoGain": 0.01, "bootstrap": True}])
def test_small_nodes_need_no_levels_and_give_the_same_forest(spark, vectors, monkeypatch, params):
    params = {"numTrees": 3, "maxDepth": 5, "subsamplingRate": 0.8, "bootstrap": False, "featureSubsetStrategy": "0.6", **params}
    levels, best_cuts, texts = [], trees.best_cuts, {}
    monkeypatch.setattr(trees, "best_cuts", lambda *args: levels.append(1) or best_cuts(*args))
    # All nodes grow in tasks, in lots of one node or more; those of up to 15 pairs do; none does.
    for nodes, lots, sums in ((20_000, 20_000, 10**6), (100, 1, 1), (15, 20, 10), (0, 20, 10)):
        for name, value in (("NODE_PAIRS", nodes), ("LOT_PAIRS", lots), ("LOT_SUMS", sums)):
            monkeypatch.setattr(trees, name, value)
        levels.clear()
        texts[nodes] = {k: forest_text(m) for k, m in R.fit_folds(vectors, FEATURES, params, range(3), True).items()}
        assert (len(levels) > 0) == (nodes < 100)
    assert len(set(texts[0].values())) == 3 and all(t == texts[0] for t in texts.values())


def test_trees_without_cuts_and_rows_are_roots(spark, monkeypatch):
    df = spark.createDataFrame([(1, 1, 1)], "a int, n long, pos long")
    for nodes in (20_000, 0):
        monkeypatch.setattr(trees, "NODE_PAIRS", nodes)
        for depth in (0, 2):
            model = R.fit_forest(df, ["a"], {"numTrees": 8, "maxDepth": depth, "subsamplingRate": 0.5, "bootstrap": False, "seed": 1}).stages[1]
            assert model.totalNumNodes == 8
            assert {t._call_java("rootNode").prediction() for t in model.trees} == {0.0, 1.0}


def test_draws_are_made_once_and_behind_the_spread(spark, vectors):
    learner = R._learner({"numTrees": 3, "seed": 1})
    pairs = R.VectorAssembler(inputCols=FEATURES, outputCol="_x").transform(R.training_pairs(vectors, FEATURES)).withColumn("forest", F.lit(0))
    cuts = spark.createDataFrame([(0, [[0.5]] * 3)], "forest int, cuts array<array<double>>")
    plan = trees.sampled(pairs.repartition(4), cuts, learner, 1000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("drawn(") == 1


@pytest.mark.parametrize("balanced", [False, True])
def test_pairs_of_all_folds_are_those_of_each(spark, vectors, balanced):
    columns = [*FEATURES, "is_phishing", "m", "class_weight"]
    got = sorted(R.fold_pairs(vectors, FEATURES, range(3), balanced).select("forest", *columns).collect())
    want = [(k, *r) for k in range(3) for r in R.training_pairs(vectors.where(F.col("fold") != k), FEATURES, balanced).select(columns).collect()]
    assert got == sorted(want)


def test_a_fitted_forest_is_not_written_again_for_its_leaves(spark, vectors, monkeypatch):
    model, written = R.fit_forest(vectors, FEATURES, {"numTrees": 3, "maxDepth": 3, "seed": 1}), []
    monkeypatch.setattr(contributions_module, "scratch_path", lambda s, name: written.append(name) or scratch_path(s, name))
    key = ["fold", "tree", "part"]
    got = leaf_table(spark, {0: model}).orderBy(key).collect()
    assert written == []
    # A folder that is gone is no reason to fail.
    model.stages[1].stored += "-gone"
    assert leaf_table(spark, {0: model}).orderBy(key).collect() == got and written == ["forest"]


@pytest.mark.parametrize("block,cells", [(2, 3), (64, 8), (1000, 10**6)])
def test_contributions_do_not_depend_on_the_blocks_of_a_task(spark, vectors, monkeypatch, block, cells):
    leaves = unpacked(leaf_table(spark, {0: R.fit_forest(vectors, FEATURES, {"numTrees": 3, "maxDepth": 5, "seed": 3})}).toPandas())
    x = np.array(list(itertools.product([-1, 0, 1], repeat=3)), float)
    want = np.array([[sum(tree_value(t, row, set(FEATURE_NUMBERS)) - tree_value(t, row, set()) for t in leaves)] for row in x])
    monkeypatch.setattr(contributions_module, "BLOCK", block)
    monkeypatch.setattr(contributions_module, "CELLS", cells)
    phi, bias = shapley(leaves, x)
    assert phi.sum(axis=1) == pytest.approx(want[:, 0], abs=1e-9)
    assert phi == pytest.approx(np.concatenate([shapley(leaves, row[None])[0] for row in x]), abs=1e-12)


def test_trees_of_a_model_become_objects_only_when_asked_for(spark, vectors):
    model = R.fit_forest(vectors, FEATURES, {"numTrees": 4, "maxDepth": 2, "seed": 5})
    forest = model.stages[1]
    R.score(model, vectors).collect()
    forest.save(scratch_path(spark, "model"))
    assert "trees" not in vars(forest)
    assert len(forest.trees) == forest.getNumTrees == 4 and forest.getOrDefault("maxDepth") == 2


def test_features_that_a_node_looks_at():
    sizes = {s: subset_size(s, 7, 300) for s in ("all", "auto", "sqrt", "log2", "onethird", "0.6", "0.5", "3", "9")}
    assert sizes == {"all": 7, "auto": 3, "sqrt": 3, "log2": 3, "onethird": 3, "0.6": 5, "0.5": 4, "3": 3, "9": 7}


def test_hold_out_rows_are_scored_once_per_vector(spark, vectors, monkeypatch):
    rows = [(i, i % 4 // 2 - 1, 0, 1, int(i % 3 == 0), i % 4 // 2, "test" if i % 5 else "train") for i in range(400)]
    clean = spark.createDataFrame(rows, "row_index long, a byte, b byte, c byte, is_phishing int, group_id long, split string")
    model, scored = R.fit_forest(vectors, FEATURES, {"numTrees": 3, "maxDepth": 3, "seed": 1}), []
    want = prediction_table(R.score(model, clean.where("split = 'test'")), FEATURES, "test")
    monkeypatch.setattr(E, "score", lambda m, df: scored.append(df.count()) or R.score(m, df))
    got = E.test_predictions(clean, model, FEATURES)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    assert scored == [2] and got.count() == 320


SPACE = {"n_estimators": range(2, 4), "max_depth": [2, None], "class_weight": [None, "balanced"],
         "max_features": ["sqrt", 0.5, None], "criterion": ["gini", "entropy"], "min_samples_split": range(2, 20)}


def test_search_reports_every_fold_and_the_first_best_trial(spark, vectors):
    found = R.search(vectors, FEATURES, range(3), SPACE, 3)
    rows = found.trials.collect()
    assert len(rows) == 9 and (found.fits, found.resumed) == (9, 0)
    means = {r.trial: r.mean_auc for r in rows}
    first = min(t for t, m in means.items() if m == max(means.values()))
    assert found.best_auc == means[first] and next(r.params for r in rows if r.trial == first) == {
        k: str(v) for k, v in found.best.items()}
    for t, mean in means.items():
        assert mean == pytest.approx(np.mean([r.auc for r in rows if r.trial == t]))
    params, balanced = R.spark_params(found.best)
    again = R.fold_aucs(R.fit_folds(vectors, FEATURES, params, range(3), balanced), vectors)
    assert {r.fold: r.auc for r in again.collect()} == pytest.approx({r.fold: r.auc for r in rows if r.trial == first})


def test_an_interrupted_search_goes_on_where_it_was(spark, vectors, monkeypatch):
    whole = R.search(vectors, FEATURES, range(3), SPACE, 4)
    ledger, fit, made = scratch_path(spark, "ledger"), R.fit_forest, []

    def failing(*args, **more):
        if len(made) >= 5:
            raise RuntimeError("executor lost")
        made.append(1)
        return fit(*args, **more)

    monkeypatch.setattr(R, "fit_forest", failing)
    with pytest.raises(RuntimeError):
        R.search(vectors, FEATURES, range(3), SPACE, 4, parallelism=2, ledger=ledger)
    monkeypatch.setattr(R, "fit_forest", fit)
    again = R.search(vectors, FEATURES, range(3), SPACE, 4, ledger=ledger)
    assert 0 < again.resumed <= 5 and again.fits + again.resumed == 12
    assert (again.best, again.best_auc) == (whole.best, whole.best_auc)
    assert sorted(map(str, again.trials.collect())) == sorted(map(str, whole.trials.collect()))
    once_more = R.search(vectors, FEATURES, range(3), SPACE, 4, ledger=ledger)
    assert (once_more.fits, once_more.resumed, once_more.best) == (0, 12, whole.best)
    other = R.search(vectors.withColumn("n", F.col("n") + 1), FEATURES, range(3), SPACE, 1, ledger=ledger)
    assert other.resumed == 0  # other rows are other work


def test_an_interrupted_elimination_goes_on_and_reads_the_full_vectors_once(spark, vectors, monkeypatch):
    params, ledger = {"numTrees": 3, "maxDepth": 3, "seed": 4}, scratch_path(spark, "ledger")
    whole = S.eliminate(vectors, FEATURES, params, range(3))
    assert [len(s.features) for s in whole] == [3, 2, 1]
    measured, seen = S.measured, []

    def failing(table, subset, *args):
        seen.append((len(subset), table.columns))
        if len(subset) == 1:
            raise RuntimeError("executor lost")
        return measured(table, subset, *args)

    monkeypatch.setattr(S, "measured", failing)
    with pytest.raises(RuntimeError):
        S.eliminate(vectors, FEATURES, params, range(3), ledger=ledger)
    assert [set(c) - {"fold", "n", "pos"} for _, c in seen] == [set(FEATURES), set(whole[1].features), set(whole[2].features)]
    monkeypatch.setattr(S, "measured", lambda table, subset, *args: seen.append(len(subset)) or measured(table, subset, *args))
    again = S.eliminate(vectors, FEATURES, params, range(3), ledger=ledger)
    assert [(s.features, s.weakest) for s in again] == [(s.features, s.weakest) for s in whole]
    for one, other in zip(again, whole):
        assert one.aucs == pytest.approx(other.aucs) and one.strength == pytest.approx(other.strength)
    assert seen[3:] == [1]


def test_a_step_on_rolled_up_vectors_is_that_on_the_full_ones(spark, vectors):
    params = {"numTrees": 3, "maxDepth": 3, "seed": 4}
    full = S.measured(vectors, ["a", "b"], params, range(3))
    rolled = S.measured(S.rolled_up(vectors, ["a", "b"]), ["a", "b"], params, range(3))
    assert rolled.aucs == pytest.approx(full.aucs) and rolled.strength == pytest.approx(full.strength)


def test_parameter_mapping():
    params, balanced = R.spark_params({"n_estimators": 300, "max_depth": None, "min_samples_leaf": 4,
                                       "min_samples_split": 19, "max_features": None, "class_weight": "balanced",
                                       "criterion": "entropy"})
    assert balanced and params == {"seed": 42, "numTrees": 300, "maxDepth": 30, "featureSubsetStrategy": "all",
                                   "impurity": "entropy", "minInstancesPerNode": 10}
    assert R.draw_trials({"x": range(100)}, 3) == R.draw_trials({"x": range(100)}, 3)


def test_reloaded_model_scores_the_same(spark, vectors):
    model = R.fit_forest(vectors, FEATURES, {"numTrees": 3, "maxDepth": 3, "seed": 1})
    path = scratch_path(spark, "model")
    save_model(spark, model, path)
    again, features, positive = load_model(spark, path)
    assert (features, positive) == (FEATURES, "phishing")
    key = ["fold", *FEATURES, "score"]
    a, b = (sorted(R.score(m, vectors).select(*key).collect()) for m in (model, again))
    assert a == b
    assert decision_of(again).value("threshold") == 0.5 and again.transform(vectors).columns == [
        *vectors.columns, "score", "predicted_label", "predicted_class"]


@pytest.mark.parametrize("impurity", ["gini", "entropy"])
def test_a_saved_threshold_decides(spark, vectors, impurity):
    model = R.fit_forest(vectors, FEATURES, {"numTrees": 3, "maxDepth": 3, "seed": 1, "impurity": impurity})
    path = scratch_path(spark, "model")
    save_model(spark, model, path, threshold=0.3)
    rows = load_model(spark, path)[0].transform(vectors).collect()
    scores = {(r.fold, r.a, r.b, r.c): r.score for r in R.score(model, vectors).collect()}
    assert all(r.score == scores[r.fold, r.a, r.b, r.c] and r.predicted_label == int(r.score >= 0.3) for r in rows)
    assert {(r.predicted_label, r.predicted_class) for r in rows} == {(0, "legitimate"), (1, "phishing")}
