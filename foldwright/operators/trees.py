"""Regression trees of a forest on the 0/1 label, grown level by level over distinct vectors.

All copies of one (vector, label) pair fall into the same node of every tree, so a tree need
not meet them one by one: the number of them that it samples is one draw, binomial without
replacement and Poisson with it, which is how the sum of the single draws is distributed.
A fit costs pairs x trees x levels, however many rows are behind the pairs.

The sampled pairs of all trees of all forests that are fitted together (those of the folds)
are one table with their node. A level is an aggregation per
(forest, tree, node, feature, bin), running sums over the bins, the best cut of every node, and a join that
sends the pairs to its children, so the jobs of a fit follow from its levels, not from its forests. A node
of few enough pairs for one task leaves that table: nodes are dealt into lots of bounded size, and a task grows all that
is below the nodes of a lot. Draws follow
from the seed and the pair, so a forest does not depend on partitions or on the forests beside it.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from foldwright.constants import LABEL
from foldwright.session import in_parallel, materialize, replace_path, scratch_path, small_table, tasks_for

# Ship the functions of this module with the tasks, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Digits to which gains are compared: the last bits of a sum follow the order of its rows.
GAIN_DIGITS = 12

# Draws of one task, a draw for every tree and pair.
DRAWS_PER_TASK = 200_000

# Sampled pairs of the largest node that one task grows to its leaves, and of a lot of such nodes.
NODE_PAIRS = LOT_PAIRS = 20_000

# Sums of a lot that are held at once, one for each node, feature and bin.
LOT_SUMS = 1_000_000

NODE = ["forest", "tree", "node"]
SUMS = ["rows", "weight", "positive"]
SIDES = [f"{side}_{s}" for side in ("left", "right") for s in SUMS]
# The table of the nodes in the saved form of a forest.
NODES = ("treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, "
         "gain: double, leftChild: int, rightChild: int, "
         "split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>")
CUTS = "forest int, tree int, node bigint, feature int, bin int, gain double, " + ", ".join(
    f"{s} {'bigint' if s.endswith('rows') else 'double'}" for s in SIDES)


class GrownForest(RandomForestRegressionModel):
    """A forest whose trees become Python objects only for those who ask for them.

    Spark keeps them in an attribute that every look at the parameters of a model fills: a call per tree and parameter on the driver.
    ``stored`` is the folder to which the fit has written the forest, in the form of a saved one.
    """

    stored: str | None = None

    @property
    def trees(self) -> list[DecisionTreeRegressionModel]:
        return [DecisionTreeRegressionModel(tree) for tree in self._call_java("trees")]


class ForestLearner(RandomForestRegressor):
    """The regressor of Spark, with models that are a ``GrownForest``."""

    def _create_model(self, java_model) -> GrownForest:
        return GrownForest(java_model)


def load_forest(path: str) -> GrownForest:
    """A saved regression forest, with its parameters."""
    model = GrownForest(RandomForestRegressionModel.read()._jread.load(path))
    model._transfer_params_from_java()
    return model


def subset_size(strategy: str, features: int, trees: int) -> int:
    """Features that a node looks at, by the names and numbers that ``featureSubsetStrategy`` takes."""
    named = {"all": features, "onethird": math.ceil(features / 3), "sqrt": math.ceil(math.sqrt(features)),
             "log2": max(1, math.ceil(math.log2(features))), "auto": features if trees == 1 else math.ceil(features / 3)}
    if strategy in named:
        return named[strategy]
    return min(features, int(strategy)) if strategy.isdigit() else max(1, math.ceil(float(strategy) * features))


def thresholds(pairs: DataFrame, bins: int) -> dict[int, list[list[float]]]:
    """The cuts of every feature by forest: between all its values if they are at most ``bins``, else between that many quantiles of them."""
    values = pairs.select("forest", F.posexplode(vector_to_array("_x")).alias("feature", "value")).distinct()
    found = values.groupBy("forest", "feature").agg(F.percentile_approx("value", [i / bins for i in range(1, bins + 1)]).alias("values"))
    cuts = {}
    for r in found.orderBy("forest", "feature").collect():
        marks = sorted(set(r["values"]))
        cuts.setdefault(r.forest, []).append([(a + b) / 2 for a, b in zip(marks, marks[1:])])
    return cuts


def _draws(rate: float, bootstrap: bool, trees: int, seed: int):
    @F.pandas_udf("array<bigint>")
    def drawn(copies: pd.Series, key: pd.Series) -> pd.Series:
        """How many of its copies every tree samples."""
        out = []
        for n, k in zip(copies, key):
            rng = np.random.default_rng([seed % 2**64, k % 2**64])
            out.append((rng.poisson(rate * n, trees) if bootstrap else rng.binomial(n, rate, trees)).astype(np.int64))
        return pd.Series(out)

    return drawn


def sampled(pairs: DataFrame, cuts: DataFrame, learner: RandomForestRegressor, copies: int) -> DataFrame:
    """(forest, tree, bins, rows, weight, positive): what every tree samples of every pair, bins being its values by number of cuts below."""
    trees = learner.getNumTrees()
    drawn = _draws(learner.getSubsamplingRate(), learner.getBootstrap(), trees, learner.getSeed())
    bins = F.zip_with(vector_to_array("_x"), F.col("cuts"), lambda x, c: F.size(F.filter(c, lambda t: t < x)))
    # Bins are found before the draws multiply the pairs.
    each = pairs.join(F.broadcast(cuts), "forest").select(
        "forest", bins.alias("bins"), F.col(LABEL), (F.col("class_weight") * F.col("m") / F.least("m", F.lit(copies))).alias("each"),
        drawn(F.least("m", F.lit(copies)), F.xxhash64(vector_to_array("_x"), LABEL)).alias("all_drawn"))
    # No draws are empty. The plain form would filter such ones first, by drawing below the repartition a second time.
    each = each.select("forest", "bins", LABEL, "each", F.posexplode_outer("all_drawn").alias("tree", "rows")).where("rows > 0")
    weight = F.col("rows") * F.col("each")
    return each.select("forest", "tree", "bins", "rows", weight.alias("weight"), (weight * F.col(LABEL)).alias("positive"))


def _variance(weight: Column, positive: Column) -> Column:
    share = positive / weight
    return share - share * share


def best_cuts(state: DataFrame, least: int, min_gain: float) -> DataFrame:
    """The cut of highest gain of every node that has one, with the sums and pairs of its sides: the first of equal features and cuts."""
    measures = [*SUMS, "pairs"]
    each = state.repartition(*NODE).select(*NODE, "bins", *SUMS, F.explode("looked_at").alias("feature"))
    hist = each.groupBy(*NODE, "feature", F.get("bins", F.col("feature")).alias("bin")).agg(
        *[F.sum(s).alias(s) for s in SUMS], F.count(F.lit(1)).alias("pairs"))
    whole = Window.partitionBy(*NODE, "feature")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sides = hist.select(*NODE, "feature", "bin", *[F.sum(s).over(upto).alias(f"left_{s}") for s in measures],
                        *[F.sum(s).over(whole).alias(f"all_{s}") for s in measures])
    sides = sides.select("*", *[(F.col(f"all_{s}") - F.col(f"left_{s}")).alias(f"right_{s}") for s in measures]).where(
        (F.col("left_rows") >= least) & (F.col("right_rows") >= least))
    impurity = {side: _variance(F.col(f"{side}_weight"), F.col(f"{side}_positive")) for side in ("left", "right", "all")}
    lost = sum(F.col(f"{side}_weight") / F.col("all_weight") * impurity[side] for side in ("left", "right"))
    gain = F.round(impurity["all"] - lost, GAIN_DIGITS)
    about = [*SIDES, "left_pairs", "right_pairs"]
    first = F.max(F.struct(gain.alias("gain"), (-F.col("feature")).alias("_feature"), (-F.col("bin")).alias("_bin"), *about))
    return sides.groupBy(*NODE).agg(first.alias("best")).where(
        (F.col("best.gain") > 0) & (F.col("best.gain") >= min_gain)).select(
        *NODE, (-F.col("best._feature")).alias("feature"), (-F.col("best._bin")).alias("bin"), "best.gain", *[f"best.{a}" for a in about])


# Constants of xxHash64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def hashed(*columns: np.ndarray) -> np.ndarray:
    """``F.xxhash64`` of columns of 32-bit and 64-bit whole numbers."""
    h = np.full(np.broadcast_shapes(*(c.shape for c in columns)), 42, np.uint64)
    for c in columns:
        h = h + P5 + np.uint64(c.itemsize)
        if c.itemsize == 4:
            h = _turned(h ^ (c.astype(np.uint32).astype(np.uint64) * P1), 23) * P2 + P3
        else:
            h = _turned(h ^ (_turned(c.astype(np.uint64) * P2, 31) * P1), 27) * P1 + P4
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        h = h ^ (h >> np.uint64(32))
    return h.astype(np.int64)


def _lot_cuts(tree: np.ndarray, node: np.ndarray, at: np.ndarray, bins: np.ndarray, sums: np.ndarray, seed: np.ndarray, size: int,
              least: int, min_gain: float) -> tuple[np.ndarray, ...]:
    """``best_cuts`` of some nodes in arrays: (has one, feature, bin, gain, sums of its left side, of its right side)."""
    numbers = np.arange(bins.shape[1], dtype=np.int32)
    ranks = hashed(seed, tree[:, None], node[:, None], numbers)
    looked = np.sort(np.argsort(ranks, axis=1, kind="stable")[:, :size], axis=1)
    values, width = np.take_along_axis(bins, looked[at], 1), int(bins.max()) + 1
    cells, shape = ((at[:, None] * size + np.arange(size)) * width + values).ravel(), (len(node), size, width)
    upto = np.array([np.bincount(cells, np.repeat(s, size), math.prod(shape)) for s in sums]).reshape(len(sums), *shape).cumsum(axis=3)
    whole = upto[..., -1:]
    sides = {"left": upto, "right": whole - upto, "all": whole}
    with np.errstate(divide="ignore", invalid="ignore"):
        share = {side: s[2] / s[1] for side, s in sides.items()}
        spread = {side: v - v * v for side, v in share.items()}
        lost = sum(sides[side][1] / whole[1] * spread[side] for side in ("left", "right"))
        gain = np.round(spread["all"] - lost, GAIN_DIGITS)
    gain = np.where((upto[0] >= least) & (sides["right"][0] >= least), gain, -1.0).reshape(len(node), -1)
    first = gain.argmax(axis=1)
    best = gain[np.arange(len(node)), first]
    number, cut = first // width, first % width
    left, right = (sides[side][:, np.arange(len(node)), number, cut] for side in ("left", "right"))
    return (best > 0) & (best >= min_gain), looked[np.arange(len(node)), number], cut, best, left, right


def as_cuts(roots: DataFrame) -> DataFrame:
    """Roots (forest, tree, sums) among the cuts: a root is the right side of a cut of the node 0, which no tree has."""
    none, zero = F.lit(-1), F.lit(0).cast("long")
    return roots.select("forest", "tree", zero.alias("node"), none.alias("feature"), none.alias("bin"), none.cast("double").alias("gain"),
                        *[F.lit(0).cast(k).alias(f"left_{s}") for s, k in zip(SUMS, ("long", "double", "double"))],
                        *[F.col(s).alias(f"right_{s}") for s in SUMS])


def grown(state: DataFrame, lots: int, levels: int, learner: RandomForestRegressor, size: int) -> DataFrame:
    """(``CUTS``): all cuts of up to ``levels`` levels from the nodes of the state on, whose lots are grown in one task each.

    The cuts are those that ``best_cuts`` finds level by level. A root is there as well, see ``as_cuts``.
    """
    least, min_gain = learner.getMinInstancesPerNode(), learner.getMinInfoGain()
    # Spark hashes a small number as one of 32 bits.
    seed = np.full((1, 1), learner.getSeed(), np.int32 if -2**31 <= learner.getSeed() < 2**31 else np.int64)
    schema = to_arrow_schema(StructType.fromDDL(CUTS))

    def grow(lot: pa.Table) -> pa.Table:
        bins = lot["bins"].combine_chunks().flatten().to_numpy().reshape(lot.num_rows, -1)
        forest, tree, node = (lot[c].to_numpy() for c in NODE)
        sums = np.array([lot[s].to_numpy() for s in SUMS], float)
        # Sums are taken in this order, so they do not depend on the arrival of the pairs.
        order = np.lexsort((*sums, *bins.T, node, tree, forest))
        forest, tree, node, bins, sums = forest[order], tree[order], node[order], bins[order], sums[:, order]
        first = np.flatnonzero((node == 1) & np.r_[True, (np.diff(tree) != 0) | (np.diff(forest) != 0)])
        found = [(forest[first], tree[first], *([x] * len(first) for x in (0, -1, -1, -1.0, 0, 0, 0)),
                  *(np.add.reduceat(sums, first, axis=1) if len(first) else np.zeros((len(SUMS), 0))))]
        for _ in range(levels):
            if not len(node):
                break
            starts = np.flatnonzero(np.r_[True, (np.diff(node) != 0) | (np.diff(tree) != 0) | (np.diff(forest) != 0)])
            ends = np.r_[starts[1:], len(node)]
            step = max(1, LOT_SUMS // (size * (int(bins.max()) + 1)))
            kept = []
            for i in range(0, len(starts), step):
                own, ids = slice(starts[i], ends[i:i + step][-1]), starts[i:i + step]
                at = np.repeat(np.arange(len(ids)), ends[i:i + step] - ids)
                cut, feature, last, gain, left, right = _lot_cuts(
                    tree[ids], node[ids], at, bins[own], sums[:, own], seed, size, least, min_gain)
                found.append((forest[ids][cut], tree[ids][cut], node[ids][cut], feature[cut], last[cut], gain[cut], *left[:, cut], *right[:, cut]))
                goes_right = np.take_along_axis(bins[own], feature[at][:, None], 1)[:, 0] > last[at]
                mixed = np.array([(s[2] > 0) & (s[2] < s[1]) for s in (left, right)])
                on = np.flatnonzero(cut[at] & mixed[goes_right.astype(int), at])
                # The pairs of a node become those of its left child, then those of its right one.
                kept.append((own.start + on)[np.argsort(2 * at[on] + goes_right[on], kind="stable")])
                node[own] = 2 * node[own] + goes_right
            kept = np.concatenate(kept)
            forest, tree, node, bins, sums = forest[kept], tree[kept], node[kept], bins[kept], sums[:, kept]
        columns = [np.concatenate(c) for c in zip(*found)]
        return pa.table([pa.array(c).cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    dealt = state.select(*NODE, "bins", *SUMS, F.pmod(F.xxhash64(*NODE), F.lit(lots)).alias("lot"))
    return dealt.groupBy("lot").applyInArrow(grow, CUTS)


def fit_trees(pairs: DataFrame, assembler: Transformer, learner: RandomForestRegressor, copies: int) -> RandomForestRegressionModel:
    """The forest of ``learner`` on (features, label, m, class_weight), of which up to ``copies`` are sampled one by one."""
    return fit_forests(pairs.withColumn("forest", F.lit(0)), assembler, learner, copies)[0]


def fit_forests(pairs: DataFrame, assembler: Transformer, learner: RandomForestRegressor, copies: int,
                ) -> dict[int, RandomForestRegressionModel]:
    """One forest of ``learner`` for each ``forest`` of the pairs, all grown at once: each is the one that ``fit_trees`` makes of its pairs."""
    spark = pairs.sparkSession
    pairs = materialize(assembler.transform(pairs).select("forest", "_x", LABEL, "m", "class_weight"), "pairs")
    by_forest, most = in_parallel(spark, lambda find: find(), [
        lambda: thresholds(pairs, learner.getMaxBins()),
        lambda: {r["forest"]: r["count"] for r in pairs.groupBy("forest").count().collect()}], 2)
    if not by_forest:
        raise ValueError("a forest needs training rows")
    # The forms of the models are saved while the cuts are found.
    found, path = in_parallel(spark, lambda part: part(), [
        lambda: _found_cuts(pairs, by_forest, most, len(assembler.getInputCols()), learner, copies),
        lambda: _saved_forms(spark, list(by_forest), assembler, learner)], 2)
    return _models(found, path, by_forest)


def _found_cuts(pairs: DataFrame, by_forest: Mapping[int, list[list[float]]], most: Mapping[int, int], features: int,
                learner: RandomForestRegressor, copies: int) -> DataFrame:
    """(``CUTS``): the cuts and roots of all trees of all forests; ``most`` is the number of pairs by forest."""
    spark, trees = pairs.sparkSession, learner.getNumTrees()
    cuts = small_table(spark, list(by_forest.items()), "forest int, cuts array<array<double>>")
    numbers = F.sequence(F.lit(0), F.lit(features - 1))
    size = subset_size(learner.getFeatureSubsetStrategy(), features, trees)

    def looked_at(node: Column) -> Column:
        ranked = F.array_sort(F.transform(numbers, lambda f: F.struct(
            F.xxhash64(F.lit(learner.getSeed()), "tree", node, f).alias("h"), f.alias("f"))))
        return F.slice(F.transform(ranked, lambda x: x["f"]), 1, size)

    root = F.lit(1).cast("long")
    first = spark.range(trees).select(F.col("id").cast("int").alias("tree")).withColumn("looked_at", looked_at(root))
    # The pairs of a forest bound those that a tree of it samples.
    bound = small_table(spark, list(most.items()), "forest int, node_pairs bigint")
    spread = pairs.repartition(tasks_for(spark, sum(most.values()) * trees, DRAWS_PER_TASK))
    state = sampled(spread, cuts, learner, copies).join(F.broadcast(first), "tree").join(F.broadcast(bound), "forest").withColumn("node", root)
    small = sum(n for n in most.values() if n <= NODE_PAIRS) * trees
    large = max(most.values()) > NODE_PAIRS
    # The cuts of all levels and lots lie in folders which are read once in the end.
    levels, paths = scratch_path(spark, "levels"), []
    if large:
        state = materialize(state, "sampled")
        paths.append(f"{levels}/roots")
        as_cuts(state.where(F.col("node_pairs") > NODE_PAIRS).groupBy("forest", "tree").agg(*[F.sum(s).alias(s) for s in SUMS])).write.parquet(paths[-1])
    deepest = learner.getMaxDepth()
    for depth in range(deepest + 1):
        if small:
            paths.append(f"{levels}/lots={depth}")
            grown(state.where(F.col("node_pairs") <= NODE_PAIRS), -(-small // LOT_PAIRS), deepest - depth, learner, size).write.parquet(paths[-1])
        if not large or depth == deepest:
            break
        cut = best_cuts(state.where(F.col("node_pairs") > NODE_PAIRS), learner.getMinInstancesPerNode(), learner.getMinInfoGain())
        paths.append(f"{levels}/level={depth}")
        cut.write.parquet(paths[-1])
        if depth + 1 == deepest:
            break
        found = spark.read.schema(cut.schema).parquet(paths[-1])
        left, right = 2 * F.col("node"), 2 * F.col("node") + 1
        mixed = {side: (F.col(f"{side}_positive") > 0) & (F.col(f"{side}_positive") < F.col(f"{side}_weight")) for side in ("left", "right")}
        going = F.explode(F.array(*[F.when(mixed[side], F.col(f"{side}_pairs")) for side in mixed])).alias("n")
        small, large = found.select(going).agg(
            F.coalesce(F.sum(F.when(F.col("n") <= NODE_PAIRS, F.col("n"))), F.lit(0)), F.count_if(F.col("n") > NODE_PAIRS)).first()
        if not small and not large:
            break
        sent = found.select(*NODE, "feature", "bin", mixed["left"].alias("left_mixed"), mixed["right"].alias("right_mixed"),
                            "left_pairs", "right_pairs", looked_at(left).alias("left_at"), looked_at(right).alias("right_at"))
        goes_left = F.get("bins", F.col("feature")) <= F.col("bin")
        state = materialize(
            state.drop("looked_at", "node_pairs").join(sent, NODE).where(
                F.when(goes_left, F.col("left_mixed")).otherwise(F.col("right_mixed"))).select(
                "forest", "tree", F.when(goes_left, left).otherwise(right).alias("node"), "bins", *SUMS,
                F.when(goes_left, F.col("left_pairs")).otherwise(F.col("right_pairs")).alias("node_pairs"),
                F.when(goes_left, F.col("left_at")).otherwise(F.col("right_at")).alias("looked_at")), "sampled")
    # A tree that samples nothing is a root without rows.
    roots = as_cuts(spark.range(trees).select(F.explode(F.lit(list(by_forest))).alias("forest"), F.col("id").cast("int").alias("tree"),
                                              F.lit(0).cast("long").alias("rows"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("positive")))
    return spark.read.schema(CUTS).parquet(*paths).unionByName(roots)


def _saved_forms(spark: SparkSession, forests: Sequence[int], assembler: Transformer, learner: RandomForestRegressor) -> str:
    """A folder with a saved forest of the learner for each of the forests, whose nodes are still to come."""
    path = scratch_path(spark, "grown")
    one = spark.range(1).select(*[F.lit(0.0).alias(f) for f in assembler.getInputCols()], F.lit(0).alias(LABEL), F.lit(1.0).alias("weight"))
    form = learner.fit(assembler.transform(one))
    in_parallel(spark, lambda forest: form.write().save(f"{path}/{forest}"), forests, len(forests))
    return path


def _models(found: DataFrame, path: str, by_forest: Mapping[int, list[list[float]]]) -> dict[int, RandomForestRegressionModel]:
    """The models of the cuts by forest: the forms saved in ``path``, with the nodes of these cuts in them."""
    spark, nodes = found.sparkSession, scratch_path(found.sparkSession, "nodes")
    made = found.groupBy("forest", "tree").applyInArrow(_numbered(by_forest), f"forest int, {NODES}")
    made.write.partitionBy("forest").parquet(nodes)

    def saved(forest: int) -> RandomForestRegressionModel:
        replace_path(spark, f"{nodes}/forest={forest}", f"{path}/{forest}/data")
        model = load_forest(f"{path}/{forest}")
        model.stored = f"{path}/{forest}"
        return model

    return dict(zip(by_forest, in_parallel(spark, saved, list(by_forest), len(by_forest))))


def _numbered(by_forest: Mapping[int, list[list[float]]]):
    kinds = {f.name: f.type for f in to_arrow_schema(StructType.fromDDL(NODES)).field("nodeData").type}
    split_kinds = {f.name: f.type for f in kinds["split"]}

    def numbered(key: tuple, cuts: pa.Table) -> pa.Table:
        """The nodes of a tree by its cuts: numbered level by level, the children of the n-th node that is cut are the nodes 2n + 1 and 2n + 2."""
        cuts = cuts.sort_by([("node", "ascending"), ("right_rows", "ascending")])
        # Of two roots, the last one has the rows of the tree.
        cuts = cuts.slice(np.searchsorted(cuts["node"].to_numpy(), 0, "right") - 1)
        node, feature, cut = (cuts[c].to_numpy()[1:] for c in ("node", "feature", "bin"))
        ids = np.concatenate([2 * cuts["node"].to_numpy() + side for side in (0, 1)])
        order = np.argsort(ids)[1:]
        rows, weight, positive = (np.concatenate([cuts[f"{side}_{s}"].to_numpy() for side in ("left", "right")])[order] for s in SUMS)
        at, count = np.searchsorted(ids[order], node), len(order)

        def of_cuts(values, otherwise) -> np.ndarray:
            out = np.full(count, otherwise)
            out[at] = values
            return out

        share = np.divide(positive, weight, out=np.zeros(count), where=weight > 0)
        thresholds = by_forest[key[0].as_py()]
        cut_at = np.array([thresholds[f][b] for f, b in zip(feature, cut)], float)
        number = np.arange(len(node))
        split = {"featureIndex": of_cuts(feature, -1),
                 "leftCategoriesOrThreshold": pa.ListArray.from_arrays(np.r_[0, np.cumsum(of_cuts(1, 0))].astype(np.int32), cut_at),
                 "numCategories": np.full(count, -1)}
        data = {"id": np.arange(count), "prediction": share, "impurity": share - share * share,
                "impurityStats": pa.ListArray.from_arrays(np.arange(0, 3 * count + 1, 3, dtype=np.int32),
                                                          np.column_stack([weight, positive, positive]).ravel()),
                "rawCount": rows, "gain": of_cuts(cuts["gain"].to_numpy()[1:], -1.0),
                "leftChild": of_cuts(2 * number + 1, -1), "rightChild": of_cuts(2 * number + 2, -1),
                "split": _struct(split, split_kinds)}
        return pa.table({"forest": pa.array(np.full(count, key[0].as_py(), np.int32)),
                         "treeID": pa.array(np.full(count, key[1].as_py(), np.int32)), "nodeData": _struct(data, kinds)})

    return numbered


def _struct(columns: dict, kinds: Mapping[str, pa.DataType]) -> pa.StructArray:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.StructArray.from_arrays([a.cast(kinds[c]) for c, a in zip(columns, arrays)], fields=[pa.field(c, kinds[c]) for c in columns])
