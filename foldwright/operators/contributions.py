"""Per-row feature contributions (Shapley values) of forests, over distinct vectors.

A tree's expected score for a known subset S of features is a sum over its leaves:
leaf value x product over the features on the leaf's path of either "does the row satisfy
the path" (feature in S) or the share of training weight that follows the path (feature
not in S). The Shapley value of feature i in such a product game with factors o (row) and
z (share) is

    value * (o_i - z_i) * integral over t in [0, 1] of prod_{j != i} (z_j (1 - t) + o_j t) dt

The integrand is a polynomial of degree d - 1, so Gauss-Legendre nodes give it exactly. A factor of it
depends only on which cuts of its feature the value lies between, so factors are made once for every such
interval, multiplied for the distinct combinations of each half of the features, and vectors multiply two of those products.

Leaves and vectors both stay in tables. A fold's trees are dealt into groups and its vectors
into blocks, both of bounded size; each pair of a group and a block meets in one task, which adds
up its trees, and the partial sums of a vector are added in the order of the groups. Nothing
of a tree or a vector passes through the driver.
"""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.operators.metrics import union_all
from foldwright.session import in_parallel, materialize, path_exists, scratch_path

# Ship the functions of this module with the tasks, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Vectors, and leaves times nodes, handled at once inside a task; they bound its work arrays, which should stay in the cache of a core.
BLOCK, CELLS = 64, 1024

# Vectors of a block and leaves of a group of trees: what one task holds of both tables.
BLOCK_VECTORS, GROUP_LEAVES = 1000, 25_000

# Leaves of one row of the leaf table; a tree of more has several rows.
PART_LEAVES = 20_000

# The arrays of a leaf table row, each leaves x width but the values.
ARRAYS = {"feature": np.int16, "low": np.float32, "high": np.float32, "share": np.float64, "value": np.float64}
LEAVES = "fold int, tree int, part int, leaves int, width int, " + ", ".join(f"{a} binary" for a in ARRAYS)


def leaf_table(spark: SparkSession, models: Mapping[int, PipelineModel]) -> DataFrame:
    """The stored leaves of the forests by fold: the box and the shares of every leaf as padded arrays.

    Saved trees are walked on the executors, tree by tree. A forest that its fit has written is not written again.
    """
    def saved(model: PipelineModel) -> str:
        stored = getattr(model.stages[-1], "stored", None)
        if stored and path_exists(spark, stored):
            return stored
        path = scratch_path(spark, "forest")
        model.stages[-1].save(path)
        return path

    walked = []
    paths = in_parallel(spark, saved, list(models.values()), len(models))
    schema = spark.read.parquet(f"{paths[0]}/data").schema
    for (fold, model), path in zip(models.items(), paths):
        forest = model.stages[-1]
        # Node statistics hold (weight, sum, sum of squares) or one weight per class.
        stats = F.col("nodeData.impurityStats")
        if isinstance(forest, RandomForestRegressionModel):
            weight, positive = stats[0], stats[1]
        else:
            weight, positive = F.aggregate(stats, F.lit(0.0), lambda a, b: a + b), F.get(stats, 1)
        walked.append(spark.read.schema(schema).parquet(f"{path}/data").select(
            F.lit(fold).cast("int").alias("fold"), "treeID", "nodeData.id", "nodeData.leftChild", "nodeData.rightChild",
            weight.alias("weight"), F.coalesce(positive / weight, F.lit(0.0)).alias("value"),
            F.col("nodeData.split.featureIndex").alias("feature"),
            F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("cut")))
    return materialize(union_all(walked).groupBy("fold", "treeID").applyInArrow(_walked, LEAVES), "leaves")


def _walked(key: tuple, nodes: pa.Table) -> pa.Table:
    nodes = nodes.sort_by("id")
    tree = _tree_leaves(*(nodes[c].to_numpy() for c in ("leftChild", "rightChild", "weight", "value", "feature", "cut")))
    count, width = tree["share"].shape
    rows = []
    for part, start in enumerate(range(0, count, PART_LEAVES)):
        cut = {a: v[start:start + PART_LEAVES] for a, v in tree.items()}
        rows.append((*(k.as_py() for k in key), part, len(cut["value"]), width,
                     *[cut[a].astype(kind).tobytes() for a, kind in ARRAYS.items()]))
    kinds = [pa.int32()] * 5 + [pa.binary()] * len(ARRAYS)
    return pa.table([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], ["fold", "tree", "part", "leaves", "width", *ARRAYS])


def unpacked(rows: pd.DataFrame) -> list[dict]:
    """The arrays of leaf table rows."""
    out = []
    for row in rows.itertuples():
        arrays = {a: np.frombuffer(getattr(row, a), kind) for a, kind in ARRAYS.items()}
        out.append({a: v if a == "value" else v.reshape(row.leaves, row.width) for a, v in arrays.items()})
    return out


def _tree_leaves(left: np.ndarray, right: np.ndarray, weight: np.ndarray, value: np.ndarray, feature: np.ndarray,
                 cut: np.ndarray) -> dict:
    """Walk one tree, level by level; node numbers run from 0 without gaps."""
    features = max(1, int(feature.max()) + 1)
    at, found = np.zeros(1, int), []
    low, high, share = (np.full((1, features), x) for x in (-np.inf, np.inf, 1.0))
    while len(at):
        leaf = left[at] < 0
        found.append((low[leaf], high[leaf], share[leaf], value[at[leaf]]))
        at, low, high, share = at[~leaf], low[~leaf], high[~leaf], share[~leaf]
        n, f = np.arange(len(at)), feature[at]
        children = np.concatenate([left[at], right[at]])
        sides = [a.repeat(2, axis=0).reshape(len(at), 2, features).swapaxes(0, 1).copy() for a in (low, high, share)]
        sides[1][0, n, f] = np.minimum(high[n, f], cut[at])
        sides[0][1, n, f] = np.maximum(low[n, f], cut[at])
        for side, child in enumerate((left[at], right[at])):
            sides[2][side, n, f] *= weight[child] / weight[at]
        at, (low, high, share) = children, (a.reshape(-1, features) for a in sides)
    low, high, share, value = (np.concatenate(a) for a in zip(*found))
    # Path features first. Padding acts as a feature that every row satisfies with share one: it changes nothing.
    on_path = np.isfinite(low) | np.isfinite(high)
    order = np.argsort(~on_path, axis=1, kind="stable")[:, :max(1, on_path.sum(axis=1).max())]
    low, high, share, on_path = (np.take_along_axis(a, order, 1) for a in (low, high, share, on_path))
    return {"feature": np.where(on_path, order, 0), "low": low, "high": high, "share": share, "value": value}


def _combined(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of some codes, and the place of every row among them."""
    rows, place = np.unique(codes, axis=0, return_inverse=True)
    return rows, place.ravel()


def shapley(trees: list[dict], x: np.ndarray) -> tuple[np.ndarray, float]:
    """Sums over the trees of their contributions (rows x features) and biases."""
    phi, bias, numbers = np.zeros(x.shape), 0.0, range(x.shape[1])
    bounds = [np.concatenate(c) for c in zip(*((np.tile(t["feature"].ravel(), 2), np.r_[t["low"].ravel(), t["high"].ravel()]) for t in trees))]
    cuts = [np.unique(bounds[1][(bounds[0] == f) & np.isfinite(bounds[1])]).astype(float) for f in numbers]
    # A value by the number of cuts below it, and one value of each number.
    codes = np.array([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)]).T
    values = [np.append(c, np.inf) for c in cuts]
    first = np.cumsum([0, *map(len, values)])
    halves = [h for h in (numbers[:(len(numbers) + 1) // 2], numbers[(len(numbers) + 1) // 2:]) if h]
    combined = [_combined(codes[:, h]) for h in halves]
    for t in trees:
        nodes, weights = np.polynomial.legendre.leggauss((t["share"].shape[1] + 1) // 2)
        nodes, weights, step = (nodes + 1) / 2, weights / 2, max(1, CELLS // len(nodes))
        bias += float((t["value"] * t["share"].prod(axis=1)).sum())
        for start in range(0, len(t["value"]), step):
            feature, low, high, share, value = (t[a][start:start + step] for a in ("feature", "low", "high", "share", "value"))
            factors, parts = [], []
            on_path = np.isfinite(low) | np.isfinite(high)
            for f in numbers:
                leaf, place = np.nonzero(on_path & (feature == f))
                own = share[leaf, place][:, None]
                inside = ((values[f][:, None] > low[leaf, place]) & (values[f][:, None] <= high[leaf, place]))[:, :, None].astype(float)
                factor, part = np.ones((len(values[f]), len(value), len(nodes))), np.zeros((len(values[f]), len(value), len(nodes)))
                factor[:, leaf] = own * (1 - nodes) + inside * nodes
                part[:, leaf] = (inside - own) * (weights * value[leaf][:, None]) / factor[:, leaf]
                factors.append(factor.reshape(len(factor), -1))
                parts.append(part.reshape(len(part), -1))
            products = []
            for h, (rows, _) in zip(halves, combined):
                product = factors[h[0]][rows[:, 0]]
                for f, code in zip(h[1:], rows.T[1:]):
                    product *= factors[f][code]
                products.append(product)
            by_value = np.concatenate(parts).T
            for some in (slice(i, i + BLOCK) for i in range(0, len(x), BLOCK)):
                product = products[0][combined[0][1][some]]
                if len(products) > 1:
                    product *= products[1][combined[1][1][some]]
                phi[some] += np.take_along_axis(product @ by_value, first[:-1] + codes[some], 1)
    return phi, bias


def contributions(vectors: DataFrame, leaves: DataFrame, features: Sequence[str],
                  block_vectors: int = BLOCK_VECTORS, group_leaves: int = GROUP_LEAVES) -> DataFrame:
    """(fold, features, n, phi, bias) for every distinct vector of a fold, by that fold's forest.

    Vectors are first collapsed to the given features. ``leaves`` is the ``leaf_table`` of the
    forests. Its trees travel once per block, the vectors once per group of trees; the numbers of blocks and
    groups follow from the size of the largest fold, and a group and a block are what one task holds.
    """
    names = list(features)
    distinct = vectors.groupBy("fold", *names).agg(F.sum("n").alias("n"))
    sizes = leaves.groupBy("fold").agg(F.sum("leaves").alias("leaves"), F.countDistinct("tree").alias("trees"))
    (largest,), most = in_parallel(vectors.sparkSession, lambda df: df.first(), [
        vectors.groupBy("fold").count().agg(F.max("count")), sizes.agg(F.max("leaves"), F.max("trees"))], 2)
    blocks = max(1, -(-(largest or 0) // block_vectors))
    groups = max(1, min(most[1] or 1, -(-(most[0] or 0) // group_leaves)))

    def explain(key: tuple, part: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(trees):
            return pd.DataFrame(columns=[*part.columns, "phi", "bias"]).drop(columns="block")
        phi, bias = shapley(unpacked(trees.sort_values(["tree", "part"])), part[names].to_numpy(float))
        return part.assign(phi=list(phi), bias=bias).drop(columns="block")

    block = F.pmod(F.xxhash64(*names), F.lit(blocks)).cast("int")
    met = distinct.withColumn("block", block).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = leaves.withColumn("group", F.col("tree") % groups).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in met.drop("block").schema)
    keys = ["fold", "group", "block"]
    parts = met.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(explain, f"{fields}, phi array<double>, bias double")
    added = parts.groupBy("fold", *names, "n").agg(F.sort_array(F.collect_list(F.struct("group", "phi", "bias"))).alias("parts"))
    zero = F.array(*[F.lit(0.0) for _ in names])
    phi = F.aggregate("parts", zero, lambda a, p: F.zip_with(a, p["phi"], lambda x, y: x + y))
    bias = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["bias"])
    return added.join(F.broadcast(sizes.select("fold", "trees")), "fold").select(
        "fold", *names, "n", F.transform(phi, lambda x: x / F.col("trees")).alias("phi"), (bias / F.col("trees")).alias("bias"))


def mean_abs_contribution(explained: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, mean_abs_shap): row-weighted mean per fold, then the plain mean of the folds."""
    per_fold = explained.groupBy("fold").agg(*[
        (F.sum(F.abs(F.col("phi")[i]) * F.col("n")) / F.sum("n")).alias(f) for i, f in enumerate(features)])
    return per_fold.unpivot(["fold"], list(features), "feature", "part").groupBy("feature").agg(
        F.avg("part").alias("mean_abs_shap"))
