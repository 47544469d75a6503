"""Nearest vectors by learned partitions: a balanced cut of a neighbour graph and a classifier that routes to its parts.

The driver takes a bounded sample of vectors, links each to its nearest ones by inner product, and cuts this graph into
equal parts with few links between them. A small network learns from a vector which parts its neighbours are in. Every
vector of the table is stored in its most probable part and every query is sent to so many of its most probable parts
as reach ``RECALL`` on the sample, found there by brute force, and to more if these hold too few vectors. In a part the query meets all vectors, in blocks, and
the best are ranked by inner products in double precision over the original vectors, summed in the order of components.

The fit sees at most ``SAMPLE_ROWS`` vectors; the index holds all. A part with more vectors or queries than a block is
split into more blocks, so equal vectors in any number make more tasks and not a longer one.

Defined results: vectors that are null, zero, of another length than most, or that hold null or non-finite components
take no part, neither do rows without vec_id; a query is one for each distinct vec_id and meets every row of another
vec_id; ties go to the smaller vec_id; with fewer candidates than wanted all are returned; an empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwright.llm.common import bounded_batches, bounded_sample, materialize

SAMPLE_ROWS = 4096
PARTS, PER_PART, LINKS, HIDDEN = 16, 64, 10, 64
#: Share of the true neighbours that the routed parts must hold on the sample.
RECALL = 0.94
CANDIDATE_BLOCK, QUERY_BLOCK, AT_ONCE = 16384, 4096, 128


def neighbours(rows: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest inner products of every row with other rows."""
    out = np.empty((len(rows), k), np.int64)
    for at in range(0, len(rows), 512):
        products = rows[at:at + 512] @ rows.T
        products[np.arange(len(products)), np.arange(at, at + len(products))] = -np.inf
        out[at:at + 512] = np.argsort(-products, axis=1, kind="stable")[:, :k]
    return out


def balanced_cut(links: np.ndarray, parts: int) -> np.ndarray:
    """A part for every vertex: halves at the median of a slow mode of the graph, then moves that save links."""
    n = len(links)
    graph = np.zeros((n, n), np.float32)
    graph[np.repeat(np.arange(n), links.shape[1]), links.ravel()] = 1
    graph = np.maximum(graph, graph.T)
    part = np.zeros(n, np.int64)
    draws = np.random.default_rng(11)
    while part.max() + 1 < parts:
        for p in range(part.max() + 1):
            own = np.flatnonzero(part == p)
            inner = graph[np.ix_(own, own)]
            scale = 1 / np.sqrt(np.maximum(inner.sum(axis=1), 1))
            even = 1 / scale / np.linalg.norm(1 / scale)
            mode = draws.standard_normal(len(own)).astype(np.float32)
            for _ in range(30):
                mode -= even * (even @ mode)
                mode = mode + scale * (inner @ (scale * mode))
                mode /= max(np.linalg.norm(mode), 1e-20)
            order = np.argsort(mode * scale, kind="stable")
            part[own[order[len(own) // 2:]]] += 1 << 20
        part = np.unique(part, return_inverse=True)[1]
    most = int(1.05 * n / parts) + 1
    sizes = np.bincount(part, minlength=parts)
    for _ in range(5):
        near = graph @ np.eye(parts, dtype=np.float32)[part]
        gain = near.max(axis=1) - near[np.arange(n), part]
        for v in np.argsort(-gain, kind="stable"):
            to = int(near[v].argmax())
            if gain[v] <= 0:
                break
            if sizes[to] < most:
                sizes[part[v]] -= 1
                sizes[to] += 1
                part[v] = to
    return part


@dataclass(frozen=True)
class Router:
    """A network with one hidden layer, and the number of parts a query goes to."""

    first: np.ndarray
    second: np.ndarray
    parts: int
    probes: int

    def logits(self, rows: np.ndarray) -> np.ndarray:
        return _biased(np.maximum(_biased(rows) @ self.first, 0)) @ self.second

    def part_of(self, rows: np.ndarray) -> np.ndarray:
        return self.logits(rows).argmax(axis=1)

    def route(self, rows: np.ndarray) -> np.ndarray:
        return np.argsort(-self.logits(rows), axis=1, kind="stable")[:, :self.probes]

    def route_to(self, rows: np.ndarray, sizes: np.ndarray, least: int) -> list[list[int]]:
        """The parts of every row: its most probable ones, so many that they hold at least ``least`` vectors."""
        order = np.argsort(-self.logits(rows), axis=1, kind="stable")
        needed = (np.cumsum(sizes[order], axis=1) < least).sum(axis=1) + 1
        return [own[:max(self.probes, n)].tolist() for own, n in zip(order, needed)]


def _biased(rows: np.ndarray) -> np.ndarray:
    return np.hstack([rows, np.ones((len(rows), 1))])


def _train(rows: np.ndarray, wanted: np.ndarray, steps: int = 600, rate: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    draws = np.random.default_rng(13)
    scale = max(float(np.sqrt((rows ** 2).sum(axis=1)).mean()), 1e-12)
    weights = [draws.standard_normal((rows.shape[1] + 1, HIDDEN)) / scale,
               draws.standard_normal((HIDDEN + 1, wanted.shape[1])) / np.sqrt(HIDDEN)]
    first_moment, second_moment = [0 * w for w in weights], [0 * w for w in weights]
    for step in range(1, steps + 1):
        batch = draws.integers(0, len(rows), 256)
        inputs = _biased(rows[batch])
        hidden = np.maximum(inputs @ weights[0], 0)
        logits = _biased(hidden) @ weights[1]
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        error = (odds / odds.sum(axis=1, keepdims=True) - wanted[batch]) / len(batch)
        slopes = [inputs.T @ ((error @ weights[1][:-1].T) * (hidden > 0)), _biased(hidden).T @ error]
        for k, slope in enumerate(slopes):
            first_moment[k] = 0.9 * first_moment[k] + 0.1 * slope
            second_moment[k] = 0.999 * second_moment[k] + 0.001 * slope ** 2
            weights[k] = weights[k] - rate * (first_moment[k] / (1 - 0.9 ** step)) / (
                np.sqrt(second_moment[k] / (1 - 0.999 ** step)) + 1e-8)
    return weights[0], weights[1]


def fit_router(sample: np.ndarray, recall: float = RECALL, nearest: int = 20) -> Router:
    """Cut the neighbour graph of ``sample``, train the network, and measure how many parts a query needs."""
    n, width = sample.shape
    parts = 1
    while parts < PARTS and n >= 2 * parts * PER_PART:
        parts *= 2
    if parts == 1:
        return Router(np.zeros((width + 1, 1)), np.zeros((2, 1)), 1, 1)
    close = neighbours(sample, max(LINKS, nearest))
    part = balanced_cut(close[:, :LINKS], parts)
    wanted = np.eye(parts)[part][close[:, :LINKS]].mean(axis=1)
    router = Router(*_train(sample, wanted), parts, parts)
    # Recall is measured on vectors that a second network, trained without them, has not seen.
    seen = np.arange(n) % 4 != 0
    blind = Router(*_train(sample[seen], wanted[seen]), parts, parts)
    held = np.where(seen, router.part_of(sample), blind.part_of(sample))
    place = np.argsort(blind.route(sample[~seen]), axis=1)
    needed = np.take_along_axis(place, held[close[~seen][:, :nearest]], axis=1)
    for probes in range(1, parts):
        if (needed < probes).mean() >= recall:
            return Router(router.first, router.second, parts, probes)
    return router


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (as doubles) of the rows that take part."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(
        "vec_id is not null and embedding is not null and size(embedding) > 0"
        " and forall(embedding, x -> x is not null and abs(x) < double('Infinity')) and exists(embedding, x -> x != 0)")
    width = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    return rows.where(F.size("embedding") == (width[0]["width"] if width else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[
        column.offsets[0].as_py():column.offsets[-1].as_py()].reshape(len(column), -1)


def _best(queries: pd.DataFrame, candidates: pd.DataFrame, nearest: int) -> pd.DataFrame:
    """The best candidates of one block for each query: a blocked product picks them, exact sums rank them."""
    out = []
    if len(queries) and len(candidates):
        ids, rows = candidates["vec_id"].to_numpy(), np.vstack(candidates["embedding"].to_numpy())
        norms = np.linalg.norm(rows, axis=1).max()
        for at in range(0, len(queries), AT_ONCE):
            own = queries["vec_id"].to_numpy()[at:at + AT_ONCE]
            block = np.vstack(queries["embedding"].to_numpy()[at:at + AT_ONCE])
            products = block @ rows.T
            products[own[:, None] == ids[None, :]] = -np.inf
            k = min(nearest, len(ids))
            least = np.partition(products, len(ids) - k, axis=1)[:, len(ids) - k]
            for q, query, row, low in zip(own, block, products, least):
                slack = 1e-12 * norms * np.linalg.norm(query)
                picked = np.flatnonzero(row >= max(low - slack, -1.7e308))
                if len(picked) > 4 * nearest:  # many equal ones: those of the smallest ids are enough
                    sure = picked[row[picked] > low + slack]
                    tied = picked[row[picked] <= low + slack]
                    exact = _sums(query, rows[tied])
                    tied = tied[np.lexsort((ids[tied], -exact))[:nearest]]
                    picked = np.concatenate([sure, tied])
                exact = _sums(query, rows[picked])
                order = np.lexsort((ids[picked], -exact))[:nearest]
                out.append(pd.DataFrame({"query_id": q, "vec_id": ids[picked][order], "score": exact[order]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"),
                                                     "score": pd.Series(dtype="float64")})


def _sums(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products, summed in the order of components, the same for equal vectors wherever they stand."""
    total = np.zeros(len(rows))
    for k, x in enumerate(query):
        total += x * rows[:, k]
    return total


def search(vectors: DataFrame, query_step: int = 20, nearest: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for every vec_id divisible by ``query_step``, its nearest vectors found."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = materialize(usable(vectors), "vectors")
    sample = bounded_sample(rows, SAMPLE_ROWS, "vec_id").toPandas()
    router = fit_router(np.vstack(sample["embedding"].to_numpy())) if len(sample) else Router(
        np.zeros((1, 1)), np.zeros((2, 1)), 1, 1)
    shared = spark.sparkContext.broadcast(router)

    def parts(batches: Iterator[pa.RecordBatch], queries: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                matrix = _matrix(batch.column(1))
                routed = (shared.value.route_to(matrix, held, least) if queries
                          else shared.value.part_of(matrix)[:, None].tolist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(routed, pa.list_(pa.int32()))],
                    names=["vec_id", "embedding", "parts"])

    schema = "vec_id long, embedding array<double>, parts array<int>"
    held, least = np.zeros(router.parts), 0
    index = materialize(rows.mapInArrow(lambda b: parts(b, False), schema)
                        .select("vec_id", "embedding", F.col("parts")[0].alias("part")), "index")
    sizes = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}
    held = np.array([sizes.get(p, 0) for p in range(router.parts)])
    # A query does not meet the rows of its own vec_id.
    least = nearest + (index.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 0)
    asked = materialize(rows.where(F.col("vec_id") % query_step == 0).dropDuplicates(["vec_id"])
                        .mapInArrow(lambda b: parts(b, True), schema)
                        .select("vec_id", "embedding", F.explode("parts").alias("part")), "queries")
    loads = {r["part"]: r["count"] for r in asked.groupBy("part").count().collect()}
    blocks = {p: max(1, -(-sizes.get(p, 0) // CANDIDATE_BLOCK)) for p in range(router.parts)}
    turns = {p: max(1, -(-loads.get(p, 0) // QUERY_BLOCK)) for p in range(router.parts)}

    def of(counts: dict[int, int]) -> F.Column:
        return F.element_at(F.array(*(F.lit(counts[p]) for p in range(router.parts))), F.col("part") + 1)

    def dealt(side: DataFrame, own: str, own_counts: dict, other: str, other_counts: dict) -> DataFrame:
        return (side.withColumn(own, F.pmod(F.xxhash64("vec_id", "part", "embedding", F.monotonically_increasing_id()),
                                            of(own_counts)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), of(other_counts) - 1))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _best(left, right, nearest)

    keys = ["part", "block", "turn"]
    found = (dealt(asked, "turn", turns, "block", blocks).groupBy(*keys)
             .cogroup(dealt(index, "block", blocks, "turn", turns).groupBy(*keys))
             .applyInPandas(meet, "query_id long, vec_id long, score double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
