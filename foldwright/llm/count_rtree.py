"""Jaccard join of word shingles by count vectors in a tree of boxes.

A document's set are the hashes of its distinct shingles. Two documents link when
``100 * intersection >= percent * union``; the result names the component of links that a document is in.

Tokens are hashed into coordinates and the counts of the coordinates are a document's point. The root of the tree splits
the points into cells so that every link lies in a cell. For each doubling of the set size tokens are dealt into ``k`` groups.
Linked sets differ in at most ``d`` tokens, so they agree on all tokens of at least ``k - d`` groups, and of the groups on which they
agree the strongest is among the first ``d + 1`` of either, in any order of groups by their tokens. A cell holds the
documents that have its group there. The order puts groups with rare tokens first, by counts of all documents' tokens in a table of fixed
size (``BUCKETS``), which decides how large cells get and nothing else. Few sets that do not link agree on a group of several tokens. A set with
too few groups that hold tokens also stands in the cells of its first single tokens, rare ones first.

Cells can be large, so links are found without all pairs of a cell. Equal sets are one point. The document of a cell that has the
largest cells is its centre and meets the others: the points are packed into boxes, and for two boxes, and then for two points,
the sum over the coordinates of the smaller one bounds the intersection from above; the pairs that survive are verified
on their sets. Links found so far join documents to parts; documents of one part are connected and never need to meet. For documents
around one centre that are in another part than it, what they differ from the centre in is compared: sets x and y that differ from
the centre in ``d(x)`` and ``d(y)`` tokens differ from each other in ``d(x) + d(y)`` less twice the tokens that both
differences hold. As x does not link with the centre, a link of x and y means that about half of y's difference is in that of x, so
the first tokens of the differences, those that the centre lacks in front, must meet. These pairs go through points and sets again, and all
links found make the components.

Sets are compared by 64-bit hashes of shingles and 64-bit digests of sets. Defined results: a document without words or
with a null text has an empty set and links with nothing; with fewer words than a shingle its whole sequence is one;
rows without doc_id have no component; the sets of which a repeated doc_id is the smallest are in one component; an empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwright.llm.common import bounded_batches, materialize, small_enough

WORDS, PERCENT = 3, 90
#: Coordinates of a point.
COORDINATES = 64
#: Counters of tokens, a power of two, and the chunks that they are added up in: 1 MB of ranks goes to the tasks, whatever the table.
BUCKETS, CHUNKS = 1 << 20, 64
#: Documents outside the part of their centre, for each other one around it, that meet all others without a look at their differences.
PAIRS_PER_MEMBER = 4
#: Groups that tokens are dealt into, for each group that linked sets of the largest size can differ in.
GROUPS = 1.5
#: Width of a box in logarithms of the set size, and in standard deviations of half the coordinates.
BOX_SIZE, BOX_SPREAD = 0.03, 0.5
#: Bytes hashed at once, up to the end of a word: bounds the work arrays of a long text.
PIECE = 1 << 20
#: A word hashes to the sum of a random number for each byte times a power for its place; a shingle likewise of its words.
_draw = random.Random(20).getrandbits
CODES = np.array([_draw(64) | 1 for _ in range(256)], np.uint64)
BASE, STEP = np.uint64(_draw(64) | 1), np.uint64(_draw(64) | 1)
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _powers(count: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(count - 1, BASE)]), dtype=np.uint64)


#: The powers for words of usual length.
POWERS = _powers(64)


def _piece_hashes(piece: np.ndarray) -> np.ndarray:
    """A hash for each word of a piece that cuts no word."""
    gap = np.concatenate([[True], SPACES[piece], [True]])
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    lengths = edges[1::2] - edges[::2]
    if not len(lengths):
        return np.zeros(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(first, lengths)
    powers = POWERS if lengths.max() <= len(POWERS) else _powers(lengths.max())
    terms = CODES[piece[~gap[1:-1]]] * powers[place]
    return _mixed(np.add.reduceat(terms, first))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each word of a text, A-Z in lower case."""
    raw = np.frombuffer((text or "").encode().lower(), np.uint8)
    out, start = [np.zeros(0, np.uint64)], 0
    while start < len(raw):
        end = start + PIECE
        while end < len(raw) and not SPACES[raw[end]]:
            ahead = np.flatnonzero(SPACES[raw[end:end + PIECE]])
            end += int(ahead[0]) if len(ahead) else PIECE
        out.append(_piece_hashes(raw[start:end]))
        start = end
    return np.concatenate(out)


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a text."""
    hashes = word_hashes(text)
    if not len(hashes):
        return hashes
    width = min(words, len(hashes))
    count = len(hashes) - width + 1
    out = np.full(count, width, np.uint64)
    for k in range(width):
        out = out * STEP + hashes[k:count + k]
    out = _mixed(out)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def spare(size_a: int, size_b: int, percent: int) -> int:
    """The most tokens that are in only one of two linked sets of these sizes."""
    return (size_a + size_b) * (100 - percent) // (100 + percent)


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - (BUCKETS - 1).bit_length())).astype(np.int64)


def commonness(docs: DataFrame, words: int) -> np.ndarray:
    """A rank from 0 to 255 for each bucket of tokens, in steps of an eighth of a doubling of the documents' tokens in it."""
    width = BUCKETS // CHUNKS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(total, _bucket(shingles(text.as_py(), words)), 1)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(CHUNKS), pa.int32()),
                                          "counts": [part.tobytes() for part in total.reshape(CHUNKS, width)]})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts.as_buffer(), np.int64)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(sums), pa.int32()),
                                          "ranks": pa.array([np.floor(np.log2(1 + c) * 8).clip(0, 255).astype(np.uint8).tobytes()
                                                             for c in sums.values()], pa.binary())})

    found = (docs.select("text").mapInArrow(counted, "chunk int, counts binary").repartition("chunk")
             .mapInArrow(added, "chunk int, ranks binary"))
    ranks = np.zeros((CHUNKS, width), np.uint8)
    for row in found.collect():
        ranks[row["chunk"]] = np.frombuffer(row["ranks"], np.uint8)
    return ranks.reshape(-1)


def _groups(tokens: np.ndarray, ranks: np.ndarray, count: int, octave: int) -> np.ndarray:
    """A key for each of ``count`` groups that holds tokens: equal for equal tokens of the same group, less for a stronger one."""
    of = _mixed(tokens ^ STEP) % np.uint64(count)
    order = np.argsort(of, kind="stable")
    of = of[order]
    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    content = np.add.reduceat(_mixed(tokens[order] ^ BASE), starts)
    rarest = np.minimum.reduceat(ranks[order], starts).astype(np.uint64)
    sizes = np.diff(np.append(starts, len(tokens))).clip(0, 255).astype(np.uint64)
    return (rarest << np.uint64(56)) | ((np.uint64(255) - sizes) << np.uint64(48)) | (
        _mixed(content + (of[starts] | np.uint64(octave << 56)) * STEP) >> np.uint64(16))


def _first(keys: np.ndarray, count: int) -> np.ndarray:
    return keys[keys <= np.partition(keys, count - 1)[count - 1]]


def cells(tokens: np.ndarray, percent: int, ranks: np.ndarray) -> np.ndarray:
    """The cells of a set: as many of its strongest groups as must hold one that a linked set has too.

    Sets meet among the groups of the larger one's octave. A set with fewer groups than that adds its first tokens, rare ones first.
    """
    n = len(tokens)
    largest = n * 100 // percent
    if not n or not spare(n, largest, percent):
        return np.zeros(0, np.int64)
    rank, found, short = ranks[_bucket(tokens)], [], False
    for octave in range(n.bit_length(), largest.bit_length() + 1):
        top = (1 << octave) - 1
        keep = spare(n, min(top, largest), percent) + 1
        keys = _groups(tokens, rank, math.ceil(GROUPS * (spare(top, top, percent) + 1)), octave)
        short |= len(keys) < keep
        found.append(_first(keys, min(keep, len(keys))))
    if short:
        keys = (rank.astype(np.uint64) << np.uint64(56)) | (_mixed(tokens) >> np.uint64(8))
        found.append(_first(keys, n - (percent * n + 99) // 100 + 1))
    return np.unique(np.concatenate(found)).view(np.int64)


def _tokenised(docs: DataFrame, words: int, schema: str, made: Callable[[list, list[np.ndarray]], dict]) -> DataFrame:
    """``made`` of the ids and sets of each batch of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_pydict(made(batch.column(0), sets))

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _digests(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little", signed=True) for s in sets], pa.int64())


def points(docs: DataFrame, words: int, percent: int, ranks: np.ndarray) -> DataFrame:
    """doc_id, n, node (the digest of the set), counts, cells of every row."""

    def made(ids: pa.Array, sets: list[np.ndarray]) -> dict:
        counts = [np.bincount((s & np.uint64(COORDINATES - 1)).astype(np.int64), minlength=COORDINATES) for s in sets]
        keys = [cells(s, percent, ranks) for s in sets]
        ends = np.cumsum([0, *map(len, keys)])
        return {"doc_id": ids, "n": pa.array([len(s) for s in sets], pa.int64()), "node": _digests(sets),
                "counts": pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * COORDINATES,
                                                   np.concatenate([np.zeros(0, np.int64), *counts]).astype(np.int32)),
                "cells": pa.ListArray.from_arrays(ends.astype(np.int32), np.concatenate([np.zeros(0, np.int64), *keys]))}

    return _tokenised(docs, words, "doc_id long, n long, node long, counts array<int>, cells array<long>", made)


def token_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, node and tokens (64-bit hashes, sorted) of every row."""

    def made(ids: pa.Array, sets: list[np.ndarray]) -> dict:
        return {"doc_id": ids, "node": _digests(sets), "tokens": pa.array([s.tobytes() for s in sets], pa.binary())}

    return _tokenised(docs, words, "doc_id long, node long, tokens binary", made)


def _may_link(a: str, b: str, percent: int) -> Column:
    """Whether the summed minima of two points (or of the corners of two boxes, with their least sizes) allow a link."""
    least = F.aggregate(F.zip_with(F.col(f"{a}.counts"), F.col(f"{b}.counts"), lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda s, x: s + x)
    return least * (100 + percent) >= percent * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _with_sets(pairs: DataFrame, owners: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """``pairs`` (a, b: nodes; more columns) with their sets x and y. ``owners``: node and the doc_id that it is read from.

    Sets that are no ``a`` are not shuffled by themselves, so ``a`` should be the side with fewer different nodes.
    """
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(owners, "node"), "pair-ids")
    texts = docs.select("doc_id", "text").join(small_enough(ids.select("doc_id")), "doc_id", "left_semi")
    sets = materialize(token_sets(texts, words).join(small_enough(ids), ["doc_id", "node"], "left_semi").select("node", "tokens"), "token-sets")
    left = small_enough(pairs).join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
    firsts = materialize(pairs.select("a").distinct(), "first-ids")
    right = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")).join(small_enough(firsts), "a", "left_semi")
    return left.join(right, "a").select(*pairs.columns, "x", "y")


def verified(pairs: DataFrame, owners: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The rows of ``pairs`` (a, b: nodes) whose sets link. Only the texts of their ``owners`` are read into sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return _with_sets(pairs.select("a", "b"), owners, docs, words).mapInArrow(run, "a long, b long").distinct()


def difference(centre: np.ndarray, tokens: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The tokens in one of two sets only: those that the centre lacks, rare ones first, then those that only it has, common ones first."""
    sides = []
    for side, sign in ((np.setdiff1d(tokens, centre, assume_unique=True), 1), (np.setdiff1d(centre, tokens, assume_unique=True), -1)):
        sides.append(side[np.lexsort((_mixed(side), sign * ranks[_bucket(side)].astype(np.int64)))])
    return np.concatenate(sides)


def differences(pairs: DataFrame, owners: DataFrame, docs: DataFrame, words: int, percent: int, ranks: np.ndarray) -> DataFrame:
    """``pairs`` (a, b: nodes; part, out) with n and d, the sizes of b's set and of its difference from a's, and the first tokens of that.

    These are as many as ``among_differences`` may look at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x, y in zip(batch.column(4), batch.column(5)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                found = difference(x, y, ranks)
                looked_at = max(spare(len(y), len(y) * 100 // percent, percent), len(found) * 100 // (100 + percent)) + 1
                rows.append((len(y), len(found), found[:looked_at].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["a", "b", "part", "out", "n", "d", "tokens"])

    return _with_sets(pairs.select("a", "b", "part", "out"), owners, docs, words).mapInArrow(
        run, "a long, b long, part long, out boolean, n long, d long, tokens array<long>")


def among_differences(found: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b: nodes) of different parts around one centre, one of them outside the centre's part, whose first differences meet.

    ``found``: rows of ``differences``. The sets of two rows differ in ``d + d' - 2 * common`` tokens, common being what both differences
    hold; they link if that is at most ``(n + n') * (100 - percent) / (100 + percent)``. So ``need`` of their differences are
    common, and one of them is among the first ``d - need + 1`` of either. A row that is not out has least need
    with the row of its size that is least far out.
    """
    less, more = 100 - percent, 100 + percent
    size = F.floor(F.log("n") / (math.log(100 / percent) * 1.001)).cast("int") if percent < 100 else F.col("n").cast("int")
    rows = found.withColumn("size", size)
    far = (rows.where("out").select("a", F.explode(F.array(*[F.col("size") + k for k in (-1, 0, 1)])).alias("size"),
                                    (F.col("d") * more - F.col("n") * less).alias("far")).groupBy("a", "size").agg(F.min("far").alias("far")))
    need = F.ceil((F.col("d") * more + F.col("far") - F.col("n") * less) / (2 * more))
    about = F.struct("b", "part", "n", "d", "place")
    one = rows.where("out").withColumn("first", F.floor((F.col("n") + F.floor(F.col("n") * 100 / percent)) * less / more) + 1)
    other = rows.join(materialize(far, "least-far"), ["a", "size"]).withColumn("first", F.col("d") - need + 1)
    sides = [side.where("first > 0").select("a", "b", "part", "n", "d", F.posexplode(
        F.slice("tokens", 1, F.col("first").cast("int"))).alias("place", "token")).select("a", "token", about.alias(name))
        for side, name in ((one, "x"), (other, "y"))]
    left = sum(F.col(f"{s}.d") for s in ("x", "y")) - F.floor((F.col("x.n") + F.col("y.n")) * less / more)
    met = sides[0].join(sides[1], ["a", "token"]).where(
        (F.col("x.part") != F.col("y.part")) & (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent)
        & (2 * (F.col("x.d") - F.col("x.place")) >= left) & (2 * (F.col("y.d") - F.col("y.place")) >= left))
    return met.select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b"))


def _between(links: DataFrame, labels: DataFrame) -> DataFrame:
    """``links`` (a, b: nodes) as pairs of different parts (a, b) in both directions."""
    found = (links.join(labels.select(F.col("node").alias("a"), F.col("part").alias("x")), "a")
             .join(labels.select(F.col("node").alias("b"), F.col("part").alias("y")), "b").where("x != y")
             .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return found.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
                        .alias("p")).select("p.a", "p.b")


def _lowered(both: DataFrame, root: DataFrame) -> DataFrame:
    """``root`` (a, root) with the least root of a part and its neighbours."""
    near = both.join(root.select(F.col("a").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
    return root.join(near, "a").select("a", F.least("root", "near").alias("lower"), "root")


def _renamed(labels: DataFrame, root: DataFrame) -> DataFrame:
    return materialize(labels.join(small_enough(root.withColumnRenamed("a", "part")), "part", "left")
                       .select("node", F.coalesce("root", "part").alias("part")), "parts")


def _first_roots(both: DataFrame) -> DataFrame:
    return both.groupBy("a").agg(F.min("b").alias("root")).select("a", F.least("a", "root").alias("root"))


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, part) with the parts that ``links`` (a, b: nodes) connect made one, under the least of them."""
    both = materialize(_between(links, labels), "links")
    if both.isEmpty():
        return labels
    root = materialize(_first_roots(both), "roots")
    while True:
        lower = _lowered(both, root)
        jump = lower.select(F.col("a").alias("lower"), F.col("lower").alias("jumped"))
        after = materialize(lower.join(jump, "lower", "left").select(
            "a", F.least("lower", F.coalesce("jumped", "lower")).alias("next"), "root"), "roots")
        done = after.where(F.col("next") != F.col("root")).isEmpty()
        root = after.select("a", F.col("next").alias("root"))
        if done:
            return _renamed(labels, root)


def _boxed(known: DataFrame) -> DataFrame:
    """``known`` (node, n, counts) with the number of its box: near sizes and a near share of half the coordinates."""
    half = F.aggregate(F.slice("counts", 1, COORDINATES // 2), F.lit(0), lambda s, x: s + x)
    return known.withColumn("box", F.hash(F.floor(F.log("n") / BOX_SIZE), F.floor((half - F.col("n") / 2) / F.sqrt("n") / BOX_SPREAD)))


def _boxes(known: DataFrame) -> DataFrame:
    """Upper corner and least size of each box."""
    corner = [F.max(F.get("counts", F.lit(k))).alias(f"c{k}") for k in range(COORDINATES)]
    return known.groupBy("box").agg(F.min("n").alias("n"), *corner).select(
        "box", "n", F.array(*(f"c{k}" for k in range(COORDINATES))).alias("counts"))


def _possible(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b: nodes; p, q: their boxes) whose boxes and then points allow a link."""
    corners = materialize(_boxes(known), "boxes")
    allowed = (pairs.select("p", "q").distinct()
               .join(corners.select(F.col("box").alias("p"), F.struct("n", "counts").alias("a")), "p")
               .join(corners.select(F.col("box").alias("q"), F.struct("n", "counts").alias("b")), "q")
               .where(_may_link("a", "b", percent)).select("p", "q"))
    near = pairs.join(small_enough(materialize(allowed, "box-pairs")), ["p", "q"], "left_semi").select("a", "b")
    a = known.select(F.col("node").alias("a"), F.struct("n", "counts").alias("p"))
    b = known.select(F.col("node").alias("b"), F.struct("n", "counts").alias("q"))
    return near.join(a, "a").join(b, "b").where(_may_link("p", "q", percent)).select("a", "b")


def _centred(members: DataFrame, known: DataFrame) -> DataFrame:
    """(a, p, b, q): the centre of a cell of ``members`` (cell, node, size) and another document of it, each with its box; once for all their cells."""
    weights = members.groupBy("node").agg(F.sum("size").alias("weight")).join(known.select("node", "box"), "node")
    rows = materialize(members.drop("size").join(small_enough(materialize(weights, "weights")), "node"), "weighted")
    centres = rows.groupBy("cell").agg(F.max(F.struct("weight", "node", "box")).alias("centre"))
    return rows.join(centres, "cell").where(F.col("node") != F.col("centre.node")).select(
        F.col("centre.node").alias("a"), F.col("centre.box").alias("p"), F.col("node").alias("b"), F.col("box").alias("q")).distinct()


def parts(docs: DataFrame, nodes: DataFrame, words: int, percent: int, ranks: np.ndarray) -> DataFrame:
    """node and part of the nodes that share a cell with another one; the parts are the components of links.

    ``nodes``: node, doc_id (of a row with that set), n, counts, cells.
    """
    size = F.count(F.lit(1)).over(Window.partitionBy("cell"))
    members = materialize(nodes.select("node", F.explode("cells").alias("cell")).withColumn("size", size).where("size > 1").distinct(), "members")
    inside = materialize(members.select("node").distinct(), "cell-nodes")
    known = materialize(_boxed(nodes.select("node", "doc_id", "n", "counts").join(small_enough(inside), "node").distinct()), "cell-points")
    owners, around = known.select("node", "doc_id"), materialize(_centred(members, known), "around")
    linked = materialize(verified(materialize(_possible(around, known, percent), "possible"), owners, docs, words, percent), "linked")
    labels = materialize(merged(inside.select("node", F.col("node").alias("part")), linked), "labels")
    # Documents around one centre that its links have not joined may still link with each other.
    sided = (around.join(labels.select(F.col("node").alias("a"), F.col("part").alias("own")), "a")
             .join(labels.select(F.col("node").alias("b"), "part"), "b").select("a", "b", "part", (F.col("part") != F.col("own")).alias("out")))
    sided = materialize(sided, "sided")
    apart = materialize(sided.groupBy("a").agg(F.count_if("out").alias("outs"), F.count("*").alias("rows")).where("outs > 0 and rows > 1"), "apart")
    left = materialize(sided.join(small_enough(apart.select("a", "outs")), "a"), "left")
    if left.isEmpty():
        return labels
    few, many = left.where(F.col("outs") <= PAIRS_PER_MEMBER), left.where(F.col("outs") > PAIRS_PER_MEMBER).drop("outs")
    about = F.struct("b", "part")
    pairs = few.where("out").select("a", about.alias("x")).join(few.select("a", about.alias("y")), "a").where("x.part != y.part").select(
        F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b"))
    if not many.isEmpty():
        found = materialize(differences(many, owners, docs, words, percent, ranks), "differences")
        pairs = pairs.unionAll(among_differences(found, percent))
    boxes = [known.select(F.col("node").alias(n), F.col("box").alias(b)) for n, b in (("a", "p"), ("b", "q"))]
    pairs = materialize(pairs.distinct().join(boxes[0], "a").join(boxes[1], "b"), "met")
    linked = materialize(verified(materialize(_possible(pairs, known, percent), "possible"), owners, docs, words, percent), "linked")
    return merged(labels, linked)


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    bounded_batches(docs.sparkSession)
    ranks = commonness(docs, words)
    every = materialize(points(docs, words, percent, ranks), "points")
    firsts = materialize(every.where("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "firsts")
    nodes = every.join(small_enough(firsts), ["node", "doc_id"], "left_semi")
    labels = parts(docs.where("doc_id is not null"), nodes, words, percent, ranks)
    named = materialize(firsts.join(labels, "node", "left").select("node", "doc_id", F.coalesce("part", "node").alias("part")), "named")
    repeated = materialize(named.groupBy("doc_id").agg(F.min("node").alias("a"), F.count("*").alias("sets")).where("sets > 1"), "repeated")
    if not repeated.isEmpty():
        same = named.join(repeated, "doc_id").where("node != a").select("a", F.col("node").alias("b"))
        named = merged(named.select("node", "part"), same).join(firsts, "node")
    least = named.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    component = materialize(named.join(least, "part").select("node", "component_id"), "components")
    own = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("node"))
    return every.select("doc_id", F.col("n").alias("n_shingles"), own.alias("node")).join(small_enough(component), "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their component, all columns; rows without doc_id stay.

    Of rows that repeat both doc_id and text, one stays.
    """
    found = materialize(components(docs, words, percent).where("doc_id is not null"), "near-copies")
    gone = F.max(F.col("component_id") != F.col("doc_id")).alias("gone")
    marked = found.groupBy("doc_id").agg(gone, (F.count("*") > 1).alias("repeated")).where("gone or repeated")
    marked = materialize(marked, "marked-ids")
    # Texts are dealt by doc_id at most once, and only for more marked ids than may be broadcast.
    kept = docs.join(small_enough(marked.select("doc_id")), "doc_id", "left_anti").select(docs.columns)
    repeated = materialize(marked.where("not gone").select("doc_id"), "repeated-ids")
    if repeated.isEmpty():
        return kept
    once = docs.join(small_enough(repeated), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionAll(once.select(docs.columns))
