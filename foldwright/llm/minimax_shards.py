"""Minimax contiguous partition of documents into shards.

Equal texts form one atomic group. The groups lie in the order of a 60-bit hash of their text, and every shard is a
run of that order. The capacity of a shard is the smallest for which a greedy walk needs no more than the wanted
number of shards; a binary search finds it and the greedy cuts at that capacity are the shard boundaries.

The walk needs group sizes only near its cuts. So the driver holds totals of key ranges, a number that does not grow
with the data: the order is split into ``2 ** LEVEL_0`` ranges, and ranges near a possible cut are split again until
the capacity is known exactly. A range that can be cut anywhere gives a lower bound of the capacity, a range that
cannot be cut gives an upper bound; the search ends when both are equal.

Defined results: a null text counts as an empty one; null and repeated doc_id are kept as they are, one row out for
each row in; texts whose 60-bit hashes agree share a group; an empty table gives an empty result; a group larger than
the mean shard sets the capacity, and then fewer shards than wanted can have rows. Columns other than doc_id and text
are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwright.llm.common import materialize

KEY_BITS, LEVEL_0, STEP = 60, 14, 6
#: Bytes that a row takes besides its text.
ROW_BYTES = 8
#: Rows of a slot cell, the unit in which positions inside a shard are counted.
CELL_ROWS, LEAST_CELLS = 100_000, 16


@dataclass(frozen=True)
class Range:
    """Groups with keys of one prefix: first and last key present, sum of sizes, low bits below the prefix."""

    first: int
    last: int
    size: int
    low: int

    @property
    def atomic(self) -> bool:
        return self.first == self.last


def _totals(rows: DataFrame, low: int) -> list[Range]:
    out = (rows.groupBy(F.shiftright("key", low).alias("prefix"))
           .agg(F.min("key").alias("first"), F.max("key").alias("last"), F.sum("size").alias("size")).collect())
    return [Range(r["first"], r["last"], r["size"], low) for r in out]


class Walk:
    """Greedy walks over the ordered ranges; ``divisible`` lets a walk stop inside a range of several groups."""

    def __init__(self, ranges: list[Range], shards: int):
        self.ranges, self.shards = ranges, shards
        self.ends = list(accumulate(r.size for r in ranges))
        self.starts = [0, *self.ends[:-1]]
        self.total = self.ends[-1]

    def cuts(self, capacity: int, divisible: bool) -> list[int]:
        """The size in front of each cut; the walk goes on after an oversized unit as if it had fitted nowhere."""
        at, out = 0, []
        for _ in range(self.shards):
            reach = at + capacity
            if reach < self.total:
                k = bisect_right(self.ends, reach)
                if not divisible or self.ranges[k].atomic:
                    reach = max(at, self.starts[k])
            at = min(reach, self.total)
            out.append(at)
        return out

    def smallest(self, divisible: bool) -> int:
        low, high = -(-self.total // self.shards), self.total
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, divisible)[-1] >= self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def near_cuts(self, low: int, high: int) -> list[Range]:
        """Ranges of several groups that a greedy cut can fall into for some capacity from ``low`` to ``high``."""
        early, late = self.cuts(low, False), self.cuts(high, True)
        found = {}
        for a, b in zip(early, late):
            for k in range(bisect_right(self.ends, a), len(self.ranges)):
                if self.starts[k] > b:
                    break
                if not self.ranges[k].atomic:
                    found[k] = self.ranges[k]
        return list(found.values())


def boundaries(rows: DataFrame, shards: int) -> list[int]:
    """First key of every shard but the first, for ``rows`` with ``key`` and ``size``."""
    ranges = sorted(_totals(rows, KEY_BITS - LEVEL_0), key=lambda r: r.first)
    if not ranges:
        return []
    while True:
        walk = Walk(ranges, shards)
        low, high = walk.smallest(True), walk.smallest(False)
        if low == high:
            break
        large = [r for r in ranges if not r.atomic and 4 * r.size > low]
        split = large or walk.near_cuts(low, high)
        finer = []
        for bits in {r.low for r in split}:
            prefixes = [r.first >> bits for r in split if r.low == bits]
            finer += _totals(rows.where(F.shiftright("key", bits).isin(prefixes)), max(0, bits - STEP))
        gone = set(split)
        ranges = sorted([r for r in ranges if r not in gone] + finer, key=lambda r: r.first)
    ends = walk.cuts(high, False)
    return [walk.ranges[bisect_right(walk.ends, e)].first for e in ends if e < walk.total]


def shard_of(key: Column, first_keys: list[int]) -> Column:
    return sum((F.when(key >= F.lit(k), 1).otherwise(0) for k in first_keys), F.lit(0)).cast("int")


def _with_slots(rows: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0, cell by cell, so that no task sorts a whole shard."""
    cells = LEAST_CELLS + rows.count() // CELL_ROWS
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(cells)).cast("int"))
    counts = rows.groupBy("shard", "cell").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("cell")) - F.col("count")
    counts = materialize(counts.select("shard", "cell", before.alias("before")), "slot-cells")
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size", "key")
    return (rows.withColumn("inside", F.row_number().over(inside) - 1).join(counts, ["shard", "cell"])
            .withColumn("slot", (F.col("before") + F.col("inside")).cast("long")))


def minimax_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs`` (doc_id, text)."""
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce("text", F.lit(""))
    rows = materialize(docs.select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 64 - KEY_BITS).alias("key")), "shard-rows")
    placed = rows.withColumn("shard", shard_of(F.col("key"), boundaries(rows, shards)))
    return _with_slots(placed).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                                      F.lit(None).cast("int").alias("grown_shard"))
