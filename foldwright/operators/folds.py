"""Stratified group folds, the group hold-out and the stratified random hold-out."""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwright.constants import GROUP, LABEL, ROW, SEED, SPLIT, TEST_SHARE
from foldwright.functions.columns import seeded_draw
from foldwright.operators.running import prefix_sums
from foldwright.session import materialize


# A group is heavy if it holds more than 1 / (HEAVY x folds) of the rows; fewer than HEAVY x folds can.
HEAVY = 4

# The tail of unequal shares is dealt by the fractional parts of multiples of the golden ratio, as whole numbers of 20 bits.
GOLDEN, TURN, PLACES = 2654435769, 1 << 32, 1 << 20


def deal_heavy(heavy: Sequence[tuple[int, int]], rows: int, k: int) -> tuple[dict[int, int], list[int]]:
    """The fold of every heavy group, and the upper bound of each fold in the ``PLACES`` over which the tail is dealt.

    ``heavy`` is (key, rows) in the order of assignment: each goes to the fold with the fewest rows so far, the first of
    equal ones. The tail fills the folds up to one common level, as far as they lie below it.
    """
    loads = [(0, fold) for fold in range(k)]
    placed = {}
    for key, n in heavy:
        least, fold = loads[0]
        heapq.heapreplace(loads, (least + n, fold))
        placed[key] = fold
    filled = sorted(loads)
    tail = rows - sum(n for n, _ in filled)
    level = min((tail + sum(n for n, _ in filled[:m])) // m for m in range(1, k + 1))
    room = {fold: max(0, level - n) for n, fold in loads}
    if not any(room.values()):
        room = dict.fromkeys(room, 1)
    upto = accumulate(room[fold] for fold in range(k))
    return placed, [x * PLACES // sum(room.values()) for x in upto]


def deal_folds(groups: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """Add ``fold`` (0-based) to a group table with ``n`` and ``pos``.

    Groups are ranked by how far and to which side they tilt the class balance, then by
    size, then by a seeded draw, and dealt back and forth over the folds. The rank is a
    running count: tilt, size and four hex digits of the draw are bucket levels, so the many
    groups of equal size spread over 65536 buckets. A window over tilts, or over the sizes of one
    tilt, has at most sqrt(2 x rows) buckets, as d different ones take d^2 / 2 rows.

    Heavy groups (see ``HEAVY``), which alone can unbalance folds, are placed first, the largest first, each in the
    least loaded fold; the others, the tail, are then dealt by their rank in proportion to what is left of each fold.
    The groups are stored with their draw, as they are counted before they are ranked.
    """
    draw = seeded_draw(seed, F.col(GROUP))
    stored = materialize(groups.select("*", draw.alias("_draw"), F.substring(draw, 1, 4).alias("_bucket")), "groups")
    rows = stored.agg(F.sum("n")).first()[0] or 0
    # Fewer than HEAVY x k rows.
    found = stored.where(F.col("n") * (HEAVY * k) > rows).select(GROUP, "n", "_draw").collect()
    order = sorted(found, key=lambda r: (-r.n, r["_draw"], r[GROUP]))
    placed, bounds = deal_heavy([(r[GROUP], r.n) for r in order], rows, k)
    is_heavy = F.col(GROUP).isin(list(placed)) if placed else F.lit(False)
    tail = stored.where(~is_heavy)
    tilt = 2 * F.col("pos") - F.col("n")
    ranked = prefix_sums(
        tail.select("*", F.signum(tilt).cast("int").alias("_side"), F.abs(tilt).alias("_tilt"),
                    F.lit(1).cast("long").alias("_one")),
        by=["_side"],
        levels=[[("_tilt", "desc")], [("n", "desc")], [("_bucket", "asc")]],
        order=[("_draw", "asc"), (GROUP, "asc")],
        measures=["_one"],
    )
    rank = F.col("_one_before")
    if not placed:
        place = F.pmod(rank, F.lit(k))
        backwards = F.pmod(F.floor(rank / F.lit(k)), F.lit(2)) == 1
        fold = F.when(backwards, F.lit(k - 1) - place).otherwise(place).cast("int")
        return ranked.select(*groups.columns, fold.alias("fold"))
    at = F.shiftright(F.pmod(F.pmod(rank, F.lit(1 << 31)) * F.lit(GOLDEN), F.lit(TURN)), 12)
    fold = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= at))
    own = F.create_map(*[x for key, fold in placed.items() for x in (F.lit(key).cast("long"), F.lit(fold).cast("int"))])
    return (ranked.select(*groups.columns, fold.alias("fold"))
            .unionByName(stored.where(is_heavy).select(*groups.columns, own[F.col(GROUP)].alias("fold"))))


def holdout_groups(groups: DataFrame, n_folds: int, seed: int = SEED) -> DataFrame:
    """Add ``split``: the first of ``n_folds`` group folds is the test side."""
    return deal_folds(groups, n_folds, seed).select(
        *groups.columns, F.when(F.col("fold") == 0, "test").otherwise("train").alias(SPLIT))


def random_holdout(rows: DataFrame, share: float = TEST_SHARE, seed: int = SEED,
                   row_key: str = ROW) -> DataFrame:
    """Add ``split`` with an exact per-class quota, ignoring groups.

    The test side of a class is its ``quota`` smallest seeded draws. Counting rows per
    draw prefix finds the one bucket where the quota is reached; only that bucket (about
    1 / 65536 of a class) is ranked, which yields one threshold draw per class. Rows are then
    compared with the two thresholds: the table itself is never shuffled.
    """
    draw = seeded_draw(seed, F.col(row_key))
    drawn = rows.select(F.col(LABEL), F.col(row_key), draw.alias("_draw"),
                        F.substring(draw, 1, 4).alias("_bucket"))
    counts = drawn.groupBy(LABEL, "_bucket").agg(F.count(F.lit(1)).alias("m"))

    # At most 65536 buckets per class. The test side has ceil(share x rows) rows; each of the two
    # classes gets the floor of its part, and the larger remainder takes the row that is left.
    run = Window.partitionBy(LABEL).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    edge = (
        counts.select("*", F.sum("m").over(run).alias("_upto"),
                      F.sum("m").over(Window.partitionBy(LABEL)).alias("_class"),
                      F.sum("m").over(Window.partitionBy(F.lit(1))).alias("_rows"))
        .withColumn("_side", F.ceil(F.col("_rows") * F.lit(share)))
        .withColumn("_part", F.col("_class") / F.col("_rows") * F.col("_side"))
        .withColumn("_other", F.col("_side") - F.col("_part"))
        .withColumn("_quota", F.expr(
            f"floor(_part) + int(floor(_part) + floor(_other) < _side AND (_part - floor(_part), {LABEL}) "
            f"> (_other - floor(_other), 1 - {LABEL}))"))
        .where((F.col("_upto") >= F.col("_quota")) & (F.col("_upto") - F.col("m") < F.col("_quota")))
        .select(LABEL, "_bucket", (F.col("_quota") - F.col("_upto") + F.col("m")).alias("_need"))
    )
    in_edge = Window.partitionBy(LABEL).orderBy("_draw", row_key)
    limits = (
        drawn.join(F.broadcast(edge), [LABEL, "_bucket"])
        .withColumn("_at", F.row_number().over(in_edge))
        .where(F.col("_at") == F.col("_need"))
        .select(LABEL, F.struct(F.col("_draw"), F.col(row_key)).alias("_limit"))
    )
    here = F.struct(draw.alias("_draw"), F.col(row_key))
    return rows.join(F.broadcast(limits), LABEL, "left").select(
        *rows.columns, F.when(here <= F.col("_limit"), "test").otherwise("train").alias(SPLIT))
