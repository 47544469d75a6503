"""Running sums over an order that may be far too long for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Order = list[tuple[str, str]]


def prefix_sums(df: DataFrame, by: list[str], levels: list[Order], order: Order,
                measures: list[str]) -> DataFrame:
    """Add ``<m>_before``: the sum of ``m`` over all rows ahead of this one within ``by``.

    Rows are ordered by the bucket columns of ``levels`` (coarse to fine), then by
    ``order``. Each level splits its parent bucket, so a window only ever sorts the rows
    of one finest bucket, or the bucket totals below one parent. Bucket totals come from
    a map-side combined aggregate and are rolled up level by level; no task sees a whole
    ``by`` group of the input.
    """
    names = [[c for c, _ in level] for level in levels]
    depth = len(levels)
    keys = [by + sum(names[:i], []) for i in range(depth + 1)]

    def ahead(m: str, partition: list[str], ordering: Order, name: str):
        sort = ", ".join(f"{c} {way}" for c, way in ordering)
        return F.expr(f"coalesce(sum({m}) OVER (PARTITION BY {', '.join(partition)} ORDER BY {sort} "
                      f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS {name}")

    sums = [F.expr(f"sum({m}) AS {m}") for m in measures]
    totals = df.groupBy(*keys[depth]).agg(*sums)
    offsets = None
    for i in range(depth, 0, -1):
        step = totals.select(*keys[i], *[ahead(m, keys[i - 1], levels[i - 1], f"_{m}_{i}") for m in measures])
        offsets = step if offsets is None else offsets.join(step, keys[i])
        if i > 1:
            totals = totals.groupBy(*keys[i - 1]).agg(*sums)

    local = df.select("*", *[ahead(m, keys[depth], order, f"_{m}_0") for m in measures])
    before = [F.expr(" + ".join(f"_{m}_{i}" for i in range(depth + 1)) + f" AS {m}_before") for m in measures]
    return local.join(offsets, keys[depth]).select(*df.columns, *before)
