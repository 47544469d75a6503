"""Balanced class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwright.constants import LABEL


def class_weights(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n / (classes * n_class) from class counts ``n``. Two rows, for each value of ``by``."""
    everything = Window.partitionBy(*(by or [F.lit(1)]))
    total, classes = F.sum("n").over(everything), F.count(F.lit(1)).over(everything)
    return counts.select(*by, LABEL, "n", (total / (classes * F.col("n"))).alias("weight"))


def with_class_weight(labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add ``class_weight`` to a table of labels with row counts ``m``, from the rows it holds for each value of ``by``."""
    counts = labels.groupBy(*by, LABEL).agg(F.sum("m").alias("n"))
    weights = class_weights(counts, by).select(*by, LABEL, F.col("weight").alias("class_weight"))
    return labels.join(F.broadcast(weights), [*by, LABEL])
