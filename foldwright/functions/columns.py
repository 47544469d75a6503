"""Column expressions; all of them stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from foldwright.constants import (LOG_LOSS_CLIP, META_COLS, NEGATIVE_CLASS, POSITIVE_CLASS, POSITIVE_CODE,
                                  ROW, TARGET)


def feature_cols(df) -> list[str]:
    """Every column that is not label, group, split, target or row number, in table order."""
    skip = {*META_COLS, ROW, TARGET}
    return [c for c in df.columns if c not in skip]


def group_key(features: Sequence[str]) -> Column:
    """48-bit key of a feature vector: 12 hex digits of the MD5 of its comma-joined values.

    The key is never null. Saying so keeps joins on it from adding a null check, which would
    hash every row a second time below the scan.
    """
    text = F.concat_ws(",", *[F.col(c).cast("string") for c in features])
    return F.coalesce(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long"), F.lit(0).cast("long"))


def seeded_draw(seed: int, key: Column) -> Column:
    """A pseudo-random hex string that depends on the key and the seed only."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def label_from_target(target: str = TARGET) -> Column:
    return F.when(F.col(target) == POSITIVE_CODE, 1).otherwise(0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null when b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def rounded_sql(expression: str, digits: int) -> str:
    """Scale, round half to even, scale back."""
    return f"rint(({expression}) * 1e{digits}D) / 1e{digits}D"


def round_even(name: str, digits: int) -> Column:
    return F.expr(rounded_sql(f"`{name}`", digits))


def clipped(p: Column) -> Column:
    return F.greatest(F.least(p, F.lit(1 - LOG_LOSS_CLIP)), F.lit(LOG_LOSS_CLIP))


def predicted(p: Column, threshold: float) -> Column:
    """Inclusive decision: a score equal to the threshold is positive."""
    return (p >= F.lit(threshold)).cast("int")


def class_name(label: Column) -> Column:
    return F.when(label == 1, POSITIVE_CLASS).otherwise(NEGATIVE_CLASS)


def outcome(label: Column, pred: Column) -> Column:
    return (F.when((label == 1) & (pred == 1), "TP")
            .when((label == 0) & (pred == 0), "TN")
            .when((label == 0) & (pred == 1), "FP")
            .otherwise("FN"))
