"""Binary classification metrics for any number of evaluations in one job."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.constants import (DECISION_THRESHOLD, EVAL_FOLD_PREFIX, EVAL_MEAN, EVAL_OOF, EVAL_STD, EVAL_TEST,
                                  LABEL, METRIC_COLUMNS, METRIC_LABELS, NEGATIVE_CLASS, POSITIVE_CLASS)
from foldwright.functions.columns import clipped, predicted, round_even
from foldwright.operators.running import prefix_sums


def score_counts(scored: DataFrame, by: Sequence[str], score: str = "score", label: str = LABEL) -> DataFrame:
    """Positives and negatives per distinct score. Copies collapse before the shuffle."""
    y = F.col(label).cast("long")
    return scored.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))


def vector_score_counts(vectors: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    """The same from scored vectors with multiplicity ``n`` and positives ``pos``."""
    return vectors.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum("pos").alias("pos"), F.sum(F.col("n") - F.col("pos")).alias("neg"))


def fold_and_pooled(counts: DataFrame, fold: str = "cv_fold", pooled: str = EVAL_OOF) -> DataFrame:
    """Turn per-fold score counts into one evaluation per fold plus the pooled one.

    The small count table is doubled, not the scored rows.
    """
    tags = F.array(F.lit(pooled), F.concat(F.lit(EVAL_FOLD_PREFIX), F.col(fold).cast("string")))
    return (counts.select(F.explode(tags).alias("evaluation"), "score", "pos", "neg")
            .groupBy("evaluation", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))


def _ranked(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Positives and negatives above every distinct score.

    Scores fall into buckets of 2^-16 and 2^-32: a window sorts at most 65536 bucket totals,
    or the scores that agree to nine decimals, however the scores are spread.
    """
    buckets = counts.withColumns({"_coarse": F.floor(F.col("score") * float(2 ** 16)),
                                  "_fine": F.floor(F.col("score") * float(2 ** 32))})
    return prefix_sums(buckets, list(by), [[("_coarse", "desc")], [("_fine", "desc")]], [("score", "desc")],
                       ["pos", "neg"])


def _auc_and_precision():
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    positives, negatives = F.sum(pos), F.sum(neg)
    lost = F.sum(pos * (F.col("neg_before") + neg / 2))
    hits = F.col("pos_before") + pos
    step = pos * F.try_divide(hits, hits + F.col("neg_before") + neg)
    auc = 1 - F.try_divide(lost, positives * negatives)
    return auc, F.coalesce(F.try_divide(F.sum(step), positives), F.lit(0.0))


def ranking_metrics(counts: DataFrame, by: Sequence[str] = ("evaluation",)) -> DataFrame:
    """ROC-AUC (ties count half; null for a single class) and average precision (step sum; 0 without positives)."""
    auc, precision = _auc_and_precision()
    return _ranked(counts, by).groupBy(*by).agg(auc.alias("roc_auc"), precision.alias("pr_auc"))


def confusion_matrix(counts: DataFrame, by: Sequence[str] = ("evaluation",),
                     threshold: float = DECISION_THRESHOLD) -> DataFrame:
    hit = predicted(F.col("score"), threshold) == 1
    return counts.groupBy(*by).agg(*_cells(hit)).select(
        *by, "tn", "fp", "fn", "tp",
        F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("confusion_matrix"))


def _cells(hit):
    def count(c, cond):
        return F.sum(F.when(cond, F.col(c)).otherwise(F.lit(0).cast("long")))

    return [count("neg", ~hit).alias("tn"), count("neg", hit).alias("fp"),
            count("pos", ~hit).alias("fn"), count("pos", hit).alias("tp")]


def _losses():
    p, pos, neg = F.col("score"), F.col("pos").cast("double"), F.col("neg").cast("double")
    rows = F.sum(pos + neg)
    loss = -F.sum(pos * F.ln(clipped(p)) + neg * F.ln(1 - clipped(p)))
    brier = F.sum(pos * (p - 1) * (p - 1) + neg * p * p)
    return F.try_divide(loss, rows), F.try_divide(brier, rows)


def losses(counts: DataFrame, by: Sequence[str] = ("evaluation",)) -> DataFrame:
    """Log loss of the clipped score and Brier score."""
    log_loss, brier = _losses()
    return counts.groupBy(*by).agg(log_loss.alias("log_loss"), brier.alias("brier_score"))


# Count-based metrics over double columns tp, fp, tn, fn. Undefined ratios are null, except
# that precision, recall and the F scores are zero.
_N, _RECALL, _SPECIFICITY = "(tp + fp + tn + fn)", "ifnull(try_divide(tp, tp + fn), 0D)", "try_divide(tn, tn + fp)"
_F_POS = "ifnull(try_divide(2 * tp, 2 * tp + fp + fn), 0D)"
_F_NEG = "ifnull(try_divide(2 * tn, 2 * tn + fp + fn), 0D)"
_CHANCE = f"(((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / ({_N} * {_N}))"
THRESHOLD_METRICS = {
    "accuracy": f"(tp + tn) / {_N}",
    # With one class absent, balanced accuracy is the recall of the other.
    "balanced_accuracy": f"CASE WHEN tp + fn = 0 THEN {_SPECIFICITY} WHEN tn + fp = 0 THEN {_RECALL} "
                         f"ELSE ({_RECALL} + {_SPECIFICITY}) / 2 END",
    "precision": "ifnull(try_divide(tp, tp + fp), 0D)",
    "recall": _RECALL,
    "specificity": _SPECIFICITY,
    "npv": "try_divide(tn, tn + fn)",
    "f1": _F_POS,
    # The mean over the classes that occur among labels or predictions.
    "f1_macro": f"CASE WHEN tp + fp + fn = 0 THEN {_F_NEG} WHEN tn + fp + fn = 0 THEN {_F_POS} "
                f"ELSE ({_F_POS} + {_F_NEG}) / 2 END",
    "f1_weighted": f"({_F_POS} * (tp + fn) + {_F_NEG} * (tn + fp)) / {_N}",
    "f2": "ifnull(try_divide(5 * tp, 5 * tp + 4 * fn + fp), 0D)",
    "false_positive_rate": "try_divide(fp, fp + tn)",
    "false_negative_rate": "try_divide(fn, fn + tp)",
    "mcc": "ifnull(try_divide(tp * tn - fp * fn, sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), 0D)",
    "cohen_kappa": f"try_divide((tp + tn) / {_N} - {_CHANCE}, 1 - {_CHANCE})",
}
_THRESHOLD_SQL = [f"{e} AS {m}" for m, e in THRESHOLD_METRICS.items()]


def _as_double(cells: DataFrame) -> DataFrame:
    return cells.withColumns({c: F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn")})


def threshold_metrics(cells: DataFrame, by: Sequence[str] = ("evaluation",)) -> DataFrame:
    return _as_double(cells).selectExpr(*by, *_THRESHOLD_SQL)


def compute_metrics(counts: DataFrame, by: Sequence[str] = ("evaluation",),
                    threshold: float = DECISION_THRESHOLD) -> DataFrame:
    """All 26 scalars and the nested confusion matrix, one row per evaluation.

    One pass over the distinct scores feeds the threshold counts, the losses and the
    ranking metrics. Undefined ratios are null.
    """
    auc, precision = _auc_and_precision()
    log_loss, brier = _losses()
    hit = predicted(F.col("score"), threshold) == 1
    base = _ranked(counts, by).groupBy(*by).agg(
        F.sum("pos").alias("n_phishing"), F.sum("neg").alias("n_legitimate"), *_cells(hit),
        auc.alias("roc_auc"), precision.alias("pr_auc"), log_loss.alias("log_loss"), brier.alias("brier_score"))
    full = _as_double(base).selectExpr(
        "*", "n_phishing + n_legitimate AS n_samples", f"{threshold}D AS threshold", *_THRESHOLD_SQL)
    cells = [f"cast({c} AS bigint) AS {c}" if c in ("tp", "fp", "tn", "fn") else c for c in METRIC_COLUMNS]
    return full.selectExpr(*by, *cells,
                           "cast(array(array(tn, fp), array(fn, tp)) AS array<array<bigint>>) AS confusion_matrix")


def fold_statistics(metrics: DataFrame) -> DataFrame:
    """Mean and sample standard deviation of every metric over the fold evaluations."""
    folds = metrics.where(F.col("evaluation").startswith(EVAL_FOLD_PREFIX))
    stats = folds.agg(*[F.expr(f"{f}(cast({m} AS double)) AS {tag}_{m}") for m in METRIC_COLUMNS
                        for tag, f in (("mean", "avg"), ("std", "stddev_samp"))])
    rows = [f"named_struct('evaluation', '{name}', " + ", ".join(f"'{m}', {tag}_{m}" for m in METRIC_COLUMNS) + ")"
            for name, tag in ((EVAL_MEAN, "mean"), (EVAL_STD, "std"))]
    return stats.selectExpr(f"inline(array({', '.join(rows)}))")


def metrics_summary(metrics: DataFrame) -> DataFrame:
    """Every evaluation plus fold mean and deviation; counts widen to double."""
    wide = metrics.selectExpr("evaluation", *[f"cast({m} AS double) AS {m}" for m in METRIC_COLUMNS])
    return wide.unionByName(fold_statistics(metrics))


def summary_order() -> list[Column]:
    """Sort keys of a summary: hold-out, pooled, folds by number, mean, deviation, comparison runs.

    Runs on all features come before those on the selected ones, the random split before the group split.
    """
    name = F.col("evaluation")
    place = (F.when(name == EVAL_TEST, 0).when(name == EVAL_OOF, 1).when(name.startswith(EVAL_FOLD_PREFIX), 2)
             .when(name == EVAL_MEAN, 3).when(name == EVAL_STD, 4).otherwise(5))
    return [place, F.when(place == 5, name.contains("selected_features")),
            F.when(place == 5, name.contains("group_split")), F.length(name), name]


def metrics_display(summary: DataFrame) -> DataFrame:
    """Four-decimal display rows (evaluation, metric, label, text) of the labelled metrics."""
    names = list(METRIC_LABELS)
    label = F.create_map(*[F.lit(x) for pair in METRIC_LABELS.items() for x in pair])[F.col("metric")]
    text = F.when(F.col("value").isNull(), "nan").otherwise(F.format_string("%.4f", round_even("value", 4)))
    return summary.unpivot(["evaluation"], names, "metric", "value").select(
        "evaluation", "metric", label.alias("label"), text.alias("text"))


def class_report(cells: DataFrame, by: Sequence[str] = ("evaluation",)) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted rows."""
    wide = _as_double(cells).selectExpr(
        *by, f"{_N} AS n", "tp + fn AS n1", "tn + fp AS n0", f"(tp + tn) / {_N} AS accuracy",
        "ifnull(try_divide(tp, tp + fp), 0D) AS p1", f"{_RECALL} AS r1", f"{_F_POS} AS f1",
        "ifnull(try_divide(tn, tn + fn), 0D) AS p0", f"ifnull({_SPECIFICITY}, 0D) AS r0", f"{_F_NEG} AS f0")
    rows = [(NEGATIVE_CLASS, "p0", "r0", "f0", "n0"), (POSITIVE_CLASS, "p1", "r1", "f1", "n1"),
            ("accuracy", "cast(NULL AS double)", "cast(NULL AS double)", "accuracy", "n"),
            ("macro avg", *[f"({m}0 + {m}1) / 2" for m in "prf"], "n"),
            ("weighted avg", *[f"({m}0 * n0 + {m}1 * n1) / n" for m in "prf"], "n")]
    structs = [f"named_struct('position', {i}, 'class', '{name}', 'precision', {p}, 'recall', {r}, 'f1', {f}, "
               f"'support', cast({support} AS bigint))" for i, (name, p, r, f, support) in enumerate(rows)]
    return wide.selectExpr(*by, f"inline(array({', '.join(structs)}))")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
