"""The three steps on 100 rows with three features and tiny forests, artifacts included."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwright.constants import PREDICTION_COLUMNS
from foldwright.operators import leakage as L
from foldwright.operators.forest import score
from foldwright.plans import outputs as O
from foldwright.plans.audit import remove_leaky
from foldwright.plans.evaluate import train_and_evaluate
from foldwright.plans.select import select_features
from foldwright.sources.models import load_model
from foldwright.sources.publication import is_whole, published
from foldwright.sources.tables import metric_records, parameters, read_report, read_variant

FEATURES = ["URL_Length", "having_IP_Address", "Prefix_Suffix"]


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    rng = np.random.default_rng(42)
    values = rng.choice([-1, 0, 1], size=(100, 3))
    raw = spark.createDataFrame([(i, *map(int, v), -1 if i % 2 == 0 else 1) for i, v in enumerate(values)],
                                "row_index long, URL_Length byte, having_IP_Address byte, Prefix_Suffix byte, "
                                "Result byte")
    out = str(tmp_path_factory.mktemp("out"))
    audit = remove_leaky(raw, L.registry(spark))
    O.write_audit(audit, out)
    selection = select_features(audit.clean, {"numTrees": 2, "maxDepth": 2, "seed": 42})
    O.write_selection(selection, out)
    result = train_and_evaluate(audit.clean, raw, selection.selected, n_iter=1,
                                space={"n_estimators": range(2, 3), "max_depth": [2]})
    O.write_evaluation(spark, result, out)
    return out, audit, selection, result


def test_artifacts(run):
    assert set(os.listdir(run[0])) == {O.CLEAN, O.LEAKAGE, O.SELECTION, O.TEST_PREDICTIONS, O.OOF_PREDICTIONS, O.MODEL,
                                       O.METRICS, O.SUMMARY, O.DISPLAY, O.CLASS_REPORT}


def test_split_never_shares_a_group(run):
    clean = run[1].clean
    assert clean.count() == 100
    assert clean.groupBy("group_id").agg(F.countDistinct("split").alias("s")).where("s > 1").count() == 0


def test_reports_agree(spark, run):
    out, audit, selection, result = run
    leakage = read_report(spark, f"{out}/{O.LEAKAGE}").first()
    assert (leakage.mode, leakage.n_rows, leakage.kept) == ("default", 100, FEATURES)
    in_force = {r.feature for r in L.drop_set(L.registry(spark), False).collect()}
    assert set(leakage.removed.__fields__) == in_force and len(in_force) == 10
    assert sorted(d.feature for d in leakage.diagnostics) == sorted(FEATURES)
    aucs = [d.single_feature_auc for d in leakage.diagnostics]
    assert aucs == sorted(aucs, reverse=True)
    chosen = read_report(spark, f"{out}/{O.SELECTION}").first()
    metrics = read_report(spark, f"{out}/{O.METRICS}").first()
    _, features, positive = load_model(spark, f"{out}/{O.MODEL}")
    assert features == chosen.selected_features == metrics.features == selection.selected
    assert positive == "phishing"
    assert [c.n_features for c in chosen.curve] == [3, 2, 1] and [r.rfe_rank for r in chosen.ranking] == [1, 2, 3]
    assert len(metrics.train_cv_folds) == 5 and len(metrics.leakage_references.__fields__) == 3
    assert sorted(chosen.selected_features + chosen.dropped_features) == sorted(FEATURES)
    top = sorted(r.feature for r in chosen.ranking if r.rfe_rank <= len(features))
    assert sorted(features) == top == sorted(r.feature for r in chosen.ranking if r.selected)


@pytest.mark.parametrize("name,side", [(O.TEST_PREDICTIONS, "test"), (O.OOF_PREDICTIONS, "train_oof")])
def test_predictions(spark, run, name, side):
    out, audit, selection, result = run
    got = published(spark, f"{out}/{name}")
    assert is_whole(spark, f"{out}/{name}")
    extra = ["cv_fold"] if side == "train_oof" else []
    assert got.columns == [*PREDICTION_COLUMNS, *extra, *selection.selected]
    clean = {r.row_index: r for r in audit.clean.collect()}
    rows = got.collect()
    want = "train" if side == "train_oof" else "test"
    assert {r.row_index for r in rows} == {i for i, r in clean.items() if r.split == want}
    for r in rows:
        source = clean[r.row_index]
        assert r.split == side and r.true_label == source.is_phishing and r.group_id == source.group_id
        assert [r[f] for f in selection.selected] == [source[f] for f in selection.selected]
        assert r.prob_phishing + r.prob_legitimate == pytest.approx(1)
        assert r.predicted_label == int(r.prob_phishing >= 0.5)
    if extra:
        assert {r.cv_fold for r in rows} == {1, 2, 3, 4, 5}
    else:
        model, _, _ = load_model(spark, f"{out}/{O.MODEL}")
        held = audit.clean.where("split = 'test'")
        again = {r.row_index: r.score for r in score(model, held).collect()}
        assert all(abs(again[r.row_index] - r.prob_phishing) <= 5.1e-7 for r in rows)
        # The saved pipeline decides by itself.
        decided = {r.row_index: (r.predicted_label, r.predicted_class) for r in model.transform(held).collect()}
        assert decided == {r.row_index: (r.predicted_label, r.predicted_class) for r in rows}


def test_summary(spark, run):
    out, _, _, result = run
    summary = published(spark, f"{out}/{O.SUMMARY}")
    assert summary.first().evaluation == "test_holdout"
    assert summary.count() == 12 and "confusion_matrix" not in summary.columns
    test = result.metrics.where("evaluation = 'test_holdout'").first()
    row = summary.where("evaluation = 'test_holdout'").first()
    assert float(row.accuracy) == round(test.accuracy, 6)
    folds = [r.roc_auc for r in result.metrics.where("evaluation like 'cv_fold_%'").collect()]
    assert result.cv_roc_auc == pytest.approx(np.mean(folds))
    oof = result.metrics.where("evaluation = 'train_cv_out_of_fold'").first()
    assert oof.n_samples + test.n_samples == 100


def test_report_as_variant_gives_the_typed_metrics(spark, run):
    out, _, _, result = run
    report = read_variant(spark, f"{out}/{O.METRICS}")
    got = {r.evaluation: r for r in metric_records(report).collect()}
    want = {r.evaluation: r for r in result.metrics.drop("confusion_matrix").collect()}
    assert set(got) == set(want)
    for name, r in want.items():
        assert all(getattr(got[name], c) == (pytest.approx(v) if v is not None else None) for c, v in r.asDict().items() if c != "evaluation")
    assert {(r.name, r.value) for r in parameters(report).collect()} == {("n_estimators", "2"), ("max_depth", "2")}
    assert {r.kind for r in parameters(report).collect()} == {"BIGINT"}


def test_report_is_valid_json(run):
    part = [f for f in os.listdir(f"{run[0]}/{O.METRICS}") if f.startswith("part-")][0]
    with open(f"{run[0]}/{O.METRICS}/{part}") as f:
        record = json.loads(f.read())
    assert record["best_params"] == {"n_estimators": 2, "max_depth": 2}
    assert [f["evaluation"] for f in record["train_cv_folds"]] == [f"cv_fold_{k}" for k in range(1, 6)]
    assert record["test"]["n_samples"] > 0 and set(record["feature_importance"]) == set(run[2].selected)
