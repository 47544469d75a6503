"""Recorded results: the measured fixture numbers and the published metric values."""

import math

import pytest
from pyspark.sql import functions as F

from foldwright.operators import metrics as M
from foldwright.operators.selection import one_se_choice, selection_curve
from foldwright.plans import catalog

MIDDLE = "/root/testdata/sf0.01"

# Evaluation, tp, fp, tn, fn, accuracy, balanced accuracy, precision, recall, specificity, npv,
# f1, f1 macro, f1 weighted, f2, false positive rate, false negative rate, mcc, kappa.
PUBLISHED = [
    ("test_holdout", 847, 98, 1135, 134, 0.895212, 0.891962, 0.896296, 0.863405, 0.920519, 0.894405, 0.879543,
     0.893409, 0.894987, 0.869788, 0.079481, 0.136595, 0.787305, 0.786875),
    ("train_cv_out_of_fold", 3424, 444, 4480, 493, 0.894017, 0.891984, 0.885212, 0.874138, 0.909829, 0.900865,
     0.879640, 0.892483, 0.893945, 0.876331, 0.090171, 0.125862, 0.785022, 0.784972),
    ("cv_fold_1", 675, 126, 857, 108, 0.867497, 0.866945, 0.842697, 0.862069, 0.871821, 0.888083, 0.852273,
     0.866075, 0.867638, 0.858124, 0.128179, 0.137931, 0.732333, 0.732178),
    ("cv_fold_2", 684, 91, 894, 99, 0.892534, 0.890589, 0.882581, 0.873563, 0.907614, 0.900302, 0.878049,
     0.890996, 0.892475, 0.875352, 0.092386, 0.126437, 0.782030, 0.781997),
    ("cv_fold_3", 678, 71, 914, 106, 0.899943, 0.896357, 0.905207, 0.864796, 0.927919, 0.896078, 0.884540,
     0.898130, 0.899675, 0.872587, 0.072081, 0.135204, 0.796989, 0.796342),
    ("cv_fold_4", 689, 79, 907, 95, 0.901695, 0.899352, 0.897135, 0.878827, 0.919878, 0.905190, 0.887887,
     0.900181, 0.901584, 0.882428, 0.080122, 0.121173, 0.800513, 0.800378),
    ("cv_fold_5", 698, 77, 908, 85, 0.908371, 0.906635, 0.900645, 0.891443, 0.921827, 0.914401, 0.896021,
     0.907060, 0.908321, 0.893268, 0.078173, 0.108557, 0.814158, 0.814123),
    ("all, random", 927, 43, 1188, 53, 0.956581, 0.955494, 0.955670, 0.945918, 0.965069, 0.957293, 0.950769,
     0.955967, 0.956557, 0.947853, 0.034931, 0.054082, 0.911974, 0.911936),
    ("all, group", 913, 49, 1184, 68, 0.947154, 0.945471, 0.949064, 0.930683, 0.960260, 0.945687, 0.939784,
     0.946351, 0.947098, 0.934302, 0.039740, 0.069317, 0.892845, 0.892709),
    ("selected, random", 854, 103, 1128, 126, 0.896427, 0.893878, 0.892372, 0.871429, 0.916328, 0.899522,
     0.881776, 0.894812, 0.896291, 0.875538, 0.083672, 0.128571, 0.789822, 0.789646),
]
# Fold mean and sample deviation of accuracy, mcc and true positives.
FOLD_MEAN, FOLD_STD = (0.894008, 0.785204, 684.8), (0.015856, 0.031690, 9.148770)

# Subset size, mean fold AUC, standard error.
CURVE = [
    (20, 0.9639980589700151, 0.0029321937352999525), (19, 0.9640003160845977, 0.0030882633875902905),
    (18, 0.9644873575267676, 0.0029359402744478557), (17, 0.9639860557080361, 0.0030998265563068586),
    (16, 0.9641337782321762, 0.002922570190026903), (15, 0.963822606765025, 0.002737908591551975),
    (14, 0.9633821257813423, 0.0027595474544719724), (13, 0.9636570832984871, 0.002755507311218134),
    (12, 0.9638472012816406, 0.002647437613822745), (11, 0.9634296610183603, 0.0028411139020406736),
    (10, 0.9631090378953641, 0.002772511317602688), (9, 0.9604954470335538, 0.003374119754620217),
    (8, 0.9597641279036699, 0.003008238672107346), (7, 0.9564103147426749, 0.0032250539792167457),
    (6, 0.9549326906237756, 0.003289363951492295), (5, 0.9525849308778342, 0.0034655196212856525),
    (4, 0.9451824333634107, 0.005064256413398743), (3, 0.9290636790986406, 0.008315599632676548),
    (2, 0.9013548051231884, 0.0068531143637635536), (1, 0.8774471878081179, 0.006459461726910538),
]


def published_counts(spark):
    """Two scores per evaluation, 1 for predicted positives and 0 for the others, give the recorded cells."""
    rows = []
    for name, tp, fp, tn, fn, *_ in PUBLISHED:
        rows += [(name, 1.0, tp, fp), (name, 0.0, fn, tn)]
    return spark.createDataFrame(rows, "evaluation string, score double, pos long, neg long")


def test_published_threshold_metrics(spark):
    got = {r.evaluation: r for r in M.compute_metrics(published_counts(spark)).collect()}
    names = list(M.THRESHOLD_METRICS)
    for name, tp, fp, tn, fn, *values in PUBLISHED:
        row = got[name]
        assert (row.tp, row.fp, row.tn, row.fn) == (tp, fp, tn, fn)
        assert row.confusion_matrix == [[tn, fp], [fn, tp]]
        assert [round(row[m], 6) for m in names] == pytest.approx(values, abs=1.1e-6)


def test_published_fold_statistics(spark):
    stats = {r.evaluation: r for r in M.fold_statistics(M.compute_metrics(published_counts(spark))).collect()}
    for tag, want in (("cv_mean", FOLD_MEAN), ("cv_std", FOLD_STD)):
        row = stats[tag]
        assert (row.accuracy, row.mcc, row.tp) == pytest.approx(want, abs=1e-6)


def test_published_one_se_choice(spark):
    curve = spark.createDataFrame(CURVE, "n_features int, auc_mean double, auc_se double")
    row = one_se_choice(curve).first()
    assert (row.best_n_features, row.chosen_n_features) == (18, 10)
    assert row.threshold == pytest.approx(0.961551, abs=1e-6)
    assert row.chosen_cv_auc == 0.9631090378953641


def test_best_of_equal_points_is_the_larger_subset(spark):
    curve = spark.createDataFrame([(3, 0.9, 0.0), (2, 0.9, 0.2), (1, 0.8, 0.0)],
                                  "n_features int, auc_mean double, auc_se double")
    row = one_se_choice(curve).first()
    assert (row.best_n_features, row.chosen_n_features) == (3, 2)


def test_curve_uses_sample_deviation(spark):
    aucs = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.7), (1, 2, 0.9)], "n_features int, fold int, auc double")
    row = selection_curve(aucs).first()
    assert row.auc_mean == pytest.approx(0.7) and row.auc_se == pytest.approx(0.2 / math.sqrt(3))


def test_measured_profile_and_folds(spark):
    queries = catalog.sql_checked()
    p = queries["dup_stats"](spark, MIDDLE).first()
    assert (p.n_rows, p.n_phishing, p.distinct_vectors, p.conflicting_label_vectors, p.exact_duplicate_rows) == (
        15000, 6890, 1596, 263, 13141)
    folds = queries["fold_balance"](spark, MIDDLE).orderBy("fold").collect()
    assert [r.n_rows for r in folds] == [3028, 3011, 2980, 2995, 2986]
    assert [r.n_phishing for r in folds] == [1388, 1390, 1369, 1375, 1368]


def test_measured_diagnostics(spark):
    # Measured AUC and mutual information at this scale.
    want = {"f_gross": (0.991281, 0.600681), "f_lines": (0.883177, 0.302505), "f_maxprice": (0.764221, 0.143156),
            "f_maxqty": (0.634095, 0.039601), "f_anyret": (0.589584, 0.038318), "f_anyf": (0.584519, 0.041575),
            "f_prio": (0.579136, 0.000029), "f_status": (0.551489, 0.000014)}
    rows = catalog.sql_checked()["leakage_diagnostics"](spark, MIDDLE).collect()
    assert [r.feature for r in rows] == list(want)
    for r in rows:
        assert (r.single_feature_auc, r.mutual_info) == pytest.approx(want[r.feature], abs=1e-6)
        assert r.documented_leaky == (r.feature == "f_gross")
        assert r.suspicious == (r.feature in ("f_gross", "f_lines"))


def test_measured_score_metrics(spark):
    m = M.compute_metrics(catalog._stored_counts(spark, MIDDLE)).where(
        F.col("evaluation") == "train_cv_out_of_fold").first()
    assert (m.tp, m.fp) == (5377, 791)
    assert (m.roc_auc, m.pr_auc, m.log_loss, m.brier_score) == pytest.approx(
        (0.929969, 0.910574, 0.563630, 0.186992), abs=1e-6)
