"""Operators against brute force on small and awkward inputs."""

import hashlib
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from foldwright.constants import PREDICTION_COLUMNS
from foldwright.operators import cube as C
from foldwright.operators import folds as FO
from foldwright.operators import leakage as L
from foldwright.operators import metrics as M
from foldwright.operators import profile as P
from foldwright.operators import sketches
from foldwright.operators import vectors as V
from foldwright.operators.predictions import prediction_table
from foldwright.operators.running import prefix_sums
from foldwright.operators.weights import class_weights
from foldwright.operators.rate_model import TargetRates, TargetRatesModel
from foldwright.plans import audit, check_sql, rates
from foldwright.session import scratch_path
from tests.conftest import SMALL

FEATURES = ["a", "b"]


def table(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                 "row_index long, a byte, b byte, is_phishing int")


def skewed(spark, n=600, seed=1):
    """A third of the rows share one vector."""
    rng = random.Random(seed)
    rows = [(1, 1, int(rng.random() < 0.9)) for _ in range(n // 3)]
    rows += [(rng.choice([-1, 0, 1]), rng.randint(-20, 20), rng.randint(0, 1)) for _ in range(n - n // 3)]
    return table(spark, rows)


def test_prefix_sums_match_a_sorted_scan(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xy"), rng.randint(0, 3), rng.randint(0, 2), i, rng.randint(1, 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, c int, f int, k int, m long")
    got = {(r.g, r.k): r.m_before for r in prefix_sums(
        df, ["g"], [[("c", "desc")], [("f", "asc")]], [("k", "desc")], ["m"]).collect()}
    for g in "xy":
        seen = 0
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2], -r[3])):
            assert got[(g, r[3])] == seen
            seen += r[4]


def test_group_key_is_the_hash_of_the_row_text(spark):
    got = V.with_group_id(table(spark, [(1, 0, 1), (-1, 20, 0)]), FEATURES).orderBy("row_index").collect()
    want = [int(hashlib.md5(t.encode()).hexdigest()[:12], 16) for t in ("1,0", "-1,20")]
    assert [r.group_id for r in got] == want


def brute_folds(groups, k, seed=42):
    def draw(g):
        return hashlib.md5(f"{seed}:{g[0]}".encode()).hexdigest()

    total, out, loads = sum(g[1] for g in groups), {}, [0] * k
    heavy = sorted((g for g in groups if g[1] * 4 * k > total), key=lambda g: (-g[1], draw(g), g[0]))
    for g in heavy:
        out[g[0]] = loads.index(min(loads))
        loads[out[g[0]]] += g[1]
    left, order = total - sum(loads), sorted(loads)
    level = min((left + sum(order[:m])) // m for m in range(1, k + 1))
    room = [max(0, level - x) for x in loads]
    room = room if any(room) else [1] * k
    bounds = [sum(room[:f + 1]) * 2 ** 20 // sum(room) for f in range(k)]
    for side in (-1, 0, 1):
        mine = [g for g in groups if g not in heavy and (2 * g[2] - g[1] > 0) - (2 * g[2] - g[1] < 0) == side]
        mine.sort(key=lambda g: (-abs(2 * g[2] - g[1]), -g[1], draw(g), g[0]))
        for rank, g in enumerate(mine):
            place = rank % k
            at = rank * 2654435769 % 2 ** 32 >> 12
            out[g[0]] = (sum(b <= at for b in bounds) if heavy else place if rank // k % 2 == 0 else k - 1 - place)
    return out


@pytest.mark.parametrize("heavy", [[], [900], [600, 500, 70], [10 ** 12], [200] * 9])
def test_folds_with_heavy_groups(spark, heavy):
    rng = random.Random(len(heavy))
    sizes = heavy + [rng.choice([1, 1, 2, 3]) for _ in range(800)]
    groups = [(2 ** 40 + i, n, rng.randint(0, n)) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(groups, "group_id long, n long, pos long")
    got = {r.group_id: r.fold for r in FO.deal_folds(df, 5).collect()}
    assert got == brute_folds(groups, 5)
    with duckdb.connect() as con:
        con.execute("CREATE TABLE g (group_id BIGINT, n BIGINT, pos BIGINT)")
        con.executemany("INSERT INTO g VALUES (?, ?, ?)", groups)
        assert dict(con.sql("WITH RECURSIVE " + check_sql.deal("f", "g") + " SELECT group_id, fold FROM f").fetchall()) == got


def test_a_group_with_a_third_of_the_rows_leaves_the_other_folds_equal(spark):
    rng = random.Random(1)
    groups = [(i, rng.choice([1, 1, 2, 3]), 0) for i in range(26_000)]
    groups = [(i, n, rng.randint(0, n)) for i, n, _ in groups]
    third = sum(n for _, n, _ in groups) // 2
    df = spark.createDataFrame([*groups, (99_999, third, third // 3)], "group_id long, n long, pos long")
    folds = {r.fold: (r.n, r.pos) for r in FO.deal_folds(df, 5).groupBy("fold").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).collect()}
    heavy = next(f for f, (n, _) in folds.items() if n == third)
    others = [x for f, x in folds.items() if f != heavy]
    mean, share = sum(n for n, _ in others) / 4, sum(p for _, p in others) / sum(n for n, _ in others)
    assert all(abs(n / mean - 1) < 0.01 and abs(p / n - share) < 0.01 for n, p in others)


@pytest.mark.parametrize("k", [2, 5, 7])
def test_fold_dealing(spark, k):
    rng = random.Random(k)
    groups = [(i, n, rng.randint(0, n)) for i, n in enumerate(rng.choice([1, 1, 1, 2, 5, 400]) for _ in range(300))]
    df = spark.createDataFrame(groups, "group_id long, n long, pos long")
    assert {r.group_id: r.fold for r in FO.deal_folds(df, k).collect()} == brute_folds(groups, k)


def test_dealing_with_thousands_of_sizes_and_bounded_windows(spark, monkeypatch):
    groups = spark.range(20000).selectExpr("id AS group_id", "id * 7919 % 997 + 1 AS n").selectExpr(
        "*", "group_id * 104729 % (n + 1) AS pos").cache()
    taken = {}

    def spied(df, by, levels, order, measures):
        keys = list(by)
        for level in levels:
            names = [c for c, _ in level]
            widths = df.select(*keys, *names).distinct().groupBy(*keys).count().agg(F.max("count")).first()[0]
            taken[tuple(names)] = widths
            keys += names
        return prefix_sums(df, by, levels, order, measures)

    monkeypatch.setattr(FO, "prefix_sums", spied)
    folds = FO.deal_folds(groups, 5).groupBy("fold").agg(F.count("*").alias("m"), F.sum("n").alias("n")).collect()
    rows = groups.agg(F.sum("n")).first()[0]
    assert len(taken) == 3 and max(taken[("_tilt",)], taken[("n",)]) <= math.sqrt(2 * rows)
    assert max(f.m for f in folds) - min(f.m for f in folds) <= 4 and sum(f.n for f in folds) == rows


def test_more_folds_than_groups(spark):
    df = spark.createDataFrame([(1, 2, 1), (2, 3, 0)], "group_id long, n long, pos long")
    assert {r.fold for r in FO.deal_folds(df, 5).collect()} <= set(range(5))


def test_folds_do_not_depend_on_the_partitioning(spark):
    df = skewed(spark)
    one, many = (audit.tag_folds(V.vector_table(df.repartition(p), FEATURES)) for p in (1, 8))
    assert sorted(one.collect()) == sorted(many.collect())


@pytest.mark.parametrize("hot_rows", [5_000_000, 7])
def test_attach_keeps_every_row_with_and_without_salting(spark, hot_rows):
    df = skewed(spark)
    tagged = audit.tag_folds(V.vector_table(df, FEATURES))
    folds = {(r.a, r.b): r.fold for r in tagged.collect()}
    out = V.attach_by_group(V.with_group_id(df, FEATURES), audit.group_columns(tagged, ["fold"]), ["fold"],
                            hot_rows=hot_rows).collect()
    assert len(out) == 600 and len({r.row_index for r in out}) == 600
    assert all(r.fold == folds[(r.a, r.b)] for r in out)


def test_random_holdout_takes_the_smallest_draws_of_each_class(spark):
    df = skewed(spark, 501)
    rows = df.select("row_index", "is_phishing").collect()
    got = {r.row_index: r.split for r in FO.random_holdout(df).collect()}
    counts = {y: sum(r.is_phishing == y for r in rows) for y in (0, 1)}
    side = math.ceil(501 * 0.2)
    part = {y: n / 501 * side for y, n in counts.items()}
    quota = {y: math.floor(p) for y, p in part.items()}
    for y in sorted(part, key=lambda y: -(part[y] % 1))[:side - sum(quota.values())]:
        quota[y] += 1
    for y in (0, 1):
        drawn = sorted((hashlib.md5(f"42:{r.row_index}".encode()).hexdigest(), r.row_index)
                       for r in rows if r.is_phishing == y)
        assert {i for i, r in got.items() if r == "test"} & {i for _, i in drawn} == {i for _, i in drawn[:quota[y]]}


def test_published_class_quota(spark):
    df = spark.range(11055).select(F.col("id").alias("row_index"), (F.col("id") < 4898).cast("int").alias("is_phishing"))
    got = {(r.is_phishing, r.split): r["count"] for r in
           FO.random_holdout(df).groupBy("is_phishing", "split").count().collect()}
    assert (got[(1, "test")], got[(0, "test")]) == (980, 1231)


def test_profile_counts_label_in_duplicates(spark):
    df = table(spark, [(1, 1, 1), (1, 1, 1), (1, 1, 0), (0, 1, 0), (0, 1, 0), (0, 0, 1)])
    p = P.profile(V.vector_table(df, FEATURES)).first()
    assert (p.n_rows, p.exact_duplicate_rows, p.distinct_vectors, p.conflicting_label_vectors) == (6, 2, 3, 1)
    extra = P.duplicate_rows(df, FEATURES).agg(F.sum("duplicate_rows")).first()[0]
    assert extra == 2


def test_rate_of_a_value_that_other_folds_lack_is_their_overall_rate(spark):
    cells = [("a", 0, 0, 4, 1), ("a", 1, 0, 6, 6), ("a", 0, 1, 10, 2)]
    df = spark.createDataFrame(cells, "feature string, value byte, fold int, n long, pos long")
    got = {(r.value, r.fold): r.rate for r in C.out_of_fold_rates(df).collect()}
    assert got == {(0, 0): 0.2, (1, 0): 0.2, (0, 1): 0.25}


def test_held_out_rows_with_unseen_values_score_the_train_rate(spark):
    train = V.vector_table(table(spark, [(0, 1, 1), (0, 1, 0), (1, 1, 1), (1, 1, 1)]), FEATURES)
    test = V.vector_table(table(spark, [(7, 1, 0), (0, 1, 1)]), FEATURES)
    got = {r.a: r.score for r in C.held_out_score(test, C.contingency_cube(train, FEATURES, ()), FEATURES).collect()}
    assert got == {7: 0.75, 0: 0.625}


def test_single_feature_auc_against_pairs(spark):
    df = audit.stored_folds(skewed(spark), FEATURES, 3)
    rates = C.out_of_fold_rates(C.contingency_cube(df, FEATURES))
    table_ = {(r.feature, r.value, r.fold): r.rate for r in rates.collect()}
    rows = df.collect()
    for r in C.single_feature_auc(rates).collect():
        pairs = wins = 0.0
        scored = [(table_[(r.feature, v[r.feature], v.fold)], v.pos, v.n - v.pos) for v in rows]
        for sp, pos, _ in scored:
            for sn, _, neg in scored:
                pairs += pos * neg
                wins += pos * neg * (1.0 if sp > sn else 0.5 if sp == sn else 0.0)
        auc = wins / pairs
        assert r.single_feature_auc == pytest.approx(max(auc, 1 - auc), abs=1e-12)


def counts(spark, rows):
    df = spark.createDataFrame([("e", y, p) for y, p in rows], "evaluation string, is_phishing int, score double")
    return M.score_counts(df, ["evaluation"])


def test_metrics_with_ties_and_edge_scores(spark):
    rows = [(1, 0.5), (0, 0.5), (1, 1.0), (0, 0.0), (1, 0.0), (0, 0.3), (1, 0.3), (0, 0.9999999999)]
    m = M.compute_metrics(counts(spark, rows)).first()
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / 16
    assert m.roc_auc == pytest.approx(auc)
    ap = 0
    for cut in sorted({p for _, p in rows}, reverse=True):
        above = [y for y, p in rows if p >= cut]
        ap += sum(y for y, p in rows if p == cut) * sum(above) / len(above)
    assert m.pr_auc == pytest.approx(ap / 4)
    clip = [min(max(p, 1e-15), 1 - 1e-15) for _, p in rows]
    loss = -sum(math.log(p) if y else math.log(1 - p) for (y, _), p in zip(rows, clip)) / 8
    assert m.log_loss == pytest.approx(loss)
    assert m.brier_score == pytest.approx(sum((p - y) ** 2 for y, p in rows) / 8)
    assert (m.tp, m.fp, m.tn, m.fn) == (2, 2, 2, 2)


def test_single_class_evaluation(spark):
    m = M.compute_metrics(counts(spark, [(0, 0.2), (0, 0.7)])).first()
    assert m.roc_auc is None and m.false_negative_rate is None and m.npv == 1.0
    assert (m.precision, m.recall, m.f1, m.f2, m.mcc) == (0.0, 0.0, 0.0, 0.0, 0.0)
    assert (m.specificity, m.balanced_accuracy) == (0.5, 0.5)
    assert m.pr_auc == 0.0 and m.f1_macro == pytest.approx((0 + 2 / 3) / 2)


def test_macro_f1_averages_the_classes_that_occur(spark):
    for rows in ([(0, 0.2), (0, 0.3)], [(1, 0.7), (1, 0.9)]):
        assert M.compute_metrics(counts(spark, rows)).first().f1_macro == 1.0


def test_undefined_metric_is_displayed_as_nan(spark):
    summary = M.metrics_summary(M.compute_metrics(counts(spark, [(0, 0.2), (0, 0.7)])))
    shown = {r.metric: r.text for r in M.metrics_display(summary.where("evaluation = 'e'")).collect()}
    assert shown["roc_auc"] == "nan" and shown["accuracy"] == "0.5000"


def test_summary_order(spark):
    want = ["test_holdout", "train_cv_out_of_fold", "cv_fold_1", "cv_fold_2", "cv_fold_10", "cv_mean", "cv_std",
            *(f"reference: {n}" for n in rates.reference_names(30).values())]
    df = spark.createDataFrame([(n,) for n in sorted(want)], "evaluation string")
    assert [r.evaluation for r in df.orderBy(*M.summary_order()).collect()] == want


def test_ranking_agrees_with_a_sorted_scan_when_scores_crowd_one_bucket(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 1), rng.choice([0.25, 0.25 + rng.random() * 1e-7, rng.random()])) for _ in range(400)]
    m = M.ranking_metrics(counts(spark, rows)).first()
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    assert m.roc_auc == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))


def test_prediction_rows_at_the_threshold(spark):
    df = spark.createDataFrame([(9, 10, 1, 0.5), (2, 20, 0, 0.4999999), (8, 30, 0, 0.5), (1, 40, 1, 0.1)],
                               "row_index long, group_id long, is_phishing int, score double").coalesce(1)
    out = prediction_table(df, [], "test")
    assert out.columns == PREDICTION_COLUMNS
    rows = out.collect()
    assert [r.row_index for r in rows] == [9, 2, 8, 1]
    assert [r.predicted_label for r in rows] == [1, 0, 1, 0]
    assert [r.outcome for r in rows] == ["TP", "TN", "FP", "FN"]
    assert [r.correct for r in rows] == [True, True, False, False]
    assert [r.true_class for r in rows] == ["phishing", "legitimate", "legitimate", "phishing"]
    assert [r.prob_phishing for r in rows] == [0.5, 0.5, 0.5, 0.1]


def test_url_only_entry_replaces_a_documented_one(spark):
    entries = L.registry(spark, [("x", "c", "r"), ("y", "c", "r")], ["y", "z"])
    assert {r.feature: r.mode for r in L.drop_set(entries, False).collect()} == {"x": "default", "y": "default"}
    assert {r.feature: r.mode for r in L.drop_set(entries, True).collect()} == {
        "x": "default", "y": "url-only", "z": "url-only"}


def test_default_registry(spark):
    entries = L.registry(spark)
    assert (L.drop_set(entries, False).count(), L.drop_set(entries, True).count()) == (10, 22)


def test_balanced_class_weights(spark):
    got = {r.is_phishing: r.weight for r in class_weights(P.class_counts(
        table(spark, [(0, 0, 0)] * 3 + [(0, 0, 1)]))).collect()}
    assert got == {0: pytest.approx(4 / 6), 1: pytest.approx(2.0)}


def test_leaky_feature_lifts_the_scores(spark):
    from foldwright.sources.orders import FEATURES as ALL, KEPT, labelled
    got = {r.evaluation: r.roc_auc for r in rates.evaluate_rates(labelled(spark, SMALL), ALL, KEPT).collect()}
    names = rates.reference_names(len(ALL))
    assert got[f"reference: {names['all_group']}"] > got["test_holdout"]
    assert got[f"reference: {names['all_random']}"] > got[f"reference: {names['selected_random']}"]


def test_sketched_metrics_bound_the_exact_ones_on_skewed_scores(spark):
    rng = random.Random(4)
    rows = []
    for name, scale in (("skewed", 12), ("wide", 2), ("ties", 0)):
        for _ in range(3000):
            z = rng.gauss(-scale, 1 + scale / 4) if scale else rng.choice([-1.0, 0.0, 2.0])
            p = 1 / (1 + math.exp(-z))
            rows.append((name, 0.0 if rng.random() < 0.01 else p, *((1, 0) if rng.random() < min(0.9, 5 * p) else (0, 1))))
    rows += [("one class", 0.5, 0, 3), ("one class", 1.0, 0, 1)]
    df = spark.createDataFrame(rows, "evaluation string, score double, pos long, neg long")
    counts = df.groupBy("evaluation", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    exact = {r.evaluation: r for r in M.ranking_metrics(counts).collect()}
    halves = [sketches.score_sketch(df.where(f"xxhash64(score) % 2 {op} 0")) for op in ("=", "<>")]
    both = sketches.merged(halves[0].unionByName(halves[1]))
    assert sorted(both.collect()) == sorted(sketches.score_sketch(df).collect())
    for r in sketches.sketched_ranking(both).collect():
        want = exact[r.evaluation]
        if want.roc_auc is None:
            assert r.roc_auc is None and r.pr_auc_low == r.pr_auc_high == want.pr_auc == 0
            continue
        assert abs(r.roc_auc - want.roc_auc) <= r.roc_auc_error + 1e-12 and r.roc_auc_error < 0.25 * (r.evaluation == "ties") + 0.005
        assert r.pr_auc_low - 1e-12 <= want.pr_auc <= r.pr_auc_high + 1e-12
        assert r.pr_auc_high - r.pr_auc_low < 0.05 or r.evaluation == "ties"
    assert sketches.score_sketch(df.withColumn("score", F.rand(1))).groupBy("evaluation").count().agg(F.max("count")).first()[0] < 6908


def test_distinct_sketches_of_parts_merge_to_that_of_the_whole(spark):
    df = spark.range(60_000).selectExpr("cast(id % 20011 as int) AS a", "cast(id % 20011 % 7 as int) AS b", "id % 2 AS half")
    parts = sketches.distinct_sketch(df, ["a", "b"], ["half"])
    merged = sketches.distinct_vectors(parts).first().distinct_vectors
    whole = sketches.distinct_vectors(sketches.distinct_sketch(df, ["a", "b"])).first().distinct_vectors
    bound = 4 * 1.04 / 2 ** (sketches.LG / 2) * 20011
    assert abs(merged - 20011) < bound and abs(whole - 20011) < bound
    copies = df.unionByName(df)
    assert sketches.distinct_vectors(sketches.distinct_sketch(copies, ["a", "b"])).first().distinct_vectors == whole


def test_saved_rates_score_as_the_fitted_ones(spark):
    df = skewed(spark)
    folded = audit.tag_folds(V.vector_table(df, FEATURES))
    model = TargetRates(features=FEATURES).fit(folded)
    path = scratch_path(spark, "rates")
    model.save(path)
    again = TargetRatesModel.load(path)
    assert again.getFeatures() == FEATURES
    assert sorted(again.out_of_fold(folded).collect()) == sorted(model.out_of_fold(folded).collect())
    want = C.held_out_score(df, C.contingency_cube(folded, FEATURES, tags=()), FEATURES)
    assert sorted(again.transform(df).collect()) == sorted(want.collect())
