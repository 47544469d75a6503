"""The registered queries once more as plain SQL over whole tables, for comparison in DuckDB."""

from __future__ import annotations

from foldwright.constants import LABEL, METRIC_COLUMNS, METRIC_LABELS, SEED
from foldwright.plans.rates import reference_names
from foldwright.sources.orders import FEATURES, KEPT, LEAKY, PAGE

CAST = {c: "BIGINT" for c in ("n_samples", "n_phishing", "n_legitimate", "tp", "fp", "tn", "fn")}


def r(expr: str, digits: int = 6) -> str:
    return f"(round_even(({expr}) * 1e{digits}, 0) / 1e{digits})"


def _three(c, low, high):
    return f"CASE WHEN {c} <= {low} THEN -1 WHEN {c} <= {high} THEN 0 ELSE 1 END"


def _names(features=FEATURES):
    return ", ".join(features)


RULES = {
    "f_lines": _three("coalesce(n, 0)", 3, 4),
    "f_maxprice": _three("coalesce(price, 0)", 80000, 93000),
    "f_maxqty": _three("coalesce(quantity, 0)", 39, 46),
    "f_status": "CASE o_orderstatus WHEN 'F' THEN -1 WHEN 'O' THEN 0 ELSE 1 END",
    "f_anyret": "CASE WHEN returned THEN -1 ELSE 1 END",
    "f_anyf": "CASE WHEN finished THEN -1 ELSE 1 END",
    "f_prio": "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN -1 "
              "WHEN o_orderpriority = '3-MEDIUM' THEN 0 ELSE 1 END",
    "f_gross": _three("coalesce(gross, 0)", 190000, 230000),
}

TERNARY = f"""
lines AS (
  SELECT l_orderkey, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
         round(sum(l_extendedprice), 2) AS gross, max(l_extendedprice) AS price, max(l_quantity) AS quantity,
         bool_or(l_returnflag = 'R') AS returned, bool_or(l_linestatus = 'F') AS finished
  FROM lineitem GROUP BY l_orderkey),
ternary AS (
  SELECT o_orderkey AS row_index, {", ".join(f"CAST({e} AS TINYINT) AS {f}" for f, e in RULES.items())},
         CAST(CASE WHEN coalesce(revenue, 0) > 200000 THEN -1 ELSE 1 END AS TINYINT) AS "Result"
  FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey),
labelled AS (
  SELECT row_index, {_names()}, CASE WHEN "Result" = -1 THEN 1 ELSE 0 END AS is_phishing,
         CAST('0x' || substr(md5(concat_ws(',', {_names()})), 1, 12) AS BIGINT) AS group_id
  FROM ternary)"""


def groups(name: str, source: str) -> str:
    return f"""
{name} AS (
  SELECT group_id, count(*) AS n, CAST(sum(is_phishing) AS BIGINT) AS pos FROM {source} GROUP BY group_id)"""


def deal(name: str, source: str, k: int = 5) -> str:
    """Fold of every group: heavy groups to the least loaded folds, the others by tilt, size and draw rank within the
    side, dealt back and forth, or behind heavy groups in proportion to what is left of the folds."""
    zeros = ", ".join(["CAST(0 AS BIGINT)"] * k)
    return f"""
{name}_rows AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS total FROM {source}),
{name}_heavy AS (
  SELECT group_id, CAST(n AS BIGINT) AS n, row_number() OVER (ORDER BY n DESC, md5('{SEED}:' || group_id), group_id) AS turn
  FROM {source} WHERE n * {4 * k} > (SELECT total FROM {name}_rows)),
{name}_greedy AS (
  SELECT CAST(0 AS BIGINT) AS turn, CAST(NULL AS BIGINT) AS group_id, CAST(NULL AS INTEGER) AS fold, [{zeros}] AS loads
  UNION ALL
  SELECT h.turn, h.group_id, CAST(list_position(g.loads, list_min(g.loads)) - 1 AS INTEGER),
         list_transform(g.loads, lambda x, i: CASE WHEN i = list_position(g.loads, list_min(g.loads)) THEN x + h.n ELSE x END)
  FROM {name}_greedy g JOIN {name}_heavy h ON h.turn = g.turn + 1),
{name}_level AS (
  SELECT loads, list_min([(total - list_sum(loads) + list_sum(list_sort(loads)[1:m])) // m FOR m IN range(1, {k + 1})]) AS level
  FROM (SELECT loads FROM {name}_greedy ORDER BY turn DESC LIMIT 1), {name}_rows),
{name}_room AS (
  SELECT CASE WHEN list_sum(room) > 0 THEN room ELSE [1 FOR x IN room] END AS room
  FROM (SELECT [greatest(0, level - x) FOR x IN loads] AS room FROM {name}_level)),
{name}_bounds AS (
  SELECT [CAST(list_sum(room[1:m]) * {1 << 20} // list_sum(room) AS BIGINT) FOR m IN range(1, {k + 1})] AS bounds FROM {name}_room),
{name}_ranked AS (
  SELECT *, row_number() OVER (
          PARTITION BY sign(2 * pos - n)
          ORDER BY abs(2 * pos - n) DESC, n DESC, md5('{SEED}:' || group_id), group_id) - 1 AS rk
  FROM {source} WHERE group_id NOT IN (SELECT group_id FROM {name}_heavy)),
{name} AS (
  SELECT group_id, n, pos, CAST(CASE WHEN EXISTS (SELECT 1 FROM {name}_heavy)
           THEN (SELECT len([b FOR b IN bounds IF b <= (((rk % {1 << 31}) * {2654435769}) % {1 << 32}) >> 12]) FROM {name}_bounds)
           WHEN (rk // {k}) % 2 = 0 THEN rk % {k} ELSE {k - 1} - rk % {k} END AS INTEGER) AS fold
  FROM {name}_ranked
  UNION ALL
  SELECT s.group_id, s.n, s.pos, g.fold FROM {source} s JOIN {name}_greedy g ON g.group_id = s.group_id)"""


def cube(name: str, source: str, tags: str = "fold", features=FEATURES) -> str:
    tag = f"{tags}, " if tags else ""
    each = " UNION ALL ".join(
        f"SELECT {tag}'{f}' AS feature, {f} AS value, is_phishing FROM {source}" for f in features)
    return f"""
{name} AS (
  SELECT feature, value, {tag}count(*) AS n, CAST(sum(is_phishing) AS BIGINT) AS pos
  FROM ({each}) GROUP BY ALL)"""


def oof_rates(name: str, source: str) -> str:
    """Rate of a value over the rows of all other folds, else the overall rate of the other folds."""
    return f"""
{name} AS (
  SELECT c.feature, c.value, c.fold, c.n, c.pos,
         coalesce((SELECT CAST(sum(o.pos) AS DOUBLE) / sum(o.n) FROM {source} o
                   WHERE o.feature = c.feature AND o.value = c.value AND o.fold <> c.fold),
                  (SELECT CAST(sum(o.pos) AS DOUBLE) / sum(o.n) FROM {source} o
                   WHERE o.feature = c.feature AND o.fold <> c.fold)) AS rate
  FROM {source} c)"""


def auc_of_rates(name: str, source: str) -> str:
    return f"""
{name} AS (
  SELECT feature, greatest(auc, 1 - auc) AS single_feature_auc
  FROM (SELECT feature, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auc
        FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY feature ORDER BY rate
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
              FROM (SELECT feature, rate, CAST(sum(pos) AS DOUBLE) AS pos, CAST(sum(n - pos) AS DOUBLE) AS neg
                    FROM {source} GROUP BY feature, rate))
        GROUP BY feature))"""


def mutual_info(name: str, source: str) -> str:
    """Sum over value and class of p(xy) ln(p(xy) / (p(x) p(y)))."""
    return f"""
{name} AS (
  SELECT feature, greatest(sum(CASE WHEN nxy = 0 THEN 0
           ELSE nxy / total * ln(nxy * total / (nx * ny)) END), 0) AS mutual_info
  FROM (SELECT feature, nxy, nx, total, sum(nxy) OVER (PARTITION BY feature, y) AS ny
        FROM (SELECT feature, value, y, CAST(CASE WHEN y = 1 THEN pos ELSE n - pos END AS DOUBLE) AS nxy,
                     CAST(n AS DOUBLE) AS nx, CAST(sum(n) OVER (PARTITION BY feature, y) AS DOUBLE) AS total
              FROM (SELECT feature, value, sum(n) AS n, sum(pos) AS pos FROM {source} GROUP BY feature, value)
              CROSS JOIN (VALUES (0), (1)) AS c(y)))
  GROUP BY feature)"""


def rate_maps(source: str, features) -> str:
    """One correlated rate per feature of a row, looked up by value and fold."""
    joins = " ".join(f"JOIN {source} r_{f} ON r_{f}.feature = '{f}' AND r_{f}.value = t.{f} AND r_{f}.fold = t.fold"
                     for f in features)
    return joins


def mean_rate(features) -> str:
    return r("(" + " + ".join(f"r_{f}.rate" for f in features) + f") / {float(len(features))}", 9)


def oof_score(name: str, table: str, rates: str, features, extra: str = "") -> str:
    return f"""
{name} AS (SELECT t.*{extra}, {mean_rate(features)} AS score FROM {table} t {rate_maps(rates, features)})"""


def held_out(name: str, table: str, features, evaluation: str, columns: str = "is_phishing") -> str:
    """Score test rows by the rates of the train rows; unseen values get the train rate."""
    rates = " ".join(
        f"LEFT JOIN (SELECT {f} AS v, avg(is_phishing) AS rate FROM {table} WHERE split = 'train' GROUP BY {f}) "
        f"h_{f} ON h_{f}.v = t.{f}" for f in features)
    score = " + ".join(f"coalesce(h_{f}.rate, a.rate)" for f in features)
    return f"""
{name} AS (
  SELECT '{evaluation}' AS evaluation, {columns}, {r(f"({score}) / {float(len(features))}", 9)} AS score
  FROM {table} t {rates}, (SELECT avg(is_phishing) AS rate FROM {table} WHERE split = 'train') a
  WHERE split = 'test')"""


def counts(name: str, source: str, by: str = "evaluation") -> str:
    return f"""
{name} AS (
  SELECT {by}, score, CAST(sum(is_phishing) AS DOUBLE) AS pos, CAST(sum(1 - is_phishing) AS DOUBLE) AS neg
  FROM {source} GROUP BY {by}, score)"""


def ranking(name: str, source: str, by: str = "evaluation") -> str:
    return f"""
{name} AS (
  SELECT {by}, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS roc_auc,
         CASE WHEN sum(pos) > 0 THEN sum(pos * hits / seen) / sum(pos) ELSE 0 END AS pr_auc
  FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {by} ORDER BY score
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
               sum(pos) OVER (PARTITION BY {by} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS hits,
               sum(pos + neg) OVER (PARTITION BY {by} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS seen
        FROM {source})
  GROUP BY {by})"""


def cells(name: str, source: str) -> str:
    return f"""
{name} AS (
  SELECT evaluation, sum(CASE WHEN is_phishing = 0 AND score < 0.5 THEN 1.0::DOUBLE ELSE 0 END) AS tn,
         sum(CASE WHEN is_phishing = 0 AND score >= 0.5 THEN 1.0::DOUBLE ELSE 0 END) AS fp,
         sum(CASE WHEN is_phishing = 1 AND score < 0.5 THEN 1.0::DOUBLE ELSE 0 END) AS fn,
         sum(CASE WHEN is_phishing = 1 AND score >= 0.5 THEN 1.0::DOUBLE ELSE 0 END) AS tp
  FROM {source} GROUP BY evaluation)"""


def losses(name: str, source: str) -> str:
    p = "greatest(least(score, 1 - 1e-15), 1e-15)"
    return f"""
{name} AS (
  SELECT evaluation, -avg(CASE WHEN is_phishing = 1 THEN ln({p}) ELSE ln(1 - {p}) END) AS log_loss,
         avg((score - is_phishing) * (score - is_phishing)) AS brier_score
  FROM {source} GROUP BY evaluation)"""


def _div(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


def _zero(a: str, b: str) -> str:
    return f"coalesce({_div(a, b)}, 0)"


def threshold_values() -> dict[str, str]:
    recall, spec = _zero("tp", "tp + fn"), _div("tn", "tn + fp")
    f1, f0 = _zero("2 * tp", "2 * tp + fp + fn"), _zero("2 * tn", "2 * tn + fn + fp")
    total = "(tp + fp + tn + fn)"
    chance = f"((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / ({total} * {total})"
    return {
        "accuracy": f"(tp + tn) / {total}",
        "balanced_accuracy": f"CASE WHEN tp + fn = 0 THEN {spec} WHEN tn + fp = 0 THEN {recall} "
                             f"ELSE ({recall} + {spec}) / 2 END",
        "precision": _zero("tp", "tp + fp"),
        "recall": recall,
        "specificity": spec,
        "npv": _div("tn", "tn + fn"),
        "f1": f1,
        "f1_macro": "list_avg([2 * tp / nullif(2 * tp + fp + fn, 0), 2 * tn / nullif(2 * tn + fn + fp, 0)])",
        "f1_weighted": f"({f1} * (tp + fn) + {f0} * (tn + fp)) / {total}",
        "f2": _zero("5 * tp", "5 * tp + 4 * fn + fp"),
        "false_positive_rate": _div("fp", "fp + tn"),
        "false_negative_rate": _div("fn", "fn + tp"),
        "mcc": _zero("tp * tn - fp * fn", "sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))"),
        "cohen_kappa": _div(f"(tp + tn) / {total} - {chance}", f"1 - {chance}"),
    }


def metrics(name: str, scored: str) -> str:
    """All 26 scalars per evaluation, unrounded."""
    values = ", ".join(f"{e} AS {m}" for m, e in threshold_values().items())
    return ",".join([
        counts(f"{name}_counts", scored), ranking(f"{name}_rank", f"{name}_counts"),
        cells(f"{name}_cells", scored), losses(f"{name}_loss", scored)]) + f""",
{name} AS (
  SELECT evaluation, tp + fp + tn + fn AS n_samples, tp + fn AS n_phishing, tn + fp AS n_legitimate,
         0.5::DOUBLE AS threshold, {values}, roc_auc, pr_auc, log_loss, brier_score, tp, fp, tn, fn
  FROM {name}_cells JOIN {name}_rank USING (evaluation) JOIN {name}_loss USING (evaluation))"""


def summary(name: str, source: str) -> str:
    def stat(tag, f):
        return (f"SELECT '{tag}' AS evaluation, " + ", ".join(f"{f}({m}) AS {m}" for m in METRIC_COLUMNS)
                + f" FROM {source} WHERE starts_with(evaluation, 'cv_fold_')")
    return f"""
{name} AS (
  SELECT evaluation, {", ".join(METRIC_COLUMNS)} FROM {source}
  UNION ALL {stat("cv_mean", "avg")} UNION ALL {stat("cv_std", "stddev_samp")})"""


REGISTRY = "registry(feature, category, reason, mode) AS (VALUES " + ", ".join(
    [f"('{f}', '{c}', '{w}', 'default')" for f, c, w in LEAKY]
    + [f"('{f}', 'page/host content (url-only mode)', 'Requires fetching the page or probing the host; "
       f"not computable from the URL string.', 'url-only')" for f in PAGE]) + ")"

GROUPS = groups("groups", "labelled")
FOLDS = deal("folds", "groups")
FOLDED = "folded AS (SELECT l.*, f.fold FROM labelled l JOIN folds f USING (group_id))"
HELD = ("held AS (SELECT l.*, CASE WHEN f.fold = 0 THEN 'test' ELSE 'train' END AS split "
        "FROM labelled l JOIN folds f USING (group_id))")
TRAIN = ",".join([
    "train_rows AS (SELECT * FROM held WHERE split = 'train')", groups("train_groups", "train_rows"),
    deal("train_dealt", "train_groups"),
    "train_folded AS (SELECT l.*, f.fold FROM train_rows l JOIN train_dealt f USING (group_id))"])
# Per class the floor of its part of the test side, then one more for the largest remainder.
RANDOM = """
quota AS (
  SELECT is_phishing, floor(part) + CASE WHEN row_number() OVER (ORDER BY part - floor(part) DESC, is_phishing DESC)
                                              <= side - sum(floor(part)) OVER () THEN 1 ELSE 0 END AS quota
  FROM (SELECT is_phishing, side, n::DOUBLE / total * side AS part
        FROM (SELECT is_phishing, n, sum(n) OVER () AS total, ceil(sum(n) OVER () * 0.2::DOUBLE) AS side
              FROM (SELECT is_phishing, count(*) AS n FROM labelled GROUP BY is_phishing)))),
loose AS (
  SELECT l.* EXCLUDE (place), CASE WHEN place <= quota THEN 'test' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY is_phishing
               ORDER BY md5('42:' || row_index), row_index) AS place FROM labelled) l
  JOIN quota USING (is_phishing))"""

BASE = [TERNARY, GROUPS, FOLDS]
CUBED = [*BASE, FOLDED, cube("cells", "folded")]
RATED = [*CUBED, oof_rates("rates", "cells")]
DIAG = [*RATED, auc_of_rates("aucs", "rates"), mutual_info("mi", "cells"), REGISTRY, """
diag AS (
  SELECT feature, single_feature_auc, mutual_info,
         feature IN (SELECT feature FROM registry WHERE mode = 'default') AS documented_leaky,
         single_feature_auc >= 0.85 AS suspicious
  FROM aucs JOIN mi USING (feature))"""]
SCORED = [*RATED, oof_score("scored", "folded", "rates", KEPT),
          """evaluations AS (
  SELECT 'train_cv_out_of_fold' AS evaluation, is_phishing, score FROM scored
  UNION ALL SELECT 'cv_fold_' || (fold + 1), is_phishing, score FROM scored)"""]
MEASURED = [*SCORED, metrics("m", "evaluations")]

_REF = reference_names(len(FEATURES))
ALL_EVALUATIONS = [
    *BASE, HELD, TRAIN, RANDOM, cube("train_cells", "train_folded", features=KEPT),
    oof_rates("train_rates", "train_cells"), oof_score("oof", "train_folded", "train_rates", KEPT),
    held_out("e_test", "held", KEPT, "test_holdout"),
    held_out("e_all_random", "loose", FEATURES, f"reference: {_REF['all_random']}"),
    held_out("e_all_group", "held", FEATURES, f"reference: {_REF['all_group']}"),
    held_out("e_sel_random", "loose", KEPT, f"reference: {_REF['selected_random']}"),
    """evaluations AS (
  SELECT * FROM e_test UNION ALL SELECT 'train_cv_out_of_fold', is_phishing, score FROM oof
  UNION ALL SELECT 'cv_fold_' || (fold + 1), is_phishing, score FROM oof
  UNION ALL SELECT * FROM e_all_random UNION ALL SELECT * FROM e_all_group UNION ALL SELECT * FROM e_sel_random)""",
    metrics("m", "evaluations"), summary("s", "m")]

# Recursive elimination on the train rows with the mean-rate score.
SELECTION = [
    *BASE, HELD, TRAIN, cube("train_cells", "train_folded", features=KEPT), oof_rates("rates", "train_cells"),
    f"""
importance AS (
  SELECT feature, avg(part) AS initial_mean_abs_shap
  FROM (SELECT feature, fold, sum(abs(rate - centre) * n) / sum(n) / {float(len(KEPT))} AS part
        FROM (SELECT *, sum(rate * n) OVER (PARTITION BY feature, fold) / sum(n) OVER (PARTITION BY feature, fold)
                     AS centre FROM rates)
        GROUP BY feature, fold) GROUP BY feature),
steps AS (
  SELECT feature, initial_mean_abs_shap, row_number() OVER (ORDER BY {r("initial_mean_abs_shap", 9)},
         list_position({KEPT}, feature)) AS elim_step FROM importance),
long_rates AS (
  SELECT t.row_index, t.is_phishing, t.fold, s.elim_step, c.rate
  FROM (UNPIVOT train_folded ON {_names(KEPT)} INTO NAME feature VALUE value) t
  JOIN rates c ON c.feature = t.feature AND c.value = t.value AND c.fold = t.fold
  JOIN steps s ON s.feature = t.feature),
row_rates AS (
  SELECT is_phishing, fold, list(rate ORDER BY elim_step DESC) AS rates
  FROM long_rates GROUP BY row_index, is_phishing, fold),
nested AS (
  SELECT k.k AS n_features, fold, is_phishing,
         {r("list_reduce(list_prepend(0.0::DOUBLE, rates[1:k.k]), lambda a, b: a + b) / k.k", 9)} AS score
  FROM row_rates CROSS JOIN (SELECT unnest(range(1, {len(KEPT) + 1}))::INTEGER AS k) k)""",
    counts("c", "nested", "n_features, fold"), ranking("fold_aucs", "c", "n_features, fold"), """
curve AS (
  SELECT n_features, avg(roc_auc) AS auc_mean, stddev_samp(roc_auc) / sqrt(count(*)) AS auc_se
  FROM fold_aucs GROUP BY n_features),
best AS (SELECT *, auc_mean - auc_se AS threshold FROM curve ORDER BY auc_mean DESC, n_features DESC LIMIT 1),
choice AS (
  SELECT b.n_features AS best_n_features, b.auc_mean AS best_cv_auc, b.threshold,
         c.n_features AS chosen_n_features, c.auc_mean AS chosen_cv_auc
  FROM best b JOIN curve c ON c.auc_mean >= b.threshold ORDER BY c.n_features LIMIT 1)""",
    mutual_info("mi", "train_cells")]


def _with(blocks: list[str], select: str) -> str:
    return "WITH RECURSIVE " + ",".join(blocks) + "\n" + select


def _drops(condition: str) -> str:
    return f"(SELECT feature FROM registry WHERE {condition})"


def _record(columns=METRIC_COLUMNS) -> str:
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" if c in CAST else f"{r(c)} AS {c}" for c in columns)


def _rounded(columns) -> str:
    return ", ".join(f"{r(c)} AS {c}" for c in columns)


def _overlap(view: str, key: str) -> str:
    return f"""SELECT '{view}' AS view, count(*) AS n_keys,
  CAST(sum(CASE WHEN sides = 2 THEN 1 ELSE 0 END) AS BIGINT) AS shared_keys,
  CAST(sum(CASE WHEN sides = 2 THEN n ELSE 0 END) AS BIGINT) AS shared_rows
FROM (SELECT count(DISTINCT split) AS sides, count(*) AS n FROM held GROUP BY {key})"""


def _report(position: int, name: str, values) -> str:
    cols = ", ".join(f"{r(v) if v else 'CAST(NULL AS DOUBLE)'} AS {c}"
                     for c, v in zip(("precision", "recall", "f1"), values[:3]))
    return (f"SELECT evaluation, {position} AS position, '{name}' AS class, {cols}, "
            f"CAST({values[3]} AS BIGINT) AS support FROM c")


def _class_report() -> str:
    legit = (_zero("tn", "tn + fn"), _zero("tn", "tn + fp"), _zero("2 * tn", "2 * tn + fn + fp"), "tn + fp")
    phish = (_zero("tp", "tp + fp"), _zero("tp", "tp + fn"), _zero("2 * tp", "2 * tp + fn + fp"), "tp + fn")
    n = "(tp + tn + fp + fn)"
    macro = [f"({a} + {b}) / 2" for a, b in zip(legit[:3], phish[:3])]
    weighted = [f"({a} * ({legit[3]}) + {b} * ({phish[3]})) / {n}" for a, b in zip(legit[:3], phish[:3])]
    return " UNION ALL ".join([
        _report(0, "legitimate", legit), _report(1, "phishing", phish),
        _report(2, "accuracy", (None, None, f"(tp + tn) / {n}", n)),
        _report(3, "macro avg", (*macro, n)), _report(4, "weighted avg", (*weighted, n))])


def _predictions(source: str, split: str, extra: str = "") -> str:
    return f"""SELECT row_index, group_id, {split} AS split,
  is_phishing AS true_label, CASE WHEN is_phishing = 1 THEN 'phishing' ELSE 'legitimate' END AS true_class,
  CAST(score >= 0.5 AS INTEGER) AS predicted_label,
  CASE WHEN score >= 0.5 THEN 'phishing' ELSE 'legitimate' END AS predicted_class,
  {r('score')} AS prob_phishing, {r('1 - score')} AS prob_legitimate, (score >= 0.5) = (is_phishing = 1) AS correct,
  CASE WHEN is_phishing = 1 THEN CASE WHEN score >= 0.5 THEN 'TP' ELSE 'FN' END
       ELSE CASE WHEN score >= 0.5 THEN 'FP' ELSE 'TN' END END AS outcome,
  {extra}{_names(KEPT)} FROM {source}"""


def _leakage_entries() -> str:
    def part(section, name, position="NULL", text="NULL", value="NULL", source=""):
        return (f"SELECT '{section}' AS section, {name} AS name, CAST({position} AS INTEGER) AS position, CAST({text} AS VARCHAR) AS text, "
                f"CAST({value} AS DOUBLE) AS value{source}")

    counts = {"n_rows": "(SELECT count(*) FROM labelled)",
              "exact_duplicate_rows": f"(SELECT sum(c - 1) FROM (SELECT count(*) AS c FROM labelled GROUP BY {_names()}, is_phishing))",
              "conflicting_label_vectors": "(SELECT count(*) FROM groups WHERE pos > 0 AND pos < n)"}
    parts = [part("profile", f"'{n}'", value=v) for n, v in counts.items()]
    parts.append(part("removed", "feature", text="category || ': ' || reason", source=" FROM registry WHERE mode = 'default'"))
    parts += [part("kept", f"'{f}'", str(k)) for k, f in enumerate(KEPT)]
    place = "row_number() OVER (ORDER BY single_feature_auc DESC, feature) - 1"
    flags = "documented_leaky || '/' || suspicious"
    parts += [part(m, "feature", place, flags, r(m), " FROM diag") for m in ("single_feature_auc", "mutual_info")]
    return " UNION ALL ".join(parts)


def _selection_entries() -> str:
    def part(section, name, position, value, source):
        return (f"SELECT '{section}' AS section, {name} AS name, CAST({position} AS INTEGER) AS position, "
                f"CAST({value} AS DOUBLE) AS value FROM {source}")

    chosen = f"SELECT *, {len(KEPT) + 1} - elim_step <= chosen_n_features AS chosen, list_position({KEPT}, feature) AS place FROM steps, choice"
    parts = [part(f"{s}_features", "feature", "row_number() OVER (ORDER BY place) - 1", "NULL", f"({chosen}) WHERE {'' if s == 'selected' else 'NOT '}chosen")
             for s in ("selected", "dropped")]
    parts += [part(s, "'cv_auc'", f"{s}_n_features", r(f"{s}_cv_auc"), "choice") for s in ("best", "chosen")]
    parts += [part(m, "feature", f"{len(KEPT) + 1} - elim_step", r(m), "steps JOIN mi USING (feature)") for m in ("initial_mean_abs_shap", "mutual_info")]
    parts += [part(m, "CAST(row_number() OVER (ORDER BY n_features DESC) - 1 AS VARCHAR)", "n_features", r(m), "curve") for m in ("auc_mean", "auc_se")]
    return " UNION ALL ".join(parts)


def _sketched(width: str = "0.01::DOUBLE") -> str:
    ahead = "PARTITION BY evaluation ORDER BY bucket DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

    def least(place):
        return f"coalesce((p + {place}) / nullif(p + {place} + q + neg, 0), 0)"

    return f"""SELECT evaluation, {r("sum(neg * (p + pos / 2)) / (sum(pos) * sum(neg))")} AS roc_auc,
  {r("sum(pos * neg) / 2 / (sum(pos) * sum(neg))")} AS roc_auc_error,
  {r(f"sum(CASE WHEN pos > 0 THEN pos * ({least('1.0::DOUBLE')} + {least('pos')}) / 2 ELSE 0 END) / sum(pos)")} AS pr_auc_low,
  {r("sum(coalesce(pos * (p + pos) / nullif(p + pos + q, 0), 0)) / sum(pos)")} AS pr_auc_high
FROM (SELECT *, coalesce(sum(pos) OVER ({ahead}), 0::DOUBLE) AS p, coalesce(sum(neg) OVER ({ahead}), 0::DOUBLE) AS q
      FROM (SELECT evaluation, CAST(floor(ln(s / (1 - s)) / {width}) AS INTEGER) AS bucket, sum(is_phishing)::DOUBLE AS pos,
                   sum(1 - is_phishing)::DOUBLE AS neg
            FROM (SELECT evaluation, is_phishing, greatest(least(score, 1 - 1e-15::DOUBLE), 1e-15::DOUBLE) AS s FROM evaluations) GROUP BY ALL))
GROUP BY evaluation"""


def statements() -> dict[str, str]:
    diag_columns = f"feature, {r('single_feature_auc')} AS single_feature_auc, {r('mutual_info')} AS mutual_info"
    default, any_mode = _drops("mode = 'default'"), _drops("true")
    labels = ", ".join(f"('{m}', '{t.replace(chr(39), chr(39) * 2)}')" for m, t in METRIC_LABELS.items())
    values = ", ".join(METRIC_LABELS)
    found = {
        "ternary_features": _with([TERNARY], "SELECT * FROM ternary"),
        "label_encode": _with([TERNARY], 'SELECT row_index, "Result", '
                              'CASE WHEN "Result" = -1 THEN 1 ELSE 0 END AS is_phishing FROM ternary'),
        "group_id": _with([TERNARY], "SELECT row_index, group_id FROM labelled"),
        "dup_stats": _with([TERNARY, GROUPS], f"""SELECT
  (SELECT count(*) FROM labelled) AS n_rows,
  (SELECT CAST(sum(is_phishing) AS BIGINT) FROM labelled) AS n_phishing,
  (SELECT CAST(sum(1 - is_phishing) AS BIGINT) FROM labelled) AS n_legitimate,
  (SELECT CAST(sum(c - 1) AS BIGINT) FROM (SELECT count(*) AS c FROM labelled GROUP BY {_names()}, is_phishing))
    AS exact_duplicate_rows,
  (SELECT count(*) FROM groups) AS distinct_vectors,
  (SELECT count(*) FROM groups WHERE pos > 0 AND pos < n) AS conflicting_label_vectors"""),
        "duplicate_rows": _with([TERNARY], f"""SELECT {_names()}, is_phishing, count(*) AS copies,
  count(*) - 1 AS duplicate_rows FROM labelled GROUP BY {_names()}, is_phishing HAVING count(*) > 1"""),
        "conflict_vectors": _with([TERNARY, GROUPS],
                                  "SELECT group_id, n, pos FROM groups WHERE pos > 0 AND pos < n"),
        "class_counts": _with([TERNARY], "SELECT is_phishing, count(*) AS n FROM labelled GROUP BY is_phishing"),
        "class_weights": _with([TERNARY], f"""SELECT is_phishing, n, {r("t / (2.0 * n)")} AS weight
FROM (SELECT is_phishing, count(*) AS n, CAST(sum(count(*)) OVER () AS DOUBLE) AS t
      FROM labelled GROUP BY is_phishing)"""),
        "group_folds": _with(BASE, "SELECT group_id, n, pos, fold FROM folds"),
        "row_folds": _with([*BASE, FOLDED], "SELECT row_index, group_id, is_phishing, fold FROM folded"),
        "fold_balance": _with(BASE, f"""SELECT fold, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows,
  CAST(sum(pos) AS BIGINT) AS n_phishing, {r("sum(pos)::DOUBLE / sum(n)")} AS phishing_rate
FROM folds GROUP BY fold"""),
        "group_holdout": _with(BASE, """SELECT group_id, n, pos,
  CASE WHEN fold = 0 THEN 'test' ELSE 'train' END AS split FROM folds"""),
        "split_audit": _with([*BASE, HELD], """SELECT split, count(DISTINCT group_id) AS n_groups,
  count(*) AS n_rows, CAST(sum(is_phishing) AS BIGINT) AS n_phishing FROM held GROUP BY split"""),
        "group_overlap": _with([*BASE, HELD], _overlap("full vector", _names()) + " UNION ALL "
                               + _overlap("kept features", _names(KEPT))),
        "stratified_random_split": _with([TERNARY, RANDOM], "SELECT row_index, is_phishing, split FROM loose"),
        "contingency_cube": _with(CUBED, "SELECT feature, value, fold, n, pos FROM cells"),
        "mutual_information": _with([*CUBED, mutual_info("mi", "cells")],
                                    f"SELECT feature, {r('mutual_info')} AS mutual_info FROM mi"),
        "oof_target_rate": _with(RATED, f"SELECT feature, value, fold, n, pos, {r('rate')} AS rate FROM rates"),
        "single_feature_auc": _with([*RATED, auc_of_rates("aucs", "rates")],
                                    f"SELECT feature, {r('single_feature_auc')} AS single_feature_auc FROM aucs"),
        "leakage_diagnostics": _with(DIAG, f"SELECT {diag_columns}, documented_leaky, suspicious FROM diag"),
        "removed_features": _with(DIAG, f"""SELECT {diag_columns.replace('feature,', 'feature, category, reason,', 1)}
FROM diag JOIN registry USING (feature) WHERE mode = 'default'"""),
        "removed_features_url_only": _with(DIAG, f"""SELECT
  {diag_columns.replace('feature,', 'feature, category, reason,', 1)} FROM diag JOIN registry USING (feature)"""),
        "kept_features": _with(DIAG, f"""SELECT CAST(list_position({FEATURES}, feature) - 1 AS INTEGER) AS position,
  {diag_columns} FROM diag WHERE feature NOT IN {default}"""),
        "kept_features_url_only": _with(DIAG, f"""SELECT
  CAST(list_position({FEATURES}, feature) - 1 AS INTEGER) AS position, {diag_columns}
FROM diag WHERE feature NOT IN {any_mode}"""),
        "flagged_kept": _with(DIAG, f"SELECT {diag_columns} FROM diag WHERE suspicious AND feature NOT IN {default}"),
        "clean_dataset": _with([*BASE, HELD],
                               f"SELECT row_index, {_names(KEPT)}, {LABEL}, group_id, split FROM held"),
        "oof_score": _with(SCORED, "SELECT row_index, group_id, is_phishing, fold, score FROM scored"),
        "clean_dataset_url_only": _with([*BASE, HELD], "SELECT row_index, "
                                        + _names([f for f in KEPT if f not in PAGE])
                                        + f", {LABEL}, group_id, split FROM held"),
        "prediction_table": _with(SCORED, _predictions("scored", "'train_oof'", "fold + 1 AS cv_fold, ")),
        "test_prediction_table": _with([*BASE, HELD, held_out("scored", "held", KEPT, "test_holdout", "t.*")],
                                       _predictions("scored", "split")),
        "confusion_matrix": _with([*SCORED, cells("c", "evaluations")], f"SELECT evaluation, "
                                  f"{_record(['tn', 'fp', 'fn', 'tp'])} FROM c"),
        "threshold_metrics": _with(MEASURED, f"SELECT evaluation, {_rounded(threshold_values())} FROM m"),
        "roc_auc": _with(MEASURED, f"SELECT evaluation, {r('roc_auc')} AS roc_auc FROM m"),
        "average_precision": _with(MEASURED, f"SELECT evaluation, {r('pr_auc')} AS pr_auc FROM m"),
        "log_loss_brier": _with(MEASURED, f"SELECT evaluation, {_rounded(['log_loss', 'brier_score'])} FROM m"),
        "class_report": _with([*SCORED, cells("c", "evaluations")], _class_report()),
        "fold_metrics": _with(MEASURED, f"SELECT evaluation, {_record()} FROM m "
                                        "WHERE starts_with(evaluation, 'cv_fold_')"),
        "fold_mean_std": _with([*MEASURED, summary("s", "m")], f"SELECT evaluation, {_rounded(METRIC_COLUMNS)} "
                               "FROM s WHERE evaluation IN ('cv_mean', 'cv_std')"),
        "metrics_summary": _with(ALL_EVALUATIONS, f"SELECT evaluation, {_rounded(METRIC_COLUMNS)} FROM s"),
        "metrics_summary_text": _with(ALL_EVALUATIONS, "SELECT evaluation, " + ", ".join(
            f"printf('%.6f', {r(c)}) AS {c}" for c in METRIC_COLUMNS) + " FROM s"),
        "metrics_display": _with(ALL_EVALUATIONS, f"""SELECT evaluation, metric, label, coalesce(printf('%.4f', {r('value', 4)}), 'nan')
  AS text FROM (UNPIVOT (SELECT evaluation, {values} FROM s) ON {values} INTO NAME metric VALUE value)
JOIN (VALUES {labels}) AS l(metric, label) USING (metric)"""),
        "selection_curve": _with(SELECTION, f"SELECT n_features, {_rounded(['auc_mean', 'auc_se'])} FROM curve"),
        "one_se_choice": _with(SELECTION, f"""SELECT best_n_features, {r('best_cv_auc')} AS best_cv_auc,
  {r('threshold')} AS threshold, chosen_n_features, {r('chosen_cv_auc')} AS chosen_cv_auc FROM choice"""),
        "feature_ranking": _with(SELECTION, f"""SELECT feature,
  CAST({len(KEPT) + 1} - elim_step AS INTEGER) AS rfe_rank,
  {_rounded(['initial_mean_abs_shap', 'mutual_info'])},
  {len(KEPT) + 1} - elim_step <= chosen_n_features AS selected
FROM steps JOIN mi USING (feature), choice"""),
        "forest_report_metrics": _with(ALL_EVALUATIONS, f"SELECT evaluation, {_record()} FROM m"),
        "leakage_report_entries": _with(DIAG, _leakage_entries()),
        "selection_report_entries": _with(SELECTION, _selection_entries()),
        "sketched_ranking": _with(SCORED, _sketched()),
    }
    # What is written and read back, or saved and reloaded, is what was there before.
    same = {"attribute_file": "ternary_features", "clean_file_csv": "clean_dataset", "clean_file_parquet": "clean_dataset",
            "prediction_files": "prediction_table", "summary_file": "metrics_summary_text", "saved_rates": "oof_target_rate",
            "saved_rates_predictions": "test_prediction_table"}
    return {**found, **{name: found[original] for name, original in same.items()}}
