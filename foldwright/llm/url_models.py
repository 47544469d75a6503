"""URL filter: rules for hosts and paths, and character language models of accepted and rejected URLs for the rest.

A rule names a host, with all its subdomains, a start of the path and a verdict; the longest that fits decides. The URLs that
rules decide are what the models learn from: one model of the accepted, one of the rejected URLs. Both are Markov models
of variable order: the probability of a character is interpolated (Witten-Bell) from contexts of ``ORDER`` characters down
to none, each weighted by how often it occurs and how many characters follow it, and below them all characters are alike.

The weight of a character for a verdict is the logarithm of the ratio of its two probabilities, in whole millionths. It depends
only on the character and the ``ORDER`` ones before it, so weights are computed once for each distinct run of that many
characters, from counts that are rolled up from longer to shorter contexts, and a URL's score is their sum divided by its
length. Sums of whole numbers do not depend on the order of the rows.

The threshold is calibrated on rule-decided URLs that the models do not learn from, a quarter by a hash of the URL: of all
scores, in steps of a thousandth, the one that gives the greatest sum of the shares of accepted URLs at or above it and
of rejected ones below it; of equal ones that nearest to 0, then the smaller.

Defined results: host and path of a null URL, or one without ``://``, are empty, no rule fits, and the method judges the whole
text (null: empty). If both classes have no URL to calibrate with, or one has none, the threshold is 0; without URLs to
learn from all scores are 0 and the verdict is allow. Of two rules of one length that both fit, the longer host wins. Rows are
kept as they are, repeated and null page_id too; an empty table gives an empty result. Columns other than page_id and url are
not read. Only DataFrame expressions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.llm.common import broadcast_within, materialize
from foldwright.operators.vectors import attach_by_group

Rule = tuple[str, str, str]
#: Fixed values of the contract: host, start of the path, verdict.
RULES: list[Rule] = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
                     ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Characters of the longest context, and what stands before and behind a URL.
ORDER, START, END = 4, "\u0002", "\u0003"
#: Parts of a log-probability ratio, and of those the width of a score's step.
PARTS, STEP = 1_000_000, 1000
#: Of the 16 classes of a hash, those that calibrate.
HELD_OUT = "0123"
#: Rows of one run of characters in a task, when weights are too many to be broadcast.
HOT_ROWS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """rule and verdict of the longest rule that fits, null fields if none does."""
    ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))
    fits = [(F.endswith(F.concat(F.lit("."), host), F.lit("." + h)) & F.startswith(path, F.lit(p)), h + p, v) for h, p, v in ranked]
    kind = "struct<rule:string,verdict:string>"
    return F.coalesce(*[F.when(fit, F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict"))) for fit, r, v in fits],
                      F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")).cast(kind))


def parsed(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """page_id, url, host, path, rule, verdict (of the rule)."""
    split = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return split.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).select(
        "page_id", "url", "host", "path", "found.rule", "found.verdict")


def grams(texts: DataFrame, order: int, *columns: str) -> DataFrame:
    """``columns`` and each run of ``order`` characters and the one behind them, of each text with its marks."""
    marked = F.concat(F.lit(START * order), "text", F.lit(END))
    chars = F.regexp_extract_all(marked, F.lit("(?s)."), F.lit(0))
    cut = texts.select(*columns, chars.alias("chars"))
    runs = F.transform(F.sequence(F.lit(0), F.size("chars") - (order + 1)),
                       lambda k: F.concat(*[F.get(F.col("chars"), k + j) for j in range(order + 1)]))
    return cut.select(*columns, F.explode(runs).alias("gram"))


def _interpolated(seen: str, context: str, kinds: str, lower: str) -> Column:
    """(occurrences + kinds x lower probability) / (occurrences of the context + kinds); the lower one for a new context."""
    whole = F.col(context) + F.col(kinds)
    return F.when(whole == 0, F.col(lower)).otherwise((F.col(seen) + F.col(kinds) * F.col(lower)) / whole)


def weights(counts: DataFrame, order: int) -> DataFrame:
    """gram, n and its weight in ``1 / PARTS``, from gram, n (all), a (accepted) and r (rejected learnt from).

    A run has at most as many longer runs as there are characters, so no key of these joins is hot.
    """
    letters = counts.select(F.substring("gram", order + 1, 1)).distinct().count()
    below = None
    for k in range(order + 1):
        runs = counts if k == order else counts.groupBy(F.substring("gram", F.lit(order + 1 - k), F.lit(k + 1)).alias("gram")).agg(
            *[F.sum(c).alias(c) for c in ("n", "a", "r")])
        runs = runs.withColumn("context", F.substring("gram", 1, k))
        of = runs.groupBy("context").agg(*[F.sum(c).alias(f"{c}_all") for c in "ar"],
                                         *[F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_kinds") for c in "ar"])
        runs = runs.join(of, "context")
        if below is None:
            runs = runs.withColumns({f"{c}_low": F.lit(1.0 / max(letters, 1)) for c in "ar"})
        else:
            shorter = below.select(F.col("gram").alias("shorter"), *[F.col(f"{c}_p").alias(f"{c}_low") for c in "ar"])
            runs = runs.withColumn("shorter", F.substring("gram", 2, k)).join(shorter, "shorter")
        below = runs.select("gram", "n", *[_interpolated(c, f"{c}_all", f"{c}_kinds", f"{c}_low").alias(f"{c}_p") for c in "ar"])
    return below.select("gram", "n", F.round(PARTS * (F.ln("a_p") - F.ln("r_p"))).cast("long").alias("weight"))


def scores(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """text, verdict, held and the score, in steps of ``STEP / PARTS``, of distinct texts (text, verdict, held)."""
    learnt = [F.when((F.col("verdict") == v) & ~F.col("held"), F.lit(1)).otherwise(F.lit(0)).alias(c)
              for c, v in (("a", "allow"), ("r", "block"))]
    counts = materialize(grams(urls.withColumns({"a": learnt[0], "r": learnt[1]}), order, "a", "r").groupBy("gram").agg(
        F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("r").alias("r")), "url-grams")
    weight = materialize(weights(counts, order), "url-weights")
    numbered = materialize(urls.withColumn("number", F.monotonically_increasing_id()), "url-numbers")
    rows = grams(numbered, order, "number")
    small = broadcast_within(weight)
    joined = rows.join(small, "gram") if small is not weight else attach_by_group(
        rows, weight, ["weight"], ["gram"], HOT_ROWS, "number")
    sums = joined.groupBy("number").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("length"))
    score = F.floor(F.col("total") / F.col("length") / STEP).cast("long")
    return numbered.join(sums, "number").select("text", "verdict", "held", score.alias("score"))


def threshold(scored: DataFrame) -> int:
    """The calibrated score, from counts of held-out texts for each score, which are as many as there are scores."""
    rows = (scored.where(F.col("held") & F.col("verdict").isNotNull()).groupBy("score")
            .agg(*[F.sum((F.col("verdict") == v).cast("long")).alias(v) for v in ("allow", "block")]).orderBy("score").collect())
    accepted, rejected = sum(r["allow"] for r in rows), sum(r["block"] for r in rows)
    if not accepted or not rejected:
        return 0
    best, above, below = (-1, 0, 0), accepted, 0
    for r in rows:
        best = max(best, (above * rejected + below * accepted, -abs(r["score"]), -r["score"]))
        above, below = above - r["allow"], below + r["block"]
    return -best[2]


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule, verdict and the score of the method (null where a rule decides) for each row."""
    known = materialize(parsed(pages, rules), "url-parsed")
    text = F.coalesce("url", F.lit(""))
    urls = materialize(known.select(text.alias("text"), "verdict").distinct().withColumn(
        "held", F.col("verdict").isNotNull() & F.substring(F.md5(F.col("text").cast("binary")), 1, 1).isin(*HELD_OUT)), "url-texts")
    scored = materialize(scores(urls, order), "url-scores")
    least = threshold(scored)
    # A URL that a rule decides needs no score; those of one text, which may be many, meet its one row in salted copies.
    ruled = known.where(F.col("rule").isNotNull()).select("page_id", "host", "path", "rule", "verdict", F.lit(None).cast("double").alias("score"))
    open_rows = known.where(F.col("rule").isNull()).select("page_id", "host", "path", "rule", text.alias("text"))
    copies = open_rows.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    lookup = scored.where(F.col("verdict").isNull()).select("text", "score").join(copies, "text")
    found = attach_by_group(open_rows.withColumn("row", F.monotonically_increasing_id()), materialize(lookup, "url-lookup"),
                            ["score"], ["text"], HOT_ROWS, "row")
    judged = found.select("page_id", "host", "path", "rule", F.when(F.col("score") >= least, "allow").otherwise("block").alias("verdict"),
                          (F.col("score") / F.lit(PARTS / STEP)).alias("score"))
    return ruled.unionByName(judged)


def twin(rules: Sequence[Rule] = RULES, order: int = ORDER) -> str:
    """The same in DuckDB's SQL, for the table ``pages``."""
    ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))
    cases = {k: " ".join(f"WHEN ends_with('.' || host, '.{r[0]}') AND starts_with(path, '{r[1]}') THEN '{r[0] + r[1] if k else r[2]}'"
                         for r in ranked) for k in (0, 1)}
    start, end = f"repeat(chr({ord(START)}), {order})", f"chr({ord(END)})"
    steps = []
    for k in range(order + 1):
        source = "counts" if k == order else (
            f"(SELECT substr(gram, {order + 1 - k}, {k + 1}) AS gram, sum(a)::BIGINT AS a, sum(r)::BIGINT AS r FROM counts GROUP BY 1)")
        low = "1.0::DOUBLE / (SELECT count(DISTINCT substr(gram, %d, 1)) FROM counts)" % (order + 1)
        lows = [low, low] if k == 0 else ["b.a_p", "b.r_p"]
        joined = "" if k == 0 else f" JOIN p{k - 1} AS b ON b.gram = substr(x.gram, 2, {k})"
        p = [f"CASE WHEN o.{c}_all + o.{c}_kinds = 0 THEN {w} ELSE (x.{c} + o.{c}_kinds * {w}) / (o.{c}_all + o.{c}_kinds)::DOUBLE END AS {c}_p"
             for c, w in zip("ar", lows)]
        steps.append(f"""x{k} AS (SELECT *, substr(gram, 1, {k}) AS context FROM {source}),
o{k} AS (SELECT context, sum(a)::BIGINT AS a_all, sum(r)::BIGINT AS r_all, count(*) FILTER (a > 0) AS a_kinds,
 count(*) FILTER (r > 0) AS r_kinds FROM x{k} GROUP BY 1),
p{k} AS (SELECT x.gram, {', '.join(p)} FROM x{k} AS x JOIN o{k} AS o USING (context){joined})""")
    return f"""WITH split AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
 coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
known AS (SELECT page_id, coalesce(url, '') AS text, host, path, CASE {cases[1]} END AS rule, CASE {cases[0]} END AS verdict FROM split),
urls AS (SELECT DISTINCT text, verdict, verdict IS NOT NULL AND md5(text)[1] IN ({', '.join(f"'{c}'" for c in HELD_OUT)}) AS held FROM known),
marked AS (SELECT *, {start} || text || {end} AS whole FROM urls),
grams AS (SELECT text, verdict, held, substr(whole, k::BIGINT, {order + 1}) AS gram
 FROM (SELECT *, unnest(range(1, length(whole) - {order} + 1)) AS k FROM marked)),
counts AS (SELECT gram, count(*) FILTER (verdict = 'allow' AND NOT held) AS a, count(*) FILTER (verdict = 'block' AND NOT held) AS r
 FROM grams GROUP BY 1),
{', '.join(steps)},
weights AS (SELECT gram, round({PARTS} * (ln(a_p) - ln(r_p)))::BIGINT AS weight FROM p{order}),
scored AS (SELECT text, verdict, held, floor(sum(weight)::BIGINT / count(*) / {STEP})::BIGINT AS score FROM grams JOIN weights USING (gram) GROUP BY ALL),
steps AS (SELECT score, count(*) FILTER (verdict = 'allow') AS a, count(*) FILTER (verdict = 'block') AS r FROM scored
 WHERE held AND verdict IS NOT NULL GROUP BY 1),
curve AS (SELECT score, sum(a) OVER () AS all_a, sum(r) OVER () AS all_r, sum(a) OVER (ORDER BY score DESC) AS above,
 coalesce(sum(r) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM steps),
least AS (SELECT coalesce((SELECT score FROM curve WHERE all_a > 0 AND all_r > 0
 ORDER BY above * all_r + below * all_a DESC, abs(score), score LIMIT 1), 0) AS score)
SELECT page_id, host, path, rule, coalesce(k.verdict, CASE WHEN s.score >= (SELECT score FROM least) THEN 'allow' ELSE 'block' END) AS verdict,
 CASE WHEN rule IS NULL THEN s.score / {PARTS / STEP} END AS score
FROM known AS k JOIN scored AS s ON s.text = k.text AND s.verdict IS NOT DISTINCT FROM k.verdict"""
