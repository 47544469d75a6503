"""Benchmark decontamination by templates.

Numbers, names and units of a text become typed placeholders; what is left is lower-cased, stripped of punctuation and
cut at white space. Every window of ``WINDOW`` tokens of every document is joined by its hash with the windows of the
benchmark items. A document holds an item if it has a share of ``COVERAGE`` of the item's windows. The values that stood
at the placeholders must then agree along the best alignment: wherever the item repeats a value, the document must repeat
the value that it put in its place. So a question with other numbers and names is caught, and a text that shares only
the pattern is not.

A capitalised word behind a lower-case word or a comma is a name. Elsewhere, as at the start of a text, sentence or line and
behind a title, it may be one or not: such a word counts both ways, and a window is found if either way agrees. It takes part
in the comparison of values if it is a name elsewhere in the item or never lower-case in the benchmark.

All of this is DataFrame expressions. The windows of the benchmark are broadcast up to ``BROADCAST_WINDOWS`` of them, and
joined by a shuffle beyond.

Defined results: null and empty texts have no windows; repeated rows and equal texts are judged alike, a repeated doc_id
by each of its texts; windows with placeholders in more than half of their places do not count; items with fewer tokens
than a window are one window of their own length; items below ``LEAST`` tokens or without a window that counts are found where
they occur literally, with all numbers, names and signs in order, whatever the case and white space; letters of scripts
without spaces are tokens of their own; of a repeated item_id each text is an item; items without any sign are never found;
empty tables give an empty result. Columns other than doc_id, item_id and text are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwright.llm.common import free_name, materialize

WINDOW, LEAST, COVERAGE = 8, 5, 0.5
BROADCAST_WINDOWS = 1_000_000
#: Placeholders: private code points, one for each kind.
NAME, NUMBER, UNIT = "\ue001", "\ue002", "\ue003"
#: Before a word that may be a name; the word stays.
MAYBE = "\ue004"
MARKS = NAME + NUMBER + UNIT + MAYBE
#: Units behind a number.
UNITS = ("mm cm dm m km in ft yd mi mg g kg t lb lbs oz ml cl l hl gal s sec ms min h hr hrs d hz khz mhz ghz w kw mw kwh v a "
         "j kj cal kcal pa kpa bar k c f mph kmh kph usd eur gbp jpy meters metres meter metre kilometers kilometres miles "
         "feet inches yards grams kilograms kilos pounds ounces liters litres gallons seconds minutes hours days weeks "
         "months years degrees percent dollars cents euros watts volts meilen stunden tage jahre prozent heures jours ans "
         "horas dias segundos minutos").split()
UNIT_AFTER = r"(\p{Nd}) ?(%|°|(?i:" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")\b)"
CURRENCY_BEFORE = r"([$€£¥])(?= ?\p{Nd})"
NUMBERS = r"\p{Nd}++(?:[.,:]\p{Nd}++)*+"
#: A capitalised word inside a sentence.
NAMES = r"\p{Lu}(?<=[\p{Ll},;:] \p{Lu})\p{Ll}++"
#: Any other capitalised word. What stands before it is looked at behind its capital, as capitals are few.
OTHERS = rf"\p{{Lu}}(?<![\p{{L}}\p{{N}}{MARKS}]\p{{Lu}})\p{{Ll}}++"
SPACES = r"[\s\p{Z}]++"
#: Scripts without spaces between words; none has letters below U+0E00, which is known before the script is looked up.
SCRIPTS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
UNSPACED = rf"[\u0E00-\x{{10FFFF}}&&[{SCRIPTS}]]"
LITERAL = rf"[{SCRIPTS}]|[\p{{L}}\p{{M}}&&[^{SCRIPTS}]]++|{NUMBERS}|[^\s\p{{Z}}]"


def marked(text: Column, keep: bool = False) -> Column:
    """The tokens of ``text`` with placeholders, a space between them; with ``keep``, values stand behind their placeholders."""
    plain = F.regexp_replace(reduce(lambda t, m: F.replace(t, F.lit(m), F.lit("")), MARKS, F.coalesce(text, F.lit(""))), SPACES, " ")
    plain = F.regexp_replace(F.regexp_replace(plain, NAMES, NAME + ("$0" if keep else "")), OTHERS, MAYBE + "$0")
    for pattern, before, value, after in ((UNIT_AFTER, "$1 ", "$2", " "),
                                          (CURRENCY_BEFORE, " ", "$1", " "), (NUMBERS, " ", "$0", " ")):
        mark = NUMBER if pattern == NUMBERS else UNIT
        plain = F.regexp_replace(plain, pattern, before + mark + (value if keep else "") + after)
    plain = F.regexp_replace(F.lower(plain), rf"[^\p{{L}}\p{{N}}\s{MARKS}]++", "")
    plain = F.regexp_replace(plain, UNSPACED, " $0 ")
    return F.trim(F.regexp_replace(plain, r"\s++", " "))


def tokens(text: Column, keep: bool = False) -> Column:
    return F.split(marked(text, keep), " ")


def literal_tokens(text: Column) -> Column:
    """The words, numbers and signs of ``text`` as they stand, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(LITERAL), F.lit(0))


def _mark(token: Column) -> Column:
    """The placeholder of a token, if any."""
    first = F.substring(token, 1, 1)
    return F.when(first == MAYBE, NAME).when(first.isin(*MARKS), first)


def _plain(token: Column) -> Column:
    """A token in which a word that may be a name is none."""
    return F.translate(token, MAYBE, "")


def _windows(rows: DataFrame, length: int) -> DataFrame:
    """``at`` and ``window`` (hash) of all windows of ``length`` tokens; ``rows`` has ``plain``, an array of the tokens.

    With a column ``named``, the other reading of each token, windows that differ by it are there with both. A window is
    hashed behind the explosion of its place, where it is compiled; a lambda over an array would be interpreted.
    """
    places = F.when(F.size("plain") >= length, F.sequence(F.lit(0), F.size("plain") - length))
    readings = [c for c in ("plain", "named") if c in rows.columns]
    keys = [c for c in rows.columns if c not in readings]
    cut = rows.select(*keys, *readings, F.explode(places).alias("at"))
    hashes = [F.xxhash64(*(F.get(F.col(c), F.col("at") + k) for k in range(length))).alias(f"as_{c}") for c in readings]
    cut = cut.select(*keys, "at", *hashes)
    if "named" not in readings:
        return cut.withColumnRenamed("as_plain", "window")
    either = F.when(F.col("as_plain") == F.col("as_named"), F.array("as_plain")).otherwise(F.array("as_plain", "as_named"))
    return cut.select(*keys, "at", F.explode(either).alias("window"))


def _read(rows: DataFrame) -> DataFrame:
    """``rows`` with the two readings of their ``marked`` text: a word that may be a name is none, or is one."""
    names = F.regexp_replace("marked", f"(?<![^ ])[{NAME}{MAYBE}][^ ]*+", NAME)
    return (rows.withColumn("plain", F.split(F.replace("marked", F.lit(MAYBE), F.lit("")), " "))
            .withColumn("named", F.split(F.replace(names, F.lit(MAYBE), F.lit("")), " ")).drop("marked"))


def _item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """item, n_windows, length, at, window of the benchmark windows that count."""
    items = materialize(benchmark.select("item_id", "text").dropDuplicates()
                        .withColumn("marked", marked(F.col("text"))).withColumn("tokens", F.split("marked", " "))
                        .withColumn("item", F.xxhash64("item_id", "text")).where(F.size("tokens") >= LEAST), "items")
    lengths = [r["n"] for r in items.select(F.least(F.size("tokens"), F.lit(window)).alias("n")).distinct().collect()]
    found = []
    for length in sorted(lengths):
        own = items.where(F.least(F.size("tokens"), F.lit(window)) == length)
        cut = _windows(_read(own.select("item", "marked")), length).withColumn("length", F.lit(length))
        marks = F.size(F.filter(F.slice("tokens", F.col("at") + 1, F.lit(length)), lambda t: _mark(_plain(t)).isNotNull()))
        found.append(cut.join(own.select("item", "tokens"), "item").where(2 * marks <= length).drop("tokens"))
    if not found:
        return items.select("item", F.lit(0).alias("length"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("window"),
                            F.lit(0).cast("long").alias("n_windows"))
    every = reduce(DataFrame.unionByName, found)
    return every.withColumn("n_windows", F.size(F.collect_set("at").over(Window.partitionBy("item"))))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """The documents that hold an item: doc_id, text_hash, item_id, coverage, slots, changed.

    ``slots``: values compared along the best alignment; ``changed``: those that differ from the item's.
    """
    known = materialize(_item_windows(benchmark, window), "item-windows")
    small = known.count() <= BROADCAST_WINDOWS
    lengths = [r["length"] for r in known.select("length").distinct().collect()]
    texts = _read(docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), marked(F.col("text")).alias("marked")))
    hits = []
    for length in sorted(lengths) or [window]:
        own = known.where(F.col("length") == length).select("item", "n_windows", F.col("at").alias("item_at"), "window")
        hits.append(_windows(texts, length).join(F.broadcast(own) if small else own, "window"))
    keys = ["doc_id", "text_hash", "item"]
    lines = (reduce(DataFrame.unionByName, hits)
             .groupBy(*keys, (F.col("at") - F.col("item_at")).alias("shift"))
             .agg(F.collect_set("item_at").alias("places"), F.max("n_windows").alias("n_windows")))
    best = (lines.groupBy(*keys).agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("found"),
                                     F.max(F.struct(F.size("places").alias("n"), F.array_min("places").alias("first"),
                                                    F.array_max("places").alias("last"), "shift")).alias("line"),
                                     F.max("n_windows").alias("n_windows"))
            .withColumn("coverage", F.col("found") / F.col("n_windows")).where(F.col("coverage") >= coverage))
    best = materialize(best, "held-items")
    columns = ["doc_id", "text_hash", "item_id", "coverage", "slots", "changed"]
    held = _consistent(best, docs, benchmark, window).select(*columns)
    exact = _occurrences(docs, benchmark, known)
    return held if exact is None else held.unionByName(exact.select(*columns))


def _occurrences(docs: DataFrame, benchmark: DataFrame, known: DataFrame) -> DataFrame | None:
    """The literal occurrences of the items without windows in ``known``; None without such items."""
    every = (benchmark.select("item_id", "text").dropDuplicates().withColumn("item", F.xxhash64("item_id", "text"))
             .join(known.select("item").distinct(), "item", "left_anti"))
    bare = materialize(every.withColumn("plain", literal_tokens(F.col("text")))
                       .withColumn("slots", F.size(F.filter(tokens(F.col("text")), lambda t: _mark(_plain(t)).isNotNull())))
                       .where(F.size("plain") > 0).withColumn("length", F.least(F.size("plain"), F.lit(WINDOW)))
                       .select("item", "item_id", "plain", "length", "slots"), "items-without-windows")
    lengths = [r["length"] for r in bare.select("length").distinct().collect()]
    if not lengths:
        return None
    small = bare.select(F.sum(F.size("plain"))).first()[0] <= BROADCAST_WINDOWS
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
                        literal_tokens(F.col("text")).alias("plain"))
    hits = []
    for length in sorted(lengths):
        own = _windows(bare.where(F.col("length") == length).select(
            "item", (F.size("plain") - length + 1).alias("n_windows"), "plain"), length).withColumnRenamed("at", "item_at")
        hits.append(_windows(texts, length).join(F.broadcast(own) if small else own, "window"))
    # A run is there as a whole if all its windows are, at one distance.
    return (reduce(DataFrame.unionByName, hits)
            .groupBy("doc_id", "text_hash", "item", (F.col("at") - F.col("item_at")).alias("shift"))
            .agg(F.size(F.collect_set("item_at")).alias("n"), F.max("n_windows").alias("n_windows")).where("n = n_windows")
            .select("doc_id", "text_hash", "item").distinct().join(bare.select("item", "item_id", "slots"), "item")
            .withColumn("coverage", F.lit(1.0)).withColumn("changed", F.lit(0)))


def _consistent(best: DataFrame, docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """The rows of ``best`` whose values agree, with the number of values compared and changed."""
    items = (benchmark.select("item_id", F.xxhash64("item_id", "text").alias("item"), tokens(F.col("text"), True).alias("own"))
             .dropDuplicates(["item"]))
    wanted = best.select("text_hash").distinct()
    texts = (docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
             .join(wanted, "text_hash", "left_semi").dropDuplicates(["text_hash"])
             .select("text_hash", tokens(F.col("text"), True).alias("theirs")))
    texts = materialize(texts, "held-texts")
    length = F.col("line.last") - F.col("line.first") + F.least(F.lit(window), F.size("own"))
    pairs = F.arrays_zip(F.slice("own", F.col("line.first") + 1, length).alias("a"),
                         F.slice("theirs", F.col("line.first") + F.col("line.shift") + 1, length).alias("b"))
    words = items.select("item", F.explode("own").alias("word"))
    common = (benchmark.select(F.explode(tokens(F.col("text"), True)).alias("word")).where(_mark(F.col("word")).isNull())
              .select(F.concat(F.lit(MAYBE), "word").alias("word")).distinct())
    names = words.where(F.col("word").startswith(NAME)).select("item", F.translate("word", NAME, MAYBE).alias("word"))
    loose = (words.where(F.col("word").startswith(MAYBE)).join(common, "word", "left_semi").join(names, ["item", "word"], "left_anti")
             .groupBy("item").agg(F.collect_set("word").alias("loose")))
    slots = F.filter(pairs, lambda x: (_mark(x["a"]) == _mark(x["b"])) & ~F.array_contains("loose", x["a"]))
    bare = F.transform(slots, lambda x: F.struct(*(F.translate(x[c], NAME, MAYBE).alias(c) for c in "ab")))
    return (best.join(items, "item").join(texts, "text_hash")
            .join(loose, "item", "left").withColumn("loose", F.coalesce("loose", F.array().cast("array<string>")))
            .withColumn("pairs", bare)
            .withColumn("slots", F.size("pairs"))
            .withColumn("changed", F.size(F.filter("pairs", lambda x: x["a"] != x["b"])))
            .where(F.size(F.array_distinct("pairs")) == F.size(F.array_distinct(F.transform("pairs", lambda x: x["a"])))))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, with all columns."""
    mark = free_name(docs, "text_hash")
    held = materialize(leaks(docs, benchmark).select(F.col("text_hash").alias(mark)).distinct(), "leaked-texts")
    return docs.withColumn(mark, F.xxhash64(F.coalesce("text", F.lit("")))).join(held, mark, "left_anti").drop(mark)
