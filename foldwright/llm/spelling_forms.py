"""Spelling variants of a corpus vocabulary by composition of automata.

Two words are near if one edit (one code point inserted, deleted or replaced) makes one of the other. They are the pairs
that the composition of the vocabulary acceptor, a one-edit transducer and the acceptor again accepts. A state of it is a
pair of acceptor states and whether the edit is spent: before the edit both are one state, behind it both read the same
symbols, so the accepted pairs of a state are the common suffixes behind each edit that it allows. The acceptor is
minimised, so these are found once for all prefixes that lead to a state. A pair is found where its words first differ.

The work is split by the initial state: a partition holds the words behind one prefix, and its automaton starts there.
One edit leaves the first or the last ``KEY`` code points as they are, so every pair lies in a partition of a prefix or, with
words and automata reversed, of a suffix; the latter leave out pairs that the former find. A partition of more than
``PARTITION_WORDS`` is split again by the transitions of its initial state: without an edit into the partitions of the
longer prefixes, with the edit into partitions of words that agree in all the rest, at most one for each letter.

Partitions return for each of their words the number of its near words and the most frequent of them, so no list of
pairs is shuffled. Forms strictly grow tenfold, so the last form of a chain is found by a few rounds of pointer doubling.

Words are the maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z in lower case. For one in 31, by the crc32 of ``<doc_id>:<run>``,
one code point is deleted. Defined results: a null text has no runs; a null doc_id counts as an empty text in the crc32;
repeated rows count each; an empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from math import ceil, log2, log10

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.llm.common import broadcast_within, materialize

#: Fixed values of the vocabulary: letters of a run, share of runs that lose a code point, least length and count.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
LOST, LEAST_LENGTH, LEAST_COUNT = 31, 7, 2
#: A form occurs at least so many times as often as its word.
RATIO = 10
#: Code points of the shortest prefix of a partition; a word must have twice as many and one.
KEY = 3
#: Words of a partition that one task composes at once; larger ones are split.
PARTITION_WORDS = 4000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Acceptor:
    """The minimal acyclic acceptor of sorted distinct words, read from position ``start`` on."""

    def __init__(self, words: list[str], start: int):
        self.steps: list[tuple[tuple[str, int], ...]] = []
        self.final: list[bool] = []
        self._known: dict[tuple, int] = {}
        self._least: list[int] = []
        open_states: list[list] = [[[], False]]  # transitions and finality of the states along the last word
        last = ""
        for word in words:
            rest = word[start:]
            shared = 0
            for x, y in zip(last, rest):
                if x != y:
                    break
                shared += 1
            self._close(open_states, last, shared)
            open_states.extend([[], False] for _ in range(len(rest) - shared))
            open_states[-1][1] = True
            last = rest
        self._close(open_states, last, 0)
        self.initial = self._state(*open_states[0])

    def _close(self, open_states: list[list], word: str, depth: int) -> None:
        while len(open_states) > depth + 1:
            state = self._state(*open_states.pop())
            open_states[-1][0].append((word[len(open_states) - 1], state))

    def _state(self, steps: list[tuple[str, int]], final: bool) -> int:
        key = (final, *steps)
        found = self._known.get(key)
        if found is None:
            found = self._known[key] = len(self.steps)
            self.steps.append(tuple(steps))
            self.final.append(final)
            self._least.append(0 if final else 1 + min((self._least[s] for _, s in steps), default=0))
        return found

    def common(self, x: int, y: int, skipped: str, dead: set[tuple[int, int]]) -> list[str]:
        """The words that both states accept and that do not start with ``skipped``."""
        out: list[str] = []
        if self.final[x] and self.final[y]:
            out.append("")
        path: list[str] = []
        frames = [[x, y, iter(self._both(x, y, skipped)), 0]]
        while frames:
            frame = frames[-1]
            for symbol, p, q in frame[2]:
                if (p, q) in dead:
                    continue
                path.append(symbol)
                before = len(out)
                if self.final[p] and self.final[q]:
                    out.append("".join(path))
                frames.append([p, q, iter(self._both(p, q, "")), before])
                break
            else:
                frames.pop()
                if frames:
                    path.pop()
                    if len(out) == frame[3]:
                        dead.add((frame[0], frame[1]))
        return out

    def _both(self, x: int, y: int, skipped: str) -> list[tuple[str, int, int]]:
        if x == y:
            return [(c, s, s) for c, s in self.steps[x] if c != skipped]
        other = dict(self.steps[y])
        return [(c, s, other[c]) for c, s in self.steps[x] if c != skipped and c in other]

    def edits(self, within: int | None) -> list[list[tuple[str, str]]]:
        """For each state the pairs of words that it accepts and that differ first in their first symbol.

        With ``within``, edits are taken only where a word can end within so many symbols.
        """
        dead: set[tuple[int, int]] = set()
        found: list[list[tuple[str, str]]] = []
        for p, steps in enumerate(self.steps):
            out: list[tuple[str, str]] = []
            if within is None or self._least[p] <= within:
                for k, (a, s) in enumerate(steps):
                    out += [(a + rest, b + rest) for b, t in steps[k + 1:] for rest in self.common(s, t, "", dead)]
                    if len(steps) > 1 or self.final[p]:
                        out += [(rest, a + rest) for rest in self.common(p, s, a, dead)]
            found.append(out)
        return found

    def pairs(self, prefix: str, within: int | None = None) -> Iterator[tuple[str, str]]:
        """All pairs of accepted words that are one edit apart, with ``prefix`` in front, each once."""
        found = self.edits(within)
        live = []
        for out, steps in zip(found, self.steps):  # a state has a greater number than those that it leads to
            live.append(bool(out) or any(live[s] for _, s in steps))
        path = [prefix]
        frames = [(self.initial, iter(self.steps[self.initial]))]
        if found[self.initial]:
            yield from ((prefix + u, prefix + v) for u, v in found[self.initial])
        while frames:
            for symbol, state in frames[-1][1]:
                if live[state]:
                    path.append(symbol)
                    if found[state]:
                        front = "".join(path)
                        yield from ((front + u, front + v) for u, v in found[state])
                    frames.append((state, iter(self.steps[state])))
                    break
            else:
                frames.pop()
                path.pop()


def same_rest(words: list[str], at: int, key: str) -> Iterator[tuple[str, str]]:
    """Pairs of a partition whose words are ``key``, or become it when the code point ``at`` is deleted."""
    longer = [w for w in words if len(w) > len(key)]
    shorter = [w for w in words if len(w) == len(key)]
    for k, u in enumerate(longer):
        yield from ((u, v) for v in longer[k + 1:] if u[at] != v[at])
        yield from ((w, u) for w in shorter if u[at:at + 1] != w[at:at + 1])


def _partition(key: str, depth: int, edited: bool, counts: dict[str, int]) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, count and text of the most frequent of them) of a partition."""
    backward, prefix = key[0] == "b", key[1:]
    words = sorted(counts)
    pairs = (same_rest(words, depth, prefix) if edited
             else Acceptor(words, depth).pairs(prefix, KEY + 1 if backward else None))
    near: dict[str, list] = {}
    for u, v in pairs:
        if backward and u[:-KEY - 1:-1] == v[:-KEY - 1:-1]:
            continue  # the same start: found in the partition of that prefix
        for x, y in ((u, v), (v, u)):
            n, text = counts[y], y[::-1] if backward else y
            best = near.get(x)
            if best is None:
                near[x] = [1, n, text]
            else:
                best[0] += 1
                if n > best[1] or n == best[1] and text < best[2]:
                    best[1], best[2] = n, text
    for word, (times, n, text) in near.items():
        yield word[::-1] if backward else word, times, n, text


NEAR = "word string, n_near long, form_n long, form string"
OUT = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compose the partitions of a task, whose rows are sorted by them."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    out: list[tuple] = []
    for (key, depth, edited), members in groupby(rows, key=lambda r: r[:3]):
        counts = {word: n for *_, word, n in members}
        if len(counts) > 1:
            out += _partition(key, depth, edited, counts)
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), OUT)], schema=OUT)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), OUT)], schema=OUT)


def _lower(word: Column) -> Column:
    return F.when(word.rlike("[A-Z]"), F.translate(word, UPPER, LOWER)).otherwise(word)


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: the words of all texts that are long and frequent enough. A shorter run cannot become such a word."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(
        F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"))
    runs = runs.select("d", _lower(F.col("run")).alias("run"))
    drawn = runs.select("run", F.crc32(F.concat("d", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % LOST == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
                  ).otherwise(F.col("run"))
    words = drawn.select(word.alias("word")).where(F.char_length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def partitions(words: DataFrame, limit: int) -> DataFrame:
    """key, depth, edited, word, n: the words of each partition, those to the suffixes reversed."""
    both = words.select("n", F.explode(F.array(
        F.struct(F.lit("f").alias("way"), "word"),
        F.struct(F.lit("b").alias("way"), F.reverse("word").alias("word")))).alias("x")).select("x.way", "x.word", "n")
    opened, depth, ready = both, KEY, []
    while True:
        key = F.concat("way", F.substring("word", F.lit(1), F.lit(depth)))
        members = opened.select(key.alias("key"), F.lit(depth).alias("depth"), F.lit(False).alias("edited"), "way", "word", "n")
        large = materialize(members.groupBy("key").count().where(F.col("count") > limit).select("key"), "forms-large")
        columns = ["key", "depth", "edited", "word", "n"]
        if large.isEmpty():
            return _union([*ready, members.select(*columns)])
        large = broadcast_within(large)
        split = materialize(members.join(large, "key").select("way", "word", "n"), f"forms-open-{depth}")
        ready.append(members.join(large, "key", "left_anti").select(*columns))
        rest = F.concat("way", F.substring("word", F.lit(1), F.lit(depth)), F.substring("word", F.lit(depth + 2), F.char_length("word")))
        longer = F.char_length("word") > depth
        keys = F.when(longer, F.array(rest, F.concat("way", "word"))).otherwise(F.array(F.concat("way", "word")))
        ready.append(split.select(F.explode(keys).alias("key"), F.lit(depth).alias("depth"), F.lit(True).alias("edited"), "word", "n"))
        opened, depth = split.where(longer), depth + 1


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def near_words(words: DataFrame, limit: int = PARTITION_WORDS) -> DataFrame:
    """word, n_near, form_n, form: near words of each word that has any, and the most frequent, smallest of them."""
    members = partitions(words, limit)
    # Words that agree in all the rest are few for each key, so pairs of them meet in the same tasks as the compositions.
    found = (members.repartition("key", "depth", "edited").sortWithinPartitions("key", "depth", "edited")
             .mapInArrow(_compose, NEAR))
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
            .select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form")))


def last_forms(forms: DataFrame, largest: int) -> DataFrame:
    """word, root: where the chain of forms of each word ends. Counts grow ``RATIO``-fold along a chain up to ``largest``."""
    roots = forms.select("word", F.col("form").alias("root"))
    steps = max(1.0, log10(max(largest, 1)) / log10(RATIO))
    for _ in range(ceil(log2(steps))):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = materialize(roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "forms-roots")
    return roots


def spelling_forms(docs: DataFrame, limit: int = PARTITION_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the vocabulary of ``docs``."""
    words = materialize(vocabulary(docs), "forms-words")
    near = near_words(words, limit)
    is_form = F.col("form_n") >= RATIO * F.col("n")
    known = materialize(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n")), "forms-near")
    largest = words.agg(F.max("n")).first()[0] or 1
    roots = last_forms(known.where(F.col("form").isNotNull()), largest)
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
