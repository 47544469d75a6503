"""Alignment of the tokens of two tokenizers by vectorised merging in lockstep.

Both tokenizers cut the bytes of a space and the text. One state vector holds, for every document of a batch, the next
token of A and the next of B. A step compares the byte ends of both for all documents at once and moves on the pointer
of the smaller end, or both where they are equal: there the two tokens are a link and the document is cut. Documents
that are finished leave the vector. Documents of more than ``PART`` words stand in the vector once for each part of so many, as
both tokenizers cut there; so a long document does not hold up the others, and the steps are those of a part.

Links of two ids are counted over the corpus. Tokens that end together agree in their bytes, the shorter being the end of the
longer; so the id pairs that can be linked are at most the bytes of both vocabularies (about half a million), however large
the corpus, and their counts are sent to all tasks, which score the links of their documents.

A is a byte-level BPE of ``tokenizers``, B a SentencePiece model that puts a space in front. Special tokens are plain text.
A single space between two characters that are no white space starts a token in both: no pre-token of A reaches across its start, and no
piece of B has a space behind another character. So texts are encoded word by word, each with a space in front, and a worker
remembers the ids of a bounded number of words.
Defined results: a text that is null or empty, or whose tokens of A or B do not give back the bytes of space and text, has no
tokens: zeros and an empty digest. Rows with null or repeated doc_id are kept, one row out for each row in; an empty
table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwright.llm.common import bounded_batches, materialize

#: Characters of the documents that are aligned at once, and words that a worker remembers.
AT_ONCE, WORDS = 2 << 20, 300_000
#: Words of a part of a document, and of one call of an encoder.
PART, CALL = 64, 50
CUT, SPACED = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"^ |[^\S ] |  | $")
ID_BITS = 16


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable bytes stand for themselves, others follow from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def entries_a(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level BPE file."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    of, out = byte_alphabet(), [b""] * (1 + max(vocabulary.values()))
    for entry, k in vocabulary.items():
        out[k] = bytes(of[c] for c in entry) if all(c in of for c in entry) else entry.encode()
    return out


def piece_bytes(piece: str) -> bytes:
    return bytes([int(piece[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()


def words_of(text: str) -> list[str]:
    """A text cut at spaces that start a token in both tokenizers."""
    return CUT.split(text) if SPACED.search(text) else text.split(" ")


class Side:
    """A tokenizer: the bytes of its ids, their lengths, its encoder, and the ids of the words met so far."""

    def __init__(self, entries: list[bytes], encode):
        if max(len(entries), 1) > 1 << ID_BITS:
            raise ValueError(f"ids must fit {ID_BITS} bits")
        self.entries, self.encode = entries, encode
        self.lengths = np.array([len(e) for e in entries], np.int64)
        self.texts = {mark: np.array([f"{k}{mark}" for k in range(len(entries))], object) for mark in ",|;"}
        self.forget()

    def forget(self) -> None:
        self.ids, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, words: list[str]) -> np.ndarray:
        """Keep the ids of further words; whether they give back the bytes of a space and the word."""
        alone = [w == "" or w[0].isspace() or w[-1].isspace() for w in words]
        bare = [w for w, x in zip(words, alone) if not x]
        lines = [" ".join(bare[k:k + CALL]) for k in range(0, len(bare), CALL)]
        ids = self._encoded(lines)
        stops = np.cumsum([len(w.encode()) + 1 for w in bare], dtype=np.int64)
        ends = np.cumsum(self.lengths[ids])
        if self._bytes(ids) == b"".join(f" {x}".encode() for x in lines) and np.isin(stops, ends).all():
            counts = np.diff(np.searchsorted(ends, stops, side="right"), prepend=0)
        else:
            alone, ids, counts = [True] * len(words), np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = [np.array(f, np.int64) for f in self.encode([w for w, x in zip(words, alone) if x])]
        alone = np.array(alone, bool)
        per_word = np.zeros(len(words), np.int64)
        per_word[~alone], per_word[alone] = counts, [len(f) for f in found]
        good = np.ones(len(words), bool)
        good[alone] = [self._bytes(f) == f" {words[k]}".encode() for k, f in zip(np.flatnonzero(alone), found)]
        stored = np.concatenate([ids, *found])
        order = np.argsort(np.repeat(np.concatenate([np.flatnonzero(~alone), np.flatnonzero(alone)]),
                                     np.concatenate([counts, per_word[alone]])), kind="stable")
        self.ids, self.counts = np.concatenate([self.ids, stored[order]]), np.concatenate([self.counts, per_word])
        return good

    def _encoded(self, texts: list[str]) -> np.ndarray:
        return np.array(list(chain.from_iterable(self.encode(texts))), np.int64)

    def _bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.entries.__getitem__, ids.tolist()))

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered words in turn, and how many each has."""
        counts = self.counts[words]
        starts = (np.cumsum(self.counts) - self.counts)[words]
        return self.ids[np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())], counts


class Pair:
    """Both tokenizers and the numbers of the words whose ids they have."""

    def __init__(self, a: Side, b: Side, words: int = WORDS):
        self.a, self.b, self.words = a, b, words
        self.numbers: dict[str, int] = {}
        self.good = np.zeros(0, bool)

    def numbered(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The words of all texts that have tokens, as numbers in turn, and how many words each text has."""
        if len(self.numbers) > self.words:
            self.numbers, self.good = {}, np.zeros(0, bool)
            self.a.forget()
            self.b.forget()
        cut = [words_of(t) if t else [] for t in texts]
        known = self.numbers
        new = list(set().union(*cut).difference(known))
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self.good = np.concatenate([self.good, self.a.learn(new) & self.b.learn(new)])
        counts = np.array([len(words) for words in cut], np.int64)
        numbers = np.array(list(map(known.__getitem__, chain.from_iterable(cut))), np.int64)
        whole, stops = np.ones(len(texts), bool), np.cumsum(counts)
        for k in set(np.searchsorted(stops, np.flatnonzero(~self.good[numbers]), side="right")):
            words = numbers[stops[k] - counts[k]:stops[k]]
            whole[k] = all(side._bytes(side.of(words)[0]) == f" {texts[k]}".encode() for side in (self.a, self.b))
        return numbers[np.repeat(whole, counts)], np.where(whole, counts, 0)


@lru_cache(maxsize=2)
def tokenizers_of(path_a: str, path_b: str, words: int = WORDS) -> Pair:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    pieces = [b.id_to_piece(k) for k in range(b.vocab_size())]
    if any("▁" in p.lstrip("▁") for p in pieces):
        raise ValueError("a piece has a space behind another character")
    return Pair(Side(entries_a(path_a), lambda words: [x.ids for x in a.encode_batch_fast([f" {w}" for w in words], add_special_tokens=False)]),
                Side([piece_bytes(p) for p in pieces], lambda words: b.encode(words, num_threads=1)), words)


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, stops_a: np.ndarray, stops_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions of the tokens of A and B that end together, in the order of the documents.

    ``ends`` are byte offsets of the tokens of all documents in turn, ``stops`` the end of each document among the tokens.
    """
    at_a, at_b = stops_a - np.diff(stops_a, prepend=0), stops_b - np.diff(stops_b, prepend=0)
    links_a, links_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    is_open = (at_a < stops_a) & (at_b < stops_b)
    while True:
        if not is_open.all():  # finished documents leave the vector
            at_a, at_b, stops_a, stops_b = at_a[is_open], at_b[is_open], stops_a[is_open], stops_b[is_open]
        if not len(at_a):
            break
        end_a, end_b = ends_a[at_a], ends_b[at_b]
        same = end_a == end_b
        links_a.append(at_a[same])
        links_b.append(at_b[same])
        at_a = at_a + (end_a <= end_b)
        at_b = at_b + (end_b <= end_a)
        is_open = (at_a < stops_a) & (at_b < stops_b)
    found_a, found_b = np.concatenate(links_a), np.concatenate(links_b)
    order = np.argsort(found_a, kind="stable")
    return found_a[order], found_b[order]


def _flat(side: Side, words: np.ndarray, per_text: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ids of all texts in turn, the byte offsets of their ends within their text, the stops of the texts and of their parts."""
    ids, per_word = side.of(words)
    upto = np.concatenate([[0], np.cumsum(per_word)])
    stops = upto[np.cumsum(per_text)]
    total = np.concatenate([[0], np.cumsum(side.lengths[ids])])
    counts = np.diff(stops, prepend=0)
    return ids, total[1:] - np.repeat(total[stops - counts], counts), stops, upto[parts]


def _parts(per_text: np.ndarray) -> np.ndarray:
    """Numbers of words up to the end of each part of ``PART`` words of a text."""
    stops = np.cumsum(per_text)
    place = np.arange(1, per_text.sum() + 1)
    within = place - np.repeat(stops - per_text, per_text)
    return place[(within % PART == 0) | (within == np.repeat(per_text, per_text))]


def align(texts: list[str | None], pair: Pair) -> list[tuple[int, int, str, np.ndarray]]:
    """(tokens of A, tokens of B, digest of the groups, linked id pairs) of each text."""
    a, b = pair.a, pair.b
    words, per_text = pair.numbered(texts)
    parts = _parts(per_text)
    flat_a, ends_a, stops_a, parts_a = _flat(a, words, per_text, parts)
    flat_b, ends_b, stops_b, parts_b = _flat(b, words, per_text, parts)
    links_a, links_b = lockstep(ends_a, ends_b, parts_a, parts_b)

    # One row of texts for all documents: a group's ids of A, then those of B, each with the mark that follows it.
    texts_a, texts_b = a.texts[","][flat_a], b.texts[","][flat_b]
    texts_a[links_a], texts_b[links_b] = a.texts["|"][flat_a[links_a]], b.texts[";"][flat_b[links_b]]
    group_a = np.searchsorted(links_a, np.arange(len(flat_a)))
    group_b = np.searchsorted(links_b, np.arange(len(flat_b)))
    order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
    marked = np.concatenate([texts_a, texts_b])[order]
    pairs = flat_a[links_a] << ID_BITS | flat_b[links_b]
    of_doc = np.searchsorted(links_a, stops_a)
    all_a, all_b = np.diff(stops_a, prepend=0).tolist(), np.diff(stops_b, prepend=0).tolist()

    out, start, token = [], 0, 0
    for k, (n_a, n_b) in enumerate(zip(all_a, all_b)):
        groups = "".join(marked[token:token + n_a + n_b])[:-1]
        token += n_a + n_b
        out.append((n_a, n_b, hashlib.sha256(groups.encode()).hexdigest() if n_a else "", pairs[start:of_doc[k]]))
        start = of_doc[k]
    return out


def _grouped(texts: list[str | None], size: int) -> Iterator[list[str | None]]:
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t or "")
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


ALIGNED = "doc_id {}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<long>"


def aligned(docs: DataFrame, path_a: str, path_b: str, words: int = WORDS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and the linked id pairs (A's id above B's) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizers_of(path_a, path_b, words)
        for batch in batches:
            found = [x for part in _grouped(batch.column(1).to_pylist(), AT_ONCE) for x in align(part, pair)]
            counts = [len(x[3]) for x in found]
            links = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()),
                                             pa.array(np.concatenate([np.zeros(0, np.int64), *(x[3] for x in found)])))
            columns = [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, pa.array(counts, pa.int64()), pa.array(counts, pa.int64()),
                 pa.array([x[2] for x in found], pa.string()), links],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])

    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, ALIGNED.format(rows.schema["doc_id"].dataType.simpleString()))


def link_counts(rows: DataFrame) -> DataFrame:
    """pair, n, best: how many links hold an id pair, and whether no pair with that id of B is held by more."""
    counts = rows.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1)))
    return counts.withColumn("best", F.col("n") == F.max("n").over(of_b))


def align_tokens(docs: DataFrame, path_a: str, path_b: str, words: int = WORDS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
    spark = docs.sparkSession
    rows = materialize(aligned(docs, path_a, path_b, words), "alignment")
    # At most the bytes of both vocabularies: see above.
    table = link_counts(rows).toArrow().sort_by("pair")
    counted = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = counted.value
        for batch in batches:
            links = batch.column(batch.schema.names.index("links"))
            stops = np.cumsum(batch.column(batch.schema.names.index("n_links")).to_numpy())
            at = np.searchsorted(pairs, links.flatten().to_numpy(zero_copy_only=False))
            sums = [np.concatenate([[0], np.cumsum(x[at], dtype=np.int64)])[np.concatenate([[0], stops])] for x in (best, n)]
            columns = [batch.column(k) for k in range(5)] + [pa.array(np.diff(s)) for s in sums] + [batch.column(5)]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, ", ".join(f"{c} long" if 0 < k < 7 else f"{c} string" if k else f"{c} {kind}" for k, c in enumerate(names)))
