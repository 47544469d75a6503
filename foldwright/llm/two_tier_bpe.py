"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest.

A pre-token that is in the vocabulary is one id: a hash-and-displace function sends every vocabulary entry to its own
slot of a table without gaps, and one comparison tells whether the pre-token is that entry. Any other pre-token is cut
into bytes on a linked list; a heap yields the adjacent pair of lowest rank, leftmost first, until no pair is an entry.
Ids of a pre-token are kept in a cache of bounded size in each Python worker, so that a word is merged once and not once
for each time it occurs. Decoding concatenates the bytes of the ids.

The vocabulary is a rank file (base64 entry, rank); the driver reads it and sends it to the executors with the seeds of
the hash, a size that does not depend on the data.

Defined results: a null text is an empty one, with no ids; texts are handled whole whatever their length; repeated rows
are encoded each; an empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from foldwright.llm.common import bounded_batches

#: Pre-tokens whose ids a worker remembers, and the longest that it does.
CACHE_ENTRIES, CACHED_LENGTH = 600_000, 64
#: Vocabulary entries that share a seed, on average.
PER_BUCKET = 3


def read_ranks(path: str) -> list[bytes]:
    """The entries of a rank file in the order of their ranks, which must have no gaps."""
    with open(path, "rb") as lines:
        ranked = [line.split() for line in lines if line.strip()]
    entries = [b""] * len(ranked)
    for entry, rank in ranked:
        entries[int(rank)] = base64.b64decode(entry)
    if not all(entries) or len(set(entries)) != len(entries):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps, entries distinct")
    return entries


def _hash(key: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(key, seed)


class PerfectHash:
    """A minimal perfect hash of ``keys``: a seed for each bucket, such that every key has a slot of its own."""

    def __init__(self, keys: list[bytes]):
        self.size, self.buckets = len(keys), max(1, -(-len(keys) // PER_BUCKET))
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for k, key in enumerate(keys):
            members[_hash(key, 0) % self.buckets].append(k)
        self.seeds = [0] * self.buckets
        self.slots = [-1] * self.size
        for bucket in sorted(range(self.buckets), key=lambda b: (-len(members[b]), b)):
            seed = 0
            while len(members[bucket]) > 1:
                seed += 1
                taken = [_hash(keys[k], seed) % self.size for k in members[bucket]]
                if len(set(taken)) == len(taken) and all(self.slots[s] < 0 for s in taken):
                    self.seeds[bucket] = seed
                    for k, s in zip(members[bucket], taken):
                        self.slots[s] = k
                    break
        free = iter([s for s, k in enumerate(self.slots) if k < 0])
        for bucket, alone in enumerate(members):
            if len(alone) == 1:  # a key alone in its bucket takes any slot, which stands in the seed's place
                slot = next(free)
                self.seeds[bucket], self.slots[slot] = -1 - slot, alone[0]

    def __call__(self, key: bytes) -> int:
        """The number of the only key that ``key`` can be."""
        seed = self.seeds[_hash(key, 0) % self.buckets]
        return self.slots[_hash(key, seed) % self.size if seed >= 0 else -1 - seed]


class Codec:
    def __init__(self, pattern: str, entries: list[bytes], whole: PerfectHash):
        self.find = regex.compile(pattern).findall
        self.entries, self.whole = entries, whole
        self.ranks = {e: k for k, e in enumerate(entries)}
        self.cache: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece that is no entry: join the adjacent pair of lowest rank until none is an entry."""
        n, rank, entries = len(piece), self.ranks.get, self.entries
        end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, k) for k in range(n - 1) if (r := rank(piece[k:k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            after = right[k]
            if end[k] < 0 or after >= n or entries[r] != piece[k:end[after]]:
                continue  # a part of the pair has been joined to another since
            end[k], right[k] = end[after], right[after]
            end[after] = -1
            if right[k] < n:
                left[right[k]] = k
                if (r := rank(piece[k:end[right[k]]])) is not None:
                    heapq.heappush(heap, (r, k))
            if left[k] >= 0 and (r := rank(piece[left[k]:end[k]])) is not None:
                heapq.heappush(heap, (r, left[k]))
        ids, k = [], 0
        while k < n:
            ids.append(self.ranks[piece[k:end[k]]])
            k = right[k]
        return ids

    def packed(self, word: str) -> bytes:
        """Ids of a pre-token as little-endian 32-bit integers."""
        piece = word.encode()
        k = self.whole(piece)
        ids = [k] if self.entries[k] == piece else self.merge(piece)
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= CACHED_LENGTH:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[word] = out
        return out

    def encode(self, text: str) -> bytes:
        words = self.find(text)
        out = list(map(self.cache.get, words))
        if None in out:
            out = [ids or self.packed(word) for ids, word in zip(out, words)]
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.entries.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def _codec(pattern: str, joined: bytes, lengths: tuple[int, ...], seeds: tuple[int, ...], slots: tuple[int, ...]) -> Codec:
    ends = np.cumsum(lengths).tolist()
    entries = [joined[e - n:e] for e, n in zip(ends, lengths)]
    whole = PerfectHash.__new__(PerfectHash)
    whole.size, whole.buckets, whole.seeds, whole.slots = len(entries), len(seeds), list(seeds), list(slots)
    return Codec(pattern, entries, whole)


def encode_decode(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded of every row of ``docs`` (doc_id, text); ids as little-endian 32-bit integers."""
    return _coded(docs, rank_path, pattern, ["doc_id", "n_tokens", "ids", "decoded"])


def encode_decode_digests(docs: DataFrame, rank_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs``, and the ids if wanted."""
    return _coded(docs, rank_path, pattern, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])


KINDS = {"doc_id": ("long", pa.int64()), "n_tokens": ("long", pa.int64()), "ids": ("binary", pa.binary()),
         "decoded": ("binary", pa.binary()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}


def _coded(docs: DataFrame, rank_path: str, pattern: str, wanted: list[str]) -> DataFrame:
    spark = docs.sparkSession
    bounded_batches(spark)
    entries = read_ranks(rank_path)
    whole = PerfectHash(entries)
    shared = spark.sparkContext.broadcast((pattern, b"".join(entries), tuple(map(len, entries)), tuple(whole.seeds),
                                           tuple(whole.slots)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*shared.value)
        for batch in batches:
            out: dict[str, list] = {name: [] for name in wanted}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = codec.encode(text.as_py() or "")
                back = codec.decode(ids)
                row = {"doc_id": doc_id, "n_tokens": len(ids) // 4, "ids": ids, "decoded": back,
                       "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256(back).hexdigest()}
                for name in wanted:
                    out[name].append(row[name])
            yield pa.RecordBatch.from_arrays([pa.array(out[n], KINDS[n][1]) for n in wanted], names=wanted)

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{n} {KINDS[n][0]}" for n in wanted))
