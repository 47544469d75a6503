"""Clean a corpus: the stages in order, each a function of (spark, docs, sf_dir) over all that its predecessor kept.

A stage's result is written as Parquet and read again as the next one's documents. All but the last return the columns
of documents. SQL cannot express the stages, so ``ORACLE_SQL`` is None and tests hold them against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foldwright.llm import semantic_votes, surrogates, templates, two_tier_bpe
from foldwright.llm.common import materialize, table
from foldwright.llm.count_rtree import one_of_each

#: Shingles of near copies in words, and the percentage of their union that near copies share.
WORDS, PERCENT = 5, 80
RANKS = "byte_bpe_multi_50k.tiktoken"


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts."""
    return semantic_votes.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id."""
    return one_of_each(docs, WORDS, PERCENT)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return templates.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data in their texts."""
    return surrogates.replaced(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the token ids of each document."""
    return two_tier_bpe.encode_decode_digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", accept_quality), ("near_copies", drop_near_copies), ("benchmark", drop_benchmark_leaks),
    ("personal_data", replace_personal_data), ("tokens", tokenise)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
