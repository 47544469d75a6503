"""The registered queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foldwright.llm import url_models
from foldwright.llm.common import table
from foldwright.llm.count_rtree import components
from foldwright.llm.learned_partitions import search
from foldwright.llm.minimax_shards import minimax_shards
from foldwright.llm.role_repair import repair
from foldwright.llm.semantic_votes import quality
from foldwright.llm.spelling_forms import spelling_forms
from foldwright.llm.surrogates import replaced
from foldwright.llm.tag_paths import extract
from foldwright.llm.templates import leaks
from foldwright.llm.token_alignment import align_tokens
from foldwright.llm.two_tier_bpe import encode_decode_digests
from foldwright.llm.warc_zstd import round_trip

RANKS = "byte_bpe_multi_50k.tiktoken"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op3_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replaced(table(spark, sf_dir, "documents").select("doc_id", "text"), counted="mentions")


def op4_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_semantic_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


def op7_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


def op8_two_tier_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS),
                                 public_tokenizers.PATTERN)


def op9_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimax_shards(table(spark, sf_dir, "documents"), 24)


def op10_count_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"), 3, 90)


def op11_composed_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(table(spark, sf_dir, "documents"))


def op12_lockstep_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(PIECES))


def op13_url_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_models.judge_urls(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op13_url_models": url_models.twin()}
