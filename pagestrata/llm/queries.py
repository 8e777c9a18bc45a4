"""The queries of this subpackage: each applies one operator to its whole table, and gives the contract's digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, read
from .oracles import ORACLE_SQL  # noqa: F401
from .op1_lines import without_boilerplate
from .op2_vectors import near_vectors
from .op3_leaks import leaks
from .op4_warc import warc_round_trip
from .op5_tokens import token_counts
from .op6_language import languages
from .op7_secrets import secret_spans
from .op8_packing import packed
from .op9_jaccard import jaccard_components
from .op10_chat import formatted_chats


def op1_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_boilerplate(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", "dropped", F.char_length("text").alias("kept_chars"), F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_key")


def op4_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(read(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(read(spark, sf_dir, "documents"))


def op7_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(read(spark, sf_dir, "documents"))


def op8_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    turns = pick(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").unionByName(more)
    return formatted_chats(turns, public_tokenizers.path("byte_bpe_50k.json")).drop("formatted", "n_tokens", "loss_tokens")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_templates": op1_line_templates,
    "op2_near_vectors": op2_near_vectors,
    "op3_benchmark_leaks": op3_benchmark_leaks,
    "op4_warc_bundles": op4_warc_bundles,
    "op5_token_counts": op5_token_counts,
    "op6_languages": op6_languages,
    "op7_secret_spans": op7_secret_spans,
    "op8_packed_sequences": op8_packed_sequences,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_chat_masks": op10_chat_masks,
}
