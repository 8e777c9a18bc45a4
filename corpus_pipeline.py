"""A training corpus from raw documents: five stages, each by one operator of pagestrata.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

1. language: documents without a recognisable language go (no letter at all, a score below 0.2, which takes
   more languages than two a family, or n-grams too unlike those of the language told).
2. lines: boilerplate lines, which recur over documents, are cut out of the texts. Copies count as one document, so they
   keep their own lines for the next stage. A document may lose all its lines; it stays, empty.
3. near_duplicates: of each group of documents linked by shingle similarity one stays, the one with the
   smallest doc_id; documents without words are no one's duplicate and stay.
4. decontamination: documents that hold a benchmark item go.
5. packing: what is left is cut into token sequences.

Defined results: a null text has no language and goes with the first stage, and so does an empty one; nulls in other columns
are carried along; of repeated rows of a group one stays; of several rows with the smallest doc_id of a group, the one
with the smallest hash of its text; documents without doc_id come last; texts of any length are read whole; empty tables give an
empty result; further columns, also with clashing names, are dropped by the first stage.
"""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.llm.common import DOCUMENT_COLUMNS, cleared, light, pick, read, saved
from pagestrata.llm.op1_lines import without_boilerplate
from pagestrata.llm.op3_leaks import BROADCAST_TEXTS, leaks
from pagestrata.llm.op6_language import UNKNOWN, languages
from pagestrata.llm.op8_packing import packed
from pagestrata.llm.op9_jaccard import is_marked, jaccard_components, row_of

MIN_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    told = languages(docs, keep=DOCUMENT_COLUMNS, far=True)
    return told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE) & (F.col("far") <= 1)).select(*DOCUMENT_COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = without_boilerplate(docs, keep=DOCUMENT_COLUMNS)
    length = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", length).select(*DOCUMENT_COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = saved(jaccard_components(docs), "groups")
    cleared(spark)  # the join's shuffles go before texts are dealt out
    chosen = rows.where("`group` IS NOT NULL").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("of")).select("of.doc_id", "of.text_key")
    chosen = chosen.select(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_"))
    times = rows.groupBy("doc_id", "text_key").agg(F.count("*").alias("times"), F.max(F.col("group").isNull()).alias("alone"))
    told = times.join(chosen, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_key") == F.col("key_")), "left").select(F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key"), (F.col("key_").isNotNull() | F.col("alone")).alias("stays"), (~F.col("alone") & (F.col("times") > 1)).alias("repeated"))
    # what isn't marked stays where it lies; only what goes, what is repeated and a few others are dealt out
    keyed = pick(docs, *DOCUMENT_COLUMNS).withColumn("text_key", F.xxhash64("text"))
    asked = is_marked(told.where("NOT stays OR repeated").select(row_of("own_key", "own_id")))(row_of("text_key", "doc_id"))
    met = keyed.where(asked).join(told.where("stays"), F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_key")))
    once = met.where("repeated").dropDuplicates(["doc_id", "text_key"])
    parts = (keyed.where(~asked), met.where("NOT repeated"), once)
    return reduce(DataFrame.unionByName, (p.select(*DOCUMENT_COLUMNS) for p in parts))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = saved(leaks(docs, read(spark, sf_dir, "benchmark")).select("text_key").distinct(), "leaking")
    keyed = pick(docs, *DOCUMENT_COLUMNS).withColumn("text_key", F.xxhash64("text"))
    return keyed.join(light(found, BROADCAST_TEXTS), "text_key", "left_anti").select(*DOCUMENT_COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage makes is written to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages learn, count and tokenize in ways that SQL doesn't express.
ORACLE_SQL = None
