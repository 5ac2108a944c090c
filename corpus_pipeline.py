"""A corpus pipeline: each stage works on all documents that the one before kept.

Language ID, near duplicates, benchmark decontamination, personal data, byte-level BPE. A stage
takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's documents. All but the last return the columns of ``documents``.

Rows are told apart by id and text, so repeated ids and null ids are handled; extra columns of
the input are dropped by the first stage. Null texts and texts without a letter go in the first
stage. An empty table passes all stages empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.llm.bpe import decode_ids, encode_texts
from tabscope.llm.common import fold, stored, table
from tabscope.llm.decontaminate import contamination
from tabscope.llm.jaccard import jaccard_components
from tabscope.llm.language import UNKNOWN, fit, identify
from tabscope.llm.pii import pseudonymise
from tabscope.llm.queries import pii_key

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose largest language has a smaller share than this has no language of its own.
LEAST_SHARE = 0.5


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``key``: id (null last) and a hash of the text."""
    return docs.withColumn("key", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts of no language: undetermined, or a mixture in which none has half."""
    model = fit(docs, fold("doc_id", 5) != 0)
    found = identify(docs, *model, keep=COLUMNS[1:])
    # not the score: of a text in one language it is the posterior over languages alike
    share = F.array_max(F.map_values("mixture"))
    return found.where((F.col("lang_pred") != UNKNOWN) & (share >= LEAST_SHARE)).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group."""
    rows = keyed(docs)
    found = jaccard_components(rows, id_col="key")
    kept = stored(found.where(F.col("key") == F.col("component_id")).groupBy("key").agg(F.count("*").alias("n")))
    once = rows.join(kept.where("n = 1").select("key"), "key", "leftsemi")
    # equal rows of one id: one of them stays
    repeated = rows.join(kept.where("n > 1").select("key"), "key", "leftsemi").dropDuplicates(["key"])
    return once.unionByName(repeated).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with words of a benchmark passage."""
    rows = keyed(docs)
    hit = contamination(rows, table(spark, sf_dir, "benchmark"), id_col="key").where("n_hit > 0").select("key")
    return rows.join(hit, "key", "leftanti").select(COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts."""
    found = pseudonymise(docs.select(COLUMNS), pii_key(spark))
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the text decoded from them."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = decode_ids(encode_texts(docs, ranks, public_tokenizers.PATTERN), ranks)
    return ids.select("doc_id", F.col("decoded").cast("string").alias("text"), "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("byte_bpe", byte_bpe),
]

#: Language mixtures, keyed pseudonyms and merges have no SQL form; tests/llm/test_pipeline.py
#: holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
