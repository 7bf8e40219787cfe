"""A corpus pipeline: from raw documents to token ids, in five stages.

Each stage takes all documents its predecessor kept, is written as Parquet in the shared folder and read again. All
but the last return the columns of documents. A null text is an empty text to the stages and stays null in the rows they keep; rows that repeat are judged each, but for
near-duplicates, of which one row stays; null ids are kept; empty tables pass through; columns besides id and text are left alone whatever their names, but for
n_chars, which follows the text. Texts of any length are handled whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitflow.llm import bpe, decontamination, near_dedup, pii, quality_classifier
from unitflow.llm.shared import materialize, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under a model of trusted text is within the limit of their language."""
    return quality_classifier.keep(docs, read(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontamination.remove(docs, read(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data."""
    out = pii.replace(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed, little-endian uint32) and the text that decoding them gives."""
    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), decoded=True)
    return out.select("doc_id", "n_tokens", "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [("quality_classifier", quality), ("near_dedup", dedup), ("decontamination", decontaminate), ("pii", private), ("byte_bpe", encode)]

#: Sampling, language models and merges are beyond SQL; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
