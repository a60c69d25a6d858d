"""From raw documents to token ids: classify, clean, deduplicate, mix and encode.

Each stage takes what its predecessor kept, written as Parquet and read again; all but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyarc.llm import bpe, mixing, near_dedup, quality_model, quality_rules
from tallyarc.llm.common import stored, table
from tallyarc.llm.queries import byte_bpe


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"))


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep_clean(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.keep_first(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document may come twice."""
    return mixing.mix(docs)


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's ids, and the digest of what they decode to."""
    return bpe.digests(docs, *byte_bpe(), chars=3_000_000)  # smaller batches than alone: executors still hold memory of the stages before


STAGES = [
    ("quality_classifier", good_documents),
    ("quality_rules", clean_documents),
    ("near_duplicates", distinct_documents),
    ("mixing", mixed_documents),
    ("byte_bpe", encoded_documents),
]

#: No SQL text: models, hashes and seeded draws have none; tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
