"""Corpus pipeline: from raw documents to packed training sequences.

Each stage works on the table that its predecessor kept, read back from Parquet. All stages but the last return
the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tersus.llm.common import read_table, written
from tersus.llm.exact_dedup import drop_copies
from tersus.llm.packing import pack_documents
from tersus.llm.quality import keep_good
from tersus.llm.simhash import drop_near_copies
from tersus.llm.toxicity import keep_clean


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"), "quality", threshold=0.3)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5."""
    return keep_clean(docs, read_table(spark, sf_dir, "labels"), "toxic", threshold=0.5)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash (3-word shingles, at most 2 bits), the one with the smallest id."""
    return drop_near_copies(docs, shingle_words=3, max_bits=2)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of the remaining documents with their places in sequences of 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES = [("quality classifier", quality), ("toxicity", toxicity), ("exact dedup", exact_dedup),
          ("simhash near-dedup", near_dedup), ("best-fit packing", packing)]

#: Trained classifiers, fingerprints and tokenizers are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
