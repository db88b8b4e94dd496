"""A training-data pipeline: quality rules, near-duplicates, decontamination, secrets, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import byte_bpe, decontaminate, quality_rules, secrets, shingles
from tessera.llm.queries import BYTE_RANKS, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the model is fitted on labelled rows of ``docs``."""
    return quality_rules.keep_documents(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word similarity of 0.8 or more, or fingerprints within two bits."""
    return shingles.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy, even an edited one, of a benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return secrets.redact_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with proof that they decode to its bytes."""
    return byte_bpe.encode_documents(docs, BYTE_RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("byte-level BPE", encode),
]

#: The rows cannot be said in SQL; tests/llm/test_pipeline.py recomputes them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, f in STAGES:
        docs = f(spark, docs, sf_dir)
    return docs
