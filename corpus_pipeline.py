"""A training-data pipeline over documents: stages that each call one operator, written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; all but the last return the columns
of documents. SQL cannot express the classifier or the encoder, so ORACLE_SQL is None and tests hold run() against a
brute-force version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import host_rules, mixing, pieces, simhash, toxicity
from lodestar.llm.common import cut, remove, remove_at_exit, shared_dir, table
from lodestar.llm.queries import piece_model

ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model calls toxic go."""
    return toxicity.reject_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule, or a rule that their host has a verdict for, go."""
    return host_rules.reject_failed(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays: texts whose five-word shingles are alike to 0.8 or more."""
    return simhash.keep_one(docs, cut(simhash.near_copy_classes(docs)))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, or go, as their source's budget says."""
    return mixing.repeat_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with an end id, and a digest of what they decode to."""
    return pieces.encode_decode(docs, piece_model()).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality rules", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; what each returns is written to the shared folder and read again, and goes when the
    next is there. What the last returned is read lazily, so it goes when the driver ends.

    Rows of documents: null and empty texts are not toxic, but fail the quality rules, as they have no words. Null sources
    are one host and one source. Rows with null ids are never near copies of others and stay; of rows that repeat an id,
    one stays; near copies keep the least id. Very long texts are worked through whole. An empty table gives an empty
    result; further columns, of any name, pass through to the last stage, which returns ids and digests alone. Rows of
    labels with nulls are not read; without labels nothing is toxic.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
