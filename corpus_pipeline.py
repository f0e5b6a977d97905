"""The corpus pipeline: toxic documents go, then copies, then near copies; sources are mixed, and the mix is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usage_audit.llm import common, dedup, mixing, ngrams, packing, tokens, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows of `docs`, doesn't reject."""
    return toxicity.without_toxic(spark, docs, sf_dir)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id."""
    judged = dedup.exact_duplicates(spark, docs).filter("group_size > 1")
    key = F.xxhash64(F.col("doc_id").cast("long"), F.sha2(common.normalised(F.col("text")), 256))
    decided = judged.groupBy(F.xxhash64("doc_id", "text_sha256").alias("h")).agg(F.bool_or("kept").alias("keep"))
    decided = common.staged(decided, "decided")
    return common.keep_decided(docs, key, decided, decided.count())


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the row with the smallest doc_id; if none has one, the row of the smallest hash."""
    classes = ngrams.jaccard_classes(spark, docs).filter("links > 0")
    key = F.xxhash64(F.col("doc_id").cast("long"), F.lower(F.coalesce(F.col("text"), F.lit(""))))
    first = classes.filter("class_id is null").groupBy("class_key").agg(F.min("row").alias("first"))
    stays = F.coalesce(F.col("doc_id") == F.col("class_id"), F.col("row") == F.col("first"), F.lit(False))
    decided = classes.join(first, "class_key", "left").groupBy(F.col("row").alias("h")).agg(F.bool_or(stays).alias("keep"))
    decided = common.staged(decided, "decided")
    return common.keep_decided(docs, key, decided, decided.count())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of its source takes it."""
    return mixing.repeated(spark, docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return packing.pack(spark, docs, 1024, tokens.vocabulary_dir(), digest=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Training, hashing and retrieval have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
