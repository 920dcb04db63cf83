"""The corpus pipeline: documents through quality, near-dedup, mixing and encoding.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns a DataFrame that is written as
Parquet and read again as the next one's docs.  All but the last return the columns of documents.

Defined results: null and empty texts are scored like any other; a document without words is near nothing and stays
unless its score is low; rows are told apart by a number of their own, so that rows with one doc_id and different texts
are different documents and of equal rows with words one stays; rows without a doc_id take part; a document that the mix
takes e times comes e times; texts are read whole; an empty table gives empty stages; extra columns of any name and type
travel along.

Memory: the stages set spark.sql.execution.arrow.maxBytesPerBatch to 2 MB for the session, so that Spark and a Python
worker hold a few texts at a time; a worker that leaves the encoder drops its piece tables.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postern.llm import common as C, op5_mix, op6_near_dup, op7_quality, op8_sentencepiece


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold go."""
    C.small_batches(spark)
    return op7_quality.keep_good(docs, op7_quality.fit(docs, C.table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies stays."""
    C.small_batches(spark)
    return op6_near_dup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return op5_mix.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces (ids of the n best), scores and digests of what the mix holds."""
    C.small_batches(spark)
    return op8_sentencepiece.encode(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("mix", mix), ("encode", encode)]
#: SQL cannot express trained trees or a piece lattice; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
