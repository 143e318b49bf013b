"""Corpus pipeline: quality rules, exact dedup, near dedup, mixing and packing, stage after stage.

Each stage takes and - but for the last - returns the columns of documents, and works on all rows that the one before
it kept. run() writes each stage's result in the folder that all executors share and reads it back. A stage first removes
the tables that earlier stages made there for themselves, but for those that its own input still reads; so the disk holds
one stage's tables at a time.

For every stage: a null text is empty; rows are judged one by one, also where they share a doc_id or have none; an empty
table gives an empty result; further columns, whatever their names, are carried to the last stage. A very long text is held whole by one task at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import FIRST, LAST, bounded, release, scratch, with_row_keys, written
from lectern.llm.exact_dedup import exact_duplicates
from lectern.llm.mixing import mix
from lectern.llm.near_dedup import jaccard_classes
from lectern.llm.packing import pack
from lectern.llm.quality import quality

#: SQL can't express the near-duplicate classes and the packing; tests hold run() against brute force instead.
ORACLE_SQL = None

#: Column of the row keys within a dedup stage, and the owners of stages' own tables and of their results.
ROW, OWNER, RESULT = "__row_key", "pipeline", "pipeline result"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(work: Stage) -> Stage:
    """work with the tables of earlier stages removed first."""

    @wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with scratch(spark, OWNER, docs):
            return work(spark, docs, sf_dir)

    return run


def _without(spark: SparkSession, keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """keyed (rows with their key in ROW) without the rows whose keys are in gone, which is broadcast as long as 64 MB hold it."""
    gone = written(spark, gone)
    return keyed.join(bounded(gone, gone.count(), 32), ROW, "left_anti").drop(ROW)


@_stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and lie near the distributions of their language; equal rows fare alike. Without words: rejected."""
    return quality(docs, *docs.columns).filter("kept").select("row.*")


@_stage
def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, of the largest doc_id; a null doc_id is smaller than any other."""
    keyed = with_row_keys(docs, ROW, FIRST)
    found = exact_duplicates(spark, keyed.select(F.col(ROW).alias("doc_id"), "text"))
    return _without(spark, keyed, found.filter("NOT kept").select(F.col("doc_id").alias(ROW)))


@_stage
def distinct_contents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates (five-word shingles, similarity of 0.8 or more), of the smallest doc_id; a null doc_id is the largest."""
    keyed = with_row_keys(docs, ROW, LAST)
    found = jaccard_classes(spark, keyed.select(F.col(ROW).alias("doc_id"), "text"), n=5, percent=80)
    return _without(spark, keyed, found.filter("NOT doc_id <=> component_id").select(F.coalesce("doc_id", F.lit(LAST)).alias(ROW)))


@_stage
def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by their weights, documents as often as the mix takes them, shard after shard. A null source is one of its own; equal rows are taken alike."""
    return mix(spark, docs)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens along the curve; a repeated row is packed as often as it occurs, an empty text as its closing token."""
    return pack(spark, docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", good_quality),
    ("exact dedup", distinct_texts),
    ("n-gram Jaccard join", distinct_contents),
    ("mixing sources to target weights", mixed_sources),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. The last one is lazy and reads the result of the one before it, which stays until the next run."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            with scratch(spark, RESULT, docs):  # only what docs reads is left of the results so far
                docs = written(spark, docs)
    release(spark, RESULT, docs)
    return docs
