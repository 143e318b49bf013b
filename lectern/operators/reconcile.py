"""Consistency of documents, versions, chunks and vectors, set by set instead of row by row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROCESSING = ("UPLOADED", "PARSING", "CHUNKED", "EMBEDDING")


def facts(versions: DataFrame, documents: DataFrame, chunk_counts: DataFrame, vector_counts: DataFrame, live_jobs: DataFrame) -> DataFrame:
    """FIL-15: one row a version with its document's state and counts: each side is summed up before the join. document_vectors: active ones of all its versions."""
    docs = documents.select(F.col("id").alias("document_id"), F.col("status").alias("document_status"), "current_version_id")
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = versions.join(docs, "document_id").join(chunk_counts, versions["id"] == chunk_counts["version_id"], "left").drop("version_id")
    rows = rows.join(vector_counts, rows["id"] == vector_counts["version_id"], "left").drop("version_id").join(live_jobs.select(F.col("version_id").alias("id"), F.lit(True).alias("live_job")), "id", "left")
    every = versions.select(F.col("id").alias("version_id"), "document_id").join(vector_counts, "version_id").groupBy("document_id").agg(F.sum("active_vectors").alias("document_vectors"))
    rows = rows.join(every, "document_id", "left").withColumn("document_vectors", zero("document_vectors"))
    return rows.withColumns({"chunk_count": zero("chunk_count"), "active_vectors": zero("active_vectors"), "model_vectors": zero("model_vectors"), "all_vectors": zero("all_vectors"), "live_job": F.coalesce("live_job", F.lit(False)), "is_current": F.col("current_version_id").eqNullSafe(F.col("id"))})


def inspect(rows: DataFrame, stalled_minutes: int = 60) -> DataFrame:
    """STR-09: version_id, issue, severity, repairable: every rule that a version breaks, in one pass over facts()."""
    c = F.col
    busy, short = c("status").isin(*PROCESSING), c("chunk_count") > c("active_vectors")
    vectors = (c("status") == "INDEXED") & c("is_current") & (c("document_status") != "DELETED") & short
    other = (c("model_vectors") == 0) & (c("all_vectors") >= c("chunk_count"))
    part = (c("model_vectors") == c("active_vectors")) & (c("model_vectors") < c("chunk_count"))
    wrong = (c("document_status") == "INDEXED") & (c("current_version_id").isNull() | (c("is_current") & (c("status") != "INDEXED")))
    no = F.lit(False)
    rules = [
        ("MISSING_JOB", F.lit("ERROR"), busy & ~c("live_job"), F.lit(True)),
        ("MISSING_CHUNKS", F.lit("CRITICAL"), c("status").isin("CHUNKED", "EMBEDDING", "INDEXED") & (c("chunk_count") == 0), no),
        ("MODEL_MISMATCH", F.lit("CRITICAL"), vectors & other, part),
        ("MISSING_EMBEDDINGS", F.lit("CRITICAL"), vectors & ~other, part),
        ("INVALID_CURRENT_VERSION", F.lit("CRITICAL"), wrong, no),
        ("STALLED_VERSION", F.when(c("live_job"), "WARNING").otherwise("ERROR"), busy & (c("age_minutes") > stalled_minutes), no),
        ("DELETED_DOCUMENT_RESIDUE", F.lit("CRITICAL"), (c("document_status") == "DELETED") & c("is_current") & (c("document_vectors") > 0), no),
    ]
    found = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(name).alias("issue"), level.alias("severity"), fix.alias("repairable"))) for name, level, when, fix in rules]))
    return rows.select(c("id").alias("version_id"), F.inline(found))


def orphans(rows: DataFrame, parents: dict[str, DataFrame]) -> DataFrame:
    """JOIN-05/06, STR-10: rows of which any key has no parent. parents: key column: frame with an id column."""
    marked = rows
    for key, parent in parents.items():
        marked = marked.join(parent.select(F.col("id").alias(key), F.lit(True).alias(f"has_{key}")), key, "left")
    lost = reduce(lambda a, b: a | b, [F.col(f"has_{k}").isNull() for k in parents])
    return marked.filter(lost).select(*rows.columns)


def resolve(observed: DataFrame, stored: DataFrame) -> DataFrame:
    """STR-12: issue_key, action: OPEN what is new, KEEP what is seen again, REOPEN what was resolved, RESOLVE what is gone."""
    both = observed.select("issue_key", F.lit(True).alias("seen")).join(stored.select("issue_key", "status"), "issue_key", "full_outer")
    action = F.when(F.col("status").isNull(), "OPEN").when(F.col("seen") & (F.col("status") == "RESOLVED"), "REOPEN").when(F.col("seen"), "KEEP").when(F.col("status") != "RESOLVED", "RESOLVE").otherwise("NONE")
    return both.select("issue_key", action.alias("action"))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """AGG-05: keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def stale_vectors(vectors: DataFrame, current: DataFrame) -> DataFrame:
    """ING-11, STR-25: vectors with status STALE unless of a current version (version_id)."""
    return vectors.join(current.select("version_id", F.lit(True).alias("is_current")), "version_id", "left").withColumn("status", F.when(F.col("is_current"), F.col("status")).otherwise("STALE")).drop("is_current")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """WIN-02/03: the row of the largest order for each key, by a plain aggregate, which combines on the map side."""
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("row")).select(key, "row.*")


def repairable(rows: DataFrame) -> DataFrame:
    """STR-23: versions whose missing vectors can be filled in: indexed, current, idle, and some but not all vectors there, all active."""
    c = F.col
    return rows.filter((c("status") == "INDEXED") & c("is_current") & ~c("live_job") & (c("active_vectors") > 0) & (c("active_vectors") < c("chunk_count")) & (c("active_vectors") == c("all_vectors"))).select(c("id").alias("version_id"), (c("chunk_count") - c("active_vectors")).alias("missing"))
