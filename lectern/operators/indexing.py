"""Stored vectors: which of them a search may see, whether a version's set is complete, and what failures and events lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.lifecycle import LIVE_JOBS, RECOVERABLE, first_of

# Types of failures with whether a retry makes sense, and the error codes of each.
RETRYABLE = {
    "STORAGE_UNAVAILABLE": True, "STORAGE_CONFIGURATION_INVALID": False, "STORAGE_OBJECT_MISSING": False, "DOCUMENT_CONTENT_INVALID": False, "EMBEDDING_PROVIDER_UNAVAILABLE": True, "EMBEDDING_PROVIDER_OVERLOADED": True,
    "EMBEDDING_PROVIDER_TIMEOUT": True, "EMBEDDING_PROVIDER_CIRCUIT_OPEN": True, "EMBEDDING_REQUEST_INVALID": False, "EMBEDDING_RESULT_INVALID": False, "INDEXING_STATE_INCONSISTENT": False, "WORKER_INTERNAL_ERROR": True,
}
CODES = {
    "STORAGE_CONFIGURATION_INVALID": ("FILE_STORAGE_CONFIGURATION_MISMATCH",),
    "STORAGE_OBJECT_MISSING": ("FILE_OBJECT_NOT_FOUND",),
    "STORAGE_UNAVAILABLE": ("FILE_STORAGE_FAILED",),
    "DOCUMENT_CONTENT_INVALID": ("UNSUPPORTED_DOCUMENT_TYPE", "DOCUMENT_CONTENT_EMPTY", "DOCUMENT_TEXT_DECODING_FAILED", "DOCUMENT_PDF_ENCRYPTED", "DOCUMENT_OCR_REQUIRED", "DOCUMENT_PARSING_FAILED", "DOCUMENT_CONTENT_GARBLED"),
    "EMBEDDING_PROVIDER_UNAVAILABLE": ("EMBEDDING_SERVER_UNAVAILABLE",),
    "EMBEDDING_PROVIDER_OVERLOADED": ("EMBEDDING_PROVIDER_OVERLOADED",),
    "EMBEDDING_PROVIDER_TIMEOUT": ("EMBEDDING_PROVIDER_TIMEOUT",),
    "EMBEDDING_PROVIDER_CIRCUIT_OPEN": ("EMBEDDING_PROVIDER_CIRCUIT_OPEN",),
    "EMBEDDING_REQUEST_INVALID": ("EMBEDDING_REQUEST_REJECTED",),
    "EMBEDDING_RESULT_INVALID": ("EMBEDDING_DIMENSION_MISMATCH", "EMBEDDING_VECTOR_INVALID"),
    "INDEXING_STATE_INCONSISTENT": (
        "DOCUMENT_VERSION_CHUNKING_NOT_ALLOWED", "DOCUMENT_VERSION_EMBEDDING_NOT_ALLOWED", "INDEXING_STATUS_INCONSISTENT", "DOCUMENT_FILE_REFERENCE_MISSING", "DOCUMENT_CHUNKS_INCONSISTENT", "DOCUMENT_EMBEDDINGS_INCONSISTENT",
        "DOCUMENT_INDEXING_COMPLETION_NOT_ALLOWED", "DOCUMENT_INDEXING_STALE_COMPLETION", "DOCUMENT_INDEXING_COMPLETION_INCONSISTENT", "DOCUMENT_INDEXING_FAILURE_INCONSISTENT", "EMBEDDING_JOB_OWNERSHIP_INCONSISTENT",
        "EMBEDDING_MODEL_NOT_CONFIGURED", "MULTIPLE_ACTIVE_EMBEDDING_MODELS",
    ),
}
# Errors of a worker that has lost its job, which aren't reported; types for which the provider says how long to wait.
OWNERSHIP_LOST = ("EMBEDDING_JOB_NOT_FOUND", "EMBEDDING_JOB_NOT_PROCESSING", "EMBEDDING_JOB_OWNERSHIP_INVALID", "EMBEDDING_JOB_LEASE_EXPIRED", "EMBEDDING_JOB_ATTEMPT_INVALID", "EMBEDDING_JOB_FAILURE_CONFLICT")
PROVIDER_WAITS = ("EMBEDDING_PROVIDER_UNAVAILABLE", "EMBEDDING_PROVIDER_OVERLOADED", "EMBEDDING_PROVIDER_TIMEOUT", "EMBEDDING_PROVIDER_CIRCUIT_OPEN")


def searchable(vectors: DataFrame, files: DataFrame, permitted: DataFrame, model: int) -> DataFrame:
    """FIL-01: vectors that a search may see: of the model, ACTIVE, of a permitted document that is indexed and whose current version they belong to.

    vectors: document_id, document_version_id, embedding_model_id, status; files: id, status, current_version_id (a deleted file has another status). Both joins keep rows
    as they are; the version decides the document as well, so the first one is keyed by both.
    """
    rows = vectors.filter((F.col("embedding_model_id") == model) & (F.col("status") == "ACTIVE"))
    now = files.filter(F.col("status") == "INDEXED").select(F.col("id").alias("document_id"), F.col("current_version_id").alias("document_version_id"))
    return rows.join(now, ["document_id", "document_version_id"], "left_semi").join(permitted.select(F.col("id").alias("document_id")), "document_id", "left_semi")


def with_sources(found: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """JOIN-01: found chunks (chunk_id, document_id) with the chunk's text and the document's title. Joined after the top-k, to its few rows: texts aren't carried through the search."""
    few = F.broadcast(found)
    texts = chunks.join(few.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", "chunk_text")
    titles = files.join(few.select(F.col("document_id").alias("id")), "id", "left_semi").select(F.col("id").alias("document_id"), F.col("title").alias("document_title"))
    return found.join(texts, "chunk_id").join(titles, "document_id")


def completion(versions: DataFrame, chunks: DataFrame, vectors: DataFrame, jobs: DataFrame, model: int, dimension: int) -> DataFrame:
    """AGG-25: per version its chunks, vectors (all, of the model, active), live jobs and invalid vectors, and whether they allow completion.

    versions: id, document_id. chunks: chunk_id, document_version_id. vectors: chunk_id, document_id, document_version_id,
    embedding_model_id, status, dimension, vector, vector_hash. jobs: version_id, status. A vector is invalid if it or its
    chunk belongs to the version and anything of both, its dimension or its hash doesn't fit; each version that it touches counts it.
    """
    count = lambda rows, key, name, *more: rows.groupBy(F.col(key).alias("id")).agg(F.count("*").alias(name), *more)
    of_model = F.col("embedding_model_id") == model
    stored = count(vectors, "document_version_id", "all_vectors", F.count_if(of_model).alias("model_vectors"), F.count_if(of_model & (F.col("status") == "ACTIVE")).alias("active_vectors"))
    both = vectors.filter(of_model).join(chunks.select("chunk_id", F.col("document_version_id").alias("chunk_version")), "chunk_id")
    owner = versions.select(F.col("id").alias("touched"), F.col("document_id").alias("owner"))
    each = both.withColumn("touched", F.explode(F.array_distinct(F.array("document_version_id", "chunk_version")))).join(owner, "touched")
    hash_ok = F.coalesce(F.col("vector_hash").rlike("^[0-9a-f]{64}$"), F.lit(False))
    wrong = (F.col("document_id") != F.col("owner")) | (F.col("document_version_id") != F.col("touched")) | (F.col("chunk_version") != F.col("touched")) | (F.col("dimension") != dimension) | (F.size("vector") != dimension) | ~hash_ok
    invalid = count(each.filter(wrong), "touched", "invalid")
    live = count(jobs.filter(F.col("status").isin(*LIVE_JOBS)), "version_id", "live_jobs")
    rows = versions.select("id").join(count(chunks, "document_version_id", "chunks"), "id", "left").join(stored, "id", "left").join(invalid, "id", "left").join(live, "id", "left").fillna(0)
    fits = (F.col("live_jobs") == 1) & (F.col("chunks") > 0) & (F.col("model_vectors") == F.col("chunks")) & (F.col("active_vectors") == F.col("chunks")) & (F.col("invalid") == 0)
    return rows.select(F.col("id").alias("version_id"), "chunks", "all_vectors", "model_vectors", "active_vectors", "live_jobs", "invalid", fits.alias("complete"))


def classified(failures: DataFrame) -> DataFrame:
    """STR-27: failures (error_code, null for an unexpected one; provider_delay_ms) with reported, failure_type, retryable, minimum_delay_ms.

    A worker that has lost its job reports nothing, so that it doesn't overwrite the state of the one that has it. Unknown codes are internal errors.
    """
    code = F.col("error_code")
    lost = F.coalesce(code.isin(*OWNERSHIP_LOST), F.lit(False))
    kind = first_of([(lost, None), *[(code.isin(*codes), name) for name, codes in CODES.items()]], "WORKER_INTERNAL_ERROR")
    rows = failures.withColumn("failure_type", kind)
    retry = F.col("failure_type").isin(*[k for k, v in RETRYABLE.items() if v])
    delay = F.when(F.col("failure_type").isin(*PROVIDER_WAITS), F.coalesce("provider_delay_ms", F.lit(0).cast("long"))).when(~lost, F.lit(0).cast("long"))
    return rows.withColumns({"reported": ~lost, "retryable": retry, "minimum_delay_ms": delay})


def model_event_decisions(events: DataFrame, versions: DataFrame, models: DataFrame, jobs: DataFrame) -> DataFrame:
    """STR-24: event_id, decision of version events (event_id, event_type, version_id, embedding_model_id), with the model in every check.

    versions: id, status. models: id. jobs: id, version_id, embedding_model_id, status, source_event_id (one job an event).
    An event's own job must be of its version and model. Otherwise the latest job of the same version and model decides.
    """
    own = jobs.filter("source_event_id IS NOT NULL").select(F.col("source_event_id").alias("event_id"), F.col("version_id").alias("own_version"), F.col("embedding_model_id").alias("own_model"))
    latest = jobs.groupBy("version_id", "embedding_model_id").agg(F.max_by("status", "id").alias("job_status"))
    there = models.select(F.col("id").alias("embedding_model_id"), F.lit(True).alias("model_there"))
    rows = events.join(versions.select(F.col("id").alias("version_id"), F.col("status").alias("version_status")), "version_id", "left").join(there, "embedding_model_id", "left")
    rows = rows.join(own, "event_id", "left").join(latest, ["version_id", "embedding_model_id"], "left")
    again = (F.col("event_type") == "DOCUMENT_REINDEX_REQUESTED") & F.col("job_status").isNotNull()
    mine = (F.col("own_version") == F.col("version_id")) & (F.col("own_model") == F.col("embedding_model_id"))
    rules = [
        (F.col("version_status").isNull() | F.col("model_there").isNull(), "INCONSISTENT"),
        (mine, "ALREADY_HANDLED"),
        (F.col("own_version").isNotNull(), "INCONSISTENT"),
        (again & (F.col("job_status") == "FAILED"), "RETRY"),
        (again & F.col("job_status").isin(*LIVE_JOBS), "REUSE"),
        (again & (F.col("job_status") == "INDEXED"), "REPAIR_VECTORS"),
        (F.col("job_status").isNotNull() | ~F.col("version_status").isin(*RECOVERABLE), "INCONSISTENT"),
    ]
    return rows.select("event_id", first_of(rules, "CREATE_JOB").alias("decision"))


def current_workers(workers: DataFrame, deadline: Column) -> DataFrame:
    """FIL-16, STR-07: workers with effective_status: one that is ACTIVE or IDLE and gave no sign since the deadline is DEAD."""
    silent = F.col("status").isin("ACTIVE", "IDLE") & (F.col("last_heartbeat_at").isNull() | (F.col("last_heartbeat_at") <= deadline))
    return workers.withColumn("effective_status", F.when(silent, "DEAD").otherwise(F.col("status")))


def prepared(results: DataFrame, history: DataFrame, readable: DataFrame, most: int = 3, turns: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """RET-10: what goes into a prompt: the first `most` results that are readable now, the last `turns` earlier turns all of whose sources are, and the union of their sources.

    results: query_id, rank_no, document_id. history: query_id, turn, sources (array of document ids). readable: id.
    Returns (query_id, place, rank_no, document_id), (query_id, turn, sources), (query_id, document_id). A turn without sources may be shown.
    """
    from pyspark.sql.window import Window

    ok = readable.select(F.col("id").alias("document_id"))
    allowed = results.join(ok, "document_id", "left_semi")
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("rank_no"))
    allowed = allowed.withColumn("place", first).filter(F.col("place") <= most).select("query_id", "place", "rank_no", "document_id")
    hidden = history.select("query_id", "turn", F.explode(F.array_distinct("sources")).alias("document_id")).join(ok, "document_id", "left_anti").select("query_id", "turn").distinct()
    back = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("turn")))
    said = history.join(hidden, ["query_id", "turn"], "left_anti").withColumn("back", back).filter(F.col("back") <= turns).select("query_id", "turn", "sources")
    sources = allowed.select("query_id", "document_id").union(said.select("query_id", F.explode("sources"))).distinct()
    return allowed, said, sources
