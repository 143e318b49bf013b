"""Outbox events, answers under way, failures of jobs, snapshots of queues, and pages as they go out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators.lifecycle import first_of


def claimed_events(events: DataFrame, as_of: Column, slots: int) -> DataFrame:
    """STR-02: the next due events in order (available_at, occurred_at, id), a slot each. A top-k: nothing but the slots is sorted as a whole."""
    order = [F.asc_nulls_last("available_at"), F.asc_nulls_last("occurred_at"), F.asc("id")]
    first = events.filter((F.col("status") == "PENDING") & (F.col("available_at") <= as_of)).orderBy(*order).limit(slots)
    return first.select((F.row_number().over(Window.orderBy(*order)) - 1).alias("slot"), "id", "available_at", "occurred_at")


def recovered_events(events: DataFrame, as_of: Column, batch: int, first_ms: int = 1000, most_ms: int = 60_000) -> DataFrame:
    """STR-29, TOP-07: the oldest `batch` events whose lease ran out, each PENDING again after a growing delay, or FAILED without a retry left."""
    late = events.filter((F.col("status") == "PROCESSING") & (F.col("lock_expires_at") <= as_of))
    oldest = late.orderBy("lock_expires_at", "id").limit(batch)
    again = F.col("retry_count") + 1 < F.col("max_retry_count")
    delay = F.least(F.lit(first_ms) * F.pow(F.lit(2.0), F.least("retry_count", F.lit(40))), F.lit(float(most_ms))).cast("long")
    status = F.when(again, "PENDING").otherwise("FAILED")
    return oldest.select("id", "lock_expires_at", (F.col("retry_count") + 1).alias("retry_count"), status.alias("next_status"), F.when(again, delay).alias("delay_ms"))


def claimable_answers(answers: DataFrame, as_of: Column, slots: int) -> DataFrame:
    """STR-03: answers in the works that nobody has, or whose lease ran out, oldest first."""
    free = F.col("claim_token").isNull() | (F.col("claim_lease_until") < as_of)
    order = [F.asc("created_at"), F.asc("id")]
    first = answers.filter((F.col("status") == "PROCESSING") & free).orderBy(*order).limit(slots)
    return first.select((F.row_number().over(Window.orderBy(*order)) - 1).alias("slot"), "id", "created_at")


# The event of a failure by the status that a version fails from.
STAGES = {"UPLOADED": "PARSE_FAILED", "PARSING": "PARSE_FAILED", "CHUNKED": "EMBEDDING_FAILED", "EMBEDDING": "EMBEDDING_FAILED"}


def failure_transitions(failures: DataFrame, versions: DataFrame, files: DataFrame, first_ms: int = 1000, most_ms: int = 60_000) -> DataFrame:
    """STR-26: what a failure does to its job, version and document.

    failures: job_id, version_id, retry_count, max_retry_count, retryable, failed_at, minimum_delay_ms. With a retry left the job waits
    - as long as the backoff and the provider ask for - and the version keeps its status to go on from. Else job and version fail, the version's
    vectors go stale, and the document fails unless an earlier, indexed version stays current; any other state of the document is INCONSISTENT
    and changes nothing.
    """
    of = versions.select(F.col("id").alias("version_id"), "document_id", F.col("status").alias("version_status"))
    doc = files.select(F.col("id").alias("document_id"), F.col("status").alias("document_status"), "current_version_id")
    now = versions.select(F.col("id").alias("current_version_id"), F.col("document_id").alias("current_document"), F.col("status").alias("current_status"))
    rows = failures.join(of, "version_id").join(doc, "document_id").join(now, "current_version_id", "left")
    again = F.col("retryable") & (F.col("retry_count") + 1 < F.col("max_retry_count"))
    itself = F.col("current_version_id") == F.col("version_id")
    keeps = ~itself & (F.col("current_status") == "INDEXED") & (F.col("document_status") == "INDEXED")
    fails = (itself | (F.col("current_status") == "FAILED")) & F.col("document_status").isin("UPLOADED", "INDEXING", "FAILED")
    rules = [
        (~F.col("version_status").isin(*STAGES), "INCONSISTENT"),
        (again, "RETRY"),
        (F.col("current_status").isNull() | (F.col("current_document") != F.col("document_id")), "INCONSISTENT"),
        (keeps, "FAILED_DOCUMENT_KEPT"),
        (fails, "FAILED"),
    ]
    rows = rows.withColumn("outcome", first_of(rules, "INCONSISTENT"))
    ended = F.col("outcome").isin("FAILED", "FAILED_DOCUMENT_KEPT")
    wait = F.greatest(F.least(F.lit(first_ms) * F.pow(F.lit(2.0), F.least("retry_count", F.lit(40))), F.lit(float(most_ms))).cast("long"), F.col("minimum_delay_ms"))
    stage = first_of([(F.col("version_status") == s, e) for s, e in STAGES.items()], None)
    return rows.select(
        "job_id", "outcome", F.when(F.col("outcome") == "RETRY", "PENDING").when(ended, "FAILED").otherwise("PROCESSING").alias("job_status"), F.when(F.col("outcome") == "RETRY", F.timestamp_add("MILLISECOND", wait, F.col("failed_at"))).alias("next_retry_at"),
        F.when(ended, "FAILED").otherwise(F.col("version_status")).alias("version_status"), F.when(F.col("outcome") == "FAILED", "FAILED").otherwise(F.col("document_status")).alias("document_status"), ended.alias("vectors_stale"),
        F.when(F.col("outcome") != "INCONSISTENT", stage).alias("stage_event"),
    )


def orphaned(vectors: DataFrame, chunks: DataFrame, files: DataFrame, versions: DataFrame, models: DataFrame) -> DataFrame:
    """JOIN-06: vectors that lack any of their four parents, with which; models is a small table of a checked size."""
    mark = lambda d, key, column, name: d.select(F.col(key).alias(column), F.lit(True).alias(name))
    rows = vectors.select("id", "chunk_id", "document_id", "document_version_id", "embedding_model_id")
    parents = [(chunks, "chunk_id", "chunk_id", "chunk"), (files, "id", "document_id", "document"), (versions, "id", "document_version_id", "version"), (models, "id", "embedding_model_id", "model")]
    for table, key, column, name in parents:
        rows = rows.join(mark(table, key, column, name), column, "left")
    missing = F.filter(F.array(*[F.when(F.col(name).isNull(), name) for *_, name in parents]), lambda x: x.isNotNull())
    return rows.withColumn("missing", F.array_join(missing, ",")).filter("missing <> ''").select("id", "missing")


def operations(jobs: DataFrame, workers: DataFrame, answers: DataFrame, events: DataFrame, as_of: Column, deadline: Column) -> DataFrame:
    """AGG-16: one row over jobs, live workers, answers under way and outbox events."""
    due = (F.col("status") == "PENDING") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= as_of))
    one = jobs.agg(F.count_if(due).alias("claimable_jobs"), F.count_if((F.col("status") == "PENDING") & (F.col("next_retry_at") > as_of)).alias("delayed_jobs"), F.count_if(F.col("status") == "PROCESSING").alias("processing_jobs"), F.min(F.when(due, F.coalesce("next_retry_at", "created_at"))).alias("oldest_job_at"))
    two = workers.agg(F.count_if(F.col("status").isin("ACTIVE", "IDLE") & (F.col("last_heartbeat_at") > deadline)).alias("active_workers"))
    working = F.col("status") == "PROCESSING"
    three = answers.agg(F.count_if(working).alias("processing_answers"), F.min(F.when(working, F.col("created_at"))).alias("oldest_answer_at"))
    open_ = (F.col("status") == "PENDING") & (F.col("available_at") <= as_of)
    four = events.agg(F.count_if(open_).alias("claimable_events"), F.count_if(working).alias("processing_events"), F.min(F.when(open_, F.col("available_at"))).alias("oldest_event_at"))
    return one.crossJoin(F.broadcast(two)).crossJoin(F.broadcast(three)).crossJoin(F.broadcast(four))  # one row each


def dashboard(files: DataFrame, jobs: DataFrame, attempts: DataFrame, workers: DataFrame, searches: DataFrame, as_of: Column) -> DataFrame:
    """AGG-14: one row: documents, jobs with the mean time of what is done, workers, and searches of the last 24 hours."""
    count = lambda *s: F.count_if(F.col("status").isin(*s))
    one = files.agg(F.count_if(F.col("status") != "DELETED").alias("documents"), count("INDEXED").alias("indexed"), count("UPLOADED", "INDEXING").alias("pending_documents"))
    two = jobs.agg(count("PENDING").alias("pending_jobs"), count("PROCESSING").alias("processing_jobs"), count("FAILED").alias("failed_jobs"))
    three = attempts.filter("status = 'DONE'").agg(F.round(F.avg(F.col("seconds") * 1000)).cast("long").alias("mean_ms"))
    four = workers.agg(count("ACTIVE", "IDLE").alias("active_workers"), F.count("*").alias("workers"))
    five = searches.agg(F.count_if(F.col("created_at") > as_of - F.expr("INTERVAL 24 HOURS")).alias("recent_searches"))
    return one.crossJoin(F.broadcast(two)).crossJoin(F.broadcast(three)).crossJoin(F.broadcast(four)).crossJoin(F.broadcast(five))  # one row each


def conversation_turns(queries: DataFrame, results: DataFrame, answers: DataFrame, citations: DataFrame, readable: DataFrame) -> DataFrame:
    """JOIN-15: a row a turn with its readable results and, unless a source is unknown or forbidden, its answer and citations.

    queries: query_id, conv_id, turn, text. results: query_id, rank_no, chunk_id, document_id. answers: query_id, answer, sources (array, null: unknown).
    citations: query_id, citation_order, chunk_id, quote, page_no, score, document_id. The arrays of a turn hold what one search returned, a bounded number.
    """
    ok = readable.select(F.col("id").alias("document_id"))
    seen = results.join(ok, "document_id", "left_semi").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank_no", "chunk_id", "document_id"))).alias("results"))
    cited = citations.join(ok.withColumn("ok", F.lit(True)), "document_id", "left")
    cited = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("citation_order", F.concat(F.lit("["), F.col("citation_order").cast("string"), F.lit("]")).alias("label"), "chunk_id", "quote", "page_no", "score"))).alias("citations"), F.bool_and(F.coalesce("ok", F.lit(False))).alias("cited_ok"))
    sources = answers.select("query_id", F.explode("sources").alias("document_id")).join(ok, "document_id", "left_anti").select("query_id").distinct().withColumn("forbidden", F.lit(True))
    rows = queries.join(seen, "query_id", "left").join(answers, "query_id", "left").join(cited, "query_id", "left").join(sources, "query_id", "left")
    withheld = F.col("answer").isNotNull() & (F.col("sources").isNull() | F.coalesce("forbidden", F.lit(False)) | ~F.coalesce("cited_ok", F.lit(True)))
    return rows.select("conv_id", "query_id", "turn", "text", "results", F.when(~withheld, F.col("answer")).alias("answer"), F.when(~withheld, F.col("citations")).alias("citations"), withheld.alias("withheld"))


def envelope(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """SRC-24: one JSON text: a page's rows (content, null fields left out) with its number, size, all elements and pages, and whether it is the first and the last."""
    place = F.row_number().over(Window.orderBy(*order)) - 1
    content = rows.orderBy(*order).offset(number * size).limit(size)
    held = content.withColumn("__place", place).agg(F.transform(F.array_sort(F.collect_list(F.struct("__place", F.struct(*rows.columns).alias("row")))), lambda x: x["row"]).alias("content"))
    total = rows.agg(F.count("*").alias("n"))
    pages = F.ceil(F.col("n") / size)
    fields = F.struct("content", F.lit(number).alias("page"), F.lit(size).alias("size"), F.col("n").alias("totalElements"), pages.alias("totalPages"), F.lit(number == 0).alias("first"), (F.lit(number + 1) >= pages).alias("last"))
    return held.crossJoin(F.broadcast(total)).select(F.to_json(fields).alias("value"))  # one row each
