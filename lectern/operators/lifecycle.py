"""Rules of requests, events, jobs, answers and cached rights: decisions over joined facts, one row in and one row out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statuses by which the rules decide.
LIVE_JOBS = ("PENDING", "PROCESSING")
RECOVERABLE = ("UPLOADED", "PARSING", "CHUNKED", "EMBEDDING")
RETRYABLE_DOCUMENTS = ("INDEXED", "INDEXING", "FAILED")


def first_of(rules: list[tuple[Column, str]], last: str) -> Column:
    """The name of the first rule that holds; a rule that is null doesn't."""
    out = F.lit(last)
    for holds, name in reversed(rules):
        out = F.when(holds, name).otherwise(out)
    return out


def retry_verdict(jobs: DataFrame, versions: DataFrame, documents: DataFrame) -> DataFrame:
    """STR-13, STR-28: id, verdict: why a job may not be retried by hand, the first reason in the fixed order.

    jobs: id, version_id, status. versions: id, document_id, version_no, status. documents: id, status, current_version_id.
    """
    owner = versions.select(F.col("id").alias("current_version_id"), F.col("document_id").alias("current_document"))
    latest = versions.groupBy("document_id").agg(F.max_by("id", "version_no").alias("latest_version"))
    docs = documents.select(F.col("id").alias("document_id"), F.col("status").alias("document_status"), "current_version_id").join(owner, "current_version_id", "left")
    facts = versions.select(F.col("id").alias("version_id"), "document_id", F.col("status").alias("version_status")).join(docs, "document_id", "left").join(latest, "document_id", "left")
    alive = jobs.filter(F.col("status").isin(*LIVE_JOBS)).select("version_id").distinct().withColumn("alive", F.lit(True))
    rows = jobs.join(facts, "version_id").join(alive, "version_id", "left")
    rules = [
        (F.col("status") != "FAILED", "JOB_NOT_FAILED"),
        (F.col("version_status") != "FAILED", "VERSION_NOT_FAILED"),
        (F.col("document_status") == "DELETED", "DOCUMENT_DELETED"),
        (~F.col("document_status").isin(*RETRYABLE_DOCUMENTS), "DOCUMENT_STATUS_INVALID"),
        (~F.col("current_document").eqNullSafe(F.col("document_id")), "CURRENT_VERSION_INCONSISTENT"),
        (F.col("latest_version").isNull(), "DATA_INCONSISTENT"),
        (F.col("latest_version") != F.col("version_id"), "SUPERSEDED_VERSION"),
        (F.col("alive"), "LIVE_JOB_EXISTS"),
    ]
    return rows.select("id", "version_id", first_of(rules, "ELIGIBLE").alias("verdict"))


def event_decisions(events: DataFrame, versions: DataFrame, jobs: DataFrame) -> DataFrame:
    """STR-24, STR-30, JOIN-14: event_id, decision for version events (event_id, event_type, version_id): what becomes of each.

    An event that has a job of its own is done. A request to index anew retries a failed job, leaves a live one and repairs
    an indexed version; else a job is made for a version in the works, and anything else is inconsistent.
    jobs: id, version_id, status, source_event_id.
    """
    own = jobs.filter("source_event_id IS NOT NULL").groupBy(F.col("source_event_id").alias("event_id")).agg(F.first("version_id").alias("own_version"))
    latest = jobs.groupBy("version_id").agg(F.max_by("status", "id").alias("job_status"))
    rows = events.join(versions.select(F.col("id").alias("version_id"), F.col("status").alias("version_status")), "version_id", "left").join(own, "event_id", "left").join(latest, "version_id", "left")
    again = (F.col("event_type") == "DOCUMENT_REINDEX_REQUESTED") & F.col("job_status").isNotNull()
    rules = [
        (F.col("version_status").isNull(), "INCONSISTENT"),
        (F.col("own_version") == F.col("version_id"), "ALREADY_HANDLED"),
        (F.col("own_version").isNotNull(), "INCONSISTENT"),
        (again & (F.col("job_status") == "FAILED"), "RETRY"),
        (again & F.col("job_status").isin(*LIVE_JOBS), "REUSE"),
        (again & (F.col("job_status") == "INDEXED"), "REPAIR_VECTORS"),
        (F.col("job_status").isNotNull() | ~F.col("version_status").isin(*RECOVERABLE), "INCONSISTENT"),
    ]
    return rows.select("event_id", first_of(rules, "CREATE_JOB").alias("decision"))


def dispatched(events: DataFrame, handlers: dict[str, str]) -> DataFrame:
    """STR-30: events with their handler by event_type; types without one go to UNSUPPORTED."""
    return events.withColumn("handler", first_of([(F.col("event_type") == k, v) for k, v in handlers.items()], "UNSUPPORTED"))


def acquired(stored: DataFrame, requests: DataFrame, as_of: Column, minutes: int = 5) -> DataFrame:
    """STR-22: user_id, request_key, outcome, lease_expires_at of requests (user_id, request_key, fingerprint), one a key.

    CREATED for a new key, CONFLICT for another fingerprint, REPLAYED once completed, RECLAIMED where the lease ran out, else IN_PROGRESS.
    stored: user_id, request_key, input_fingerprint, state, lease_expires_at.
    """
    rows = requests.join(stored, ["user_id", "request_key"], "left")
    rules = [
        (~F.col("request_key").rlike("^[A-Za-z0-9_-]{8,128}$"), "KEY_INVALID"),
        (F.col("state").isNull(), "CREATED"),
        (F.col("input_fingerprint") != F.col("fingerprint"), "CONFLICT"),
        (F.col("state") == "COMPLETED", "REPLAYED"),
        ((F.col("state") == "IN_PROGRESS") & (F.col("lease_expires_at") <= as_of), "RECLAIMED"),
    ]
    rows = rows.withColumn("outcome", first_of(rules, "IN_PROGRESS"))
    fresh = F.col("outcome").isin("CREATED", "RECLAIMED")
    lease = F.when(fresh, as_of + F.make_dt_interval(mins=F.lit(minutes))).when(F.col("outcome") == "IN_PROGRESS", F.col("lease_expires_at"))
    return rows.select("user_id", "request_key", "outcome", lease.alias("lease_expires_at"))


def renewed(rows: DataFrame, renewals: DataFrame, as_of: Column, seconds: int) -> DataFrame:
    """STR-04: id, renewed, lease_expires_at: a lease goes on only for its own token, while the row is processed and the lease runs. renewals: id, token."""
    both = rows.join(renewals.select("id", F.col("token").alias("offered")), "id")
    ok = F.coalesce((F.col("status") == "PROCESSING") & (F.col("token") == F.col("offered")) & (F.col("lease_expires_at") > as_of), F.lit(False))
    return both.select("id", ok.alias("renewed"), F.when(ok, as_of + F.make_dt_interval(secs=F.lit(seconds))).otherwise(F.col("lease_expires_at")).alias("lease_expires_at"))


def swept(rows: DataFrame, as_of: Column, minutes: int) -> DataFrame:
    """STR-08, RET-17: rows still PROCESSING after so many minutes become FAILED; all others stay as they are. rows: id, status, created_at."""
    late = (F.col("status") == "PROCESSING") & (F.col("created_at") < as_of - F.make_dt_interval(mins=F.lit(minutes)))
    return rows.withColumn("status", F.when(late, "FAILED").otherwise(F.col("status")))


def classified_failures(failures: DataFrame, table: DataFrame) -> DataFrame:
    """STR-27: failures (error_code) with type, retryable and minimum delay by a small table of codes, which is broadcast; unknown codes are internal errors.

    table: error_code, failure_type, retryable, min_delay_ms.
    """
    rows = failures.join(F.broadcast(table), "error_code", "left")
    return rows.withColumns({"failure_type": F.coalesce("failure_type", F.lit("WORKER_INTERNAL_ERROR")), "retryable": F.coalesce("retryable", F.lit(True)), "min_delay_ms": F.coalesce("min_delay_ms", F.lit(0).cast("long"))})


def granted_cache(cache: DataFrame, grants: DataFrame) -> DataFrame:
    """PERM-06: the cache after grants to users: rows of the same user, document and source take the grant's rights and are valid again, new ones are added.

    Both: user_id, document_id, source_type, can_read, can_write, can_admin; cache also invalidated. One row a key on either side.
    """
    keys, flags = ["user_id", "document_id", "source_type"], ("can_read", "can_write", "can_admin")
    new = grants.select(*keys, *[F.col(f).alias(f"new_{f}") for f in flags], F.lit(True).alias("granted"))
    both = cache.select(*keys, *flags, "invalidated").join(new, keys, "full_outer")
    return both.select(*keys, *[F.when(F.col("granted"), F.col(f"new_{f}")).otherwise(F.col(f)).alias(f) for f in flags], F.when(F.col("granted"), F.lit(False)).otherwise(F.col("invalidated")).alias("invalidated"))


def refreshed_cache(cache: DataFrame, events: DataFrame, grants: DataFrame) -> DataFrame:
    """PERM-09: user_id, document_id, invalidated, can_read of cache rows after the latest event of their source.

    A revoke, or a grant that is gone or isn't to a user, invalidates; a grant takes its present rights. cache: user_id,
    document_id, source_id, can_read, invalidated. events: source_id, event_no, kind. grants: id, target_type, can_read.
    """
    last = events.groupBy("source_id").agg(F.max_by("kind", "event_no").alias("kind"))
    now = grants.select(F.col("id").alias("source_id"), "target_type", F.col("can_read").alias("now_read"))
    rows = cache.join(last, "source_id", "left").join(now, "source_id", "left")
    gone = (F.col("kind") == "REVOKED") | (F.col("kind").isNotNull() & ~F.col("target_type").eqNullSafe(F.lit("USER")))
    return rows.select("user_id", "document_id", F.when(gone, True).when(F.col("kind").isNotNull(), False).otherwise(F.col("invalidated")).alias("invalidated"), F.when(F.col("kind").isNotNull() & ~gone, F.col("now_read")).otherwise(F.col("can_read")).alias("can_read"))


def target_users(users: DataFrame, keyword: str | None, limit: int = 20) -> DataFrame:
    """PERM-08: active users whose name or address holds the trimmed keyword in any case, by name; none without a keyword."""
    word = (keyword or "").strip().lower()
    hit = F.contains(F.lower("name"), F.lit(word)) | F.contains(F.lower("email"), F.lit(word))
    return users.filter((F.col("status") == "ACTIVE") & hit & F.lit(bool(word))).orderBy("name", "id").limit(limit).select("id", "name", "email")


def in_both(left: DataFrame, right: DataFrame, *labels: str) -> DataFrame:
    """STR-19, STR-32: samples of the left series at whose labels (with time) the right one has a sample as well."""
    return left.join(right.select(*labels).distinct(), list(labels), "left_semi")
