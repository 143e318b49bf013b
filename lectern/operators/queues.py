"""Work queues as tables: due order, claims, leases, retries, keyed writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import backoff


def due(jobs: DataFrame, as_of: Column) -> DataFrame:
    return jobs.filter((F.col("status") == "PENDING") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= as_of)))


def claim(jobs: DataFrame, as_of: Column, slots: int) -> DataFrame:
    """STR-01..03, TOP-06: the next jobs by priority, age and id, one a slot. A top-k, then ranks over those few rows."""
    order = [F.col("priority").desc(), F.col("created_at").asc_nulls_last(), F.col("id").asc()]
    first = due(jobs, as_of).orderBy(*order).limit(slots)
    return first.select((F.row_number().over(Window.orderBy(*order)) - 1).alias("slot"), "id", "priority", "created_at")


def expired(jobs: DataFrame, as_of: Column, batch: int | None = None) -> DataFrame:
    """STR-05, STR-29, TOP-07: leases that ran out, oldest first, and what becomes of each job."""
    rows = jobs.filter((F.col("status") == "PROCESSING") & (F.col("lock_expires_at") <= as_of))
    again = F.col("retry_count") + 1 < F.col("max_retry_count")
    rows = rows.select("id", "lock_expires_at", (F.col("retry_count") + 1).alias("retry_count"), F.when(again, "PENDING").otherwise("FAILED").alias("next_status"))
    return rows if batch is None else rows.orderBy(F.col("lock_expires_at").asc_nulls_last(), "id").limit(batch)


def failures(jobs: DataFrame, first_ms: int = 1000, most_ms: int = 60_000) -> DataFrame:
    """STR-06, STR-26, FN-16: retry with growing delay, or the end."""
    last = F.col("retry_count") + 1 >= F.col("max_retry_count")
    return jobs.select("id", F.when(last, "FAILED").otherwise("PENDING").alias("next_status"), F.when(~last, backoff(F.col("retry_count"), first_ms, most_ms)).alias("delay_ms"))


def worker_status(workers: DataFrame, deadline: Column) -> DataFrame:
    """FIL-16, STR-07: a live worker without a heartbeat since the deadline is dead."""
    live = F.col("status").isin("RUNNING", "IDLE")
    return workers.withColumn("effective_status", F.when(live & (F.col("last_heartbeat_at").isNull() | (F.col("last_heartbeat_at") <= deadline)), "DEAD").otherwise(F.col("status")))


def insert_absent(target: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """SRC-19: rows whose key target doesn't have, each key once (the first by all columns)."""
    rest = [c for c in rows.columns if c not in keys]
    once = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("row")) if rest else rows.distinct()
    once = once.select(*keys, "row.*") if rest else once
    return once.join(target.select(*keys), list(keys), "left_anti")


def classify_writes(stored: DataFrame, rows: DataFrame, key: str, payload: str) -> DataFrame:
    """SRC-20, SRC-25: CREATED, REPLAYED or CONFLICT by what is stored under the key."""
    old = stored.select(key, F.col(payload).alias("old"), F.lit(True).alias("there"))
    joined = rows.join(old, key, "left")
    return joined.withColumn("outcome", F.when(F.col("there").isNull(), "CREATED").when(F.col("old").eqNullSafe(F.col(payload)), "REPLAYED").otherwise("CONFLICT")).drop("old", "there")


def unreferenced(objects: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """SRC-26, JOIN-10: stored objects that nothing refers to."""
    return objects.join(references.select(key), key, "left_anti")


def queue_snapshot(jobs: DataFrame, as_of: Column) -> DataFrame:
    """AGG-16, FIL-14, AGG-08: one row: claimable, delayed, processing, failed, oldest due. One pass."""
    ready = (F.col("status") == "PENDING") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= as_of))
    waiting = (F.col("status") == "PENDING") & (F.col("next_retry_at") > as_of)
    return jobs.agg(F.count_if(ready).alias("claimable"), F.count_if(waiting).alias("delayed"), F.count_if(F.col("status") == "PROCESSING").alias("processing"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.min(F.when(ready, F.coalesce("next_retry_at", "created_at"))).alias("oldest_due_at"))
