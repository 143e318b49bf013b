"""STR-22: the states of idempotent uploads, moved on set by set.

requests has a row for each (user_id, request_key): input_fingerprint, state (IN_PROGRESS, COMPLETED, CLEANING), owner_token,
lease_expires_at, candidate_key, candidate_at, cleanup_token, cleanup_lease_at, document_id. Each function takes the
table and a table of what is asked for (one row a key), and returns the whole table after it with `done`: whether the
row's own request went through (null where nothing was asked). A request that isn't the owner's changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["user_id", "request_key"]
STATE = ["input_fingerprint", "state", "owner_token", "lease_expires_at", "candidate_key", "candidate_at", "cleanup_token", "cleanup_lease_at", "document_id"]
CANDIDATE = ("candidate_key", "candidate_at", "cleanup_token", "cleanup_lease_at")


def _minutes(n: int) -> Column:
    return F.make_dt_interval(mins=F.lit(n))


def _changed(requests: DataFrame, asked: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """requests with the values where a row was asked for and the condition holds; asked columns are at hand as x_<name>."""
    other = asked.select(*KEYS, *[F.col(c).alias(f"x_{c}") for c in asked.columns if c not in KEYS], F.lit(True).alias("x_asked"))
    rows = requests.select(*KEYS, *STATE).join(other, KEYS, "left")
    done = F.when(F.col("x_asked"), F.coalesce(condition, F.lit(False)))
    rows = rows.withColumn("done", done)
    return rows.select(*KEYS, *[F.when(F.col("done"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in STATE], "done")


def _owned() -> Column:
    return (F.col("owner_token") == F.col("x_owner_token")) & (F.col("state") == "IN_PROGRESS")


def registered(requests: DataFrame, candidates: DataFrame, as_of: Column) -> DataFrame:
    """Before a file is stored, its owner writes down where (owner_token, candidate_key), if no other candidate is there."""
    free = F.col("candidate_key").isNull() & F.col("cleanup_token").isNull()
    return _changed(requests, candidates, _owned() & free, {"candidate_key": F.col("x_candidate_key"), "candidate_at": as_of})


def completed(requests: DataFrame, completions: DataFrame) -> DataFrame:
    """The owner (owner_token) finishes with a document_id; a candidate that became its file (claimed) is no longer one."""
    values = {c: F.when(F.col("x_claimed"), F.lit(None)).otherwise(F.col(c)) for c in CANDIDATE[:2]}
    return _changed(requests, completions, _owned(), {"state": F.lit("COMPLETED"), "document_id": F.col("x_document_id"), **values})


def released(requests: DataFrame, owners: DataFrame, as_of: Column) -> DataFrame:
    """The owner (owner_token) lets go; the next request may take over at once."""
    return _changed(requests, owners, _owned(), {"lease_expires_at": as_of})


def _abandoned(as_of: Column, grace_seconds: int) -> Column:
    """A candidate whose time is over, that nobody uploads and nobody cleans up."""
    idle = (F.col("state") == "COMPLETED") | (F.col("state").isin("IN_PROGRESS", "CLEANING") & (F.col("lease_expires_at") <= as_of))
    free = F.col("cleanup_lease_at").isNull() | (F.col("cleanup_lease_at") <= as_of)
    return F.col("candidate_key").isNotNull() & (F.col("candidate_at") <= as_of - F.make_dt_interval(secs=F.lit(grace_seconds))) & idle & free


def cleanup_targets(requests: DataFrame, as_of: Column, grace_seconds: int, limit: int) -> DataFrame:
    """The oldest candidates to clean up. Reads alone."""
    if grace_seconds < 0 or not 1 <= limit <= 100:
        raise ValueError(f"grace must not be negative and limit within 1 to 100: {grace_seconds}, {limit}")
    return requests.filter(_abandoned(as_of, grace_seconds)).orderBy("candidate_at", *KEYS).limit(limit).select(*KEYS, "candidate_key")


def reserved(requests: DataFrame, targets: DataFrame, as_of: Column, grace_seconds: int, minutes: int = 5) -> DataFrame:
    """Takes the targets (candidate_key, owner_token, cleanup_token: new tokens) for cleaning: the uploader before loses its claim."""
    same = F.col("candidate_key") == F.col("x_candidate_key")
    values = {
        "state": F.when(F.col("state") == "IN_PROGRESS", "CLEANING").otherwise(F.col("state")), "owner_token": F.col("x_owner_token"), "cleanup_token": F.col("x_cleanup_token"), "cleanup_lease_at": as_of + _minutes(minutes),
    }
    return _changed(requests, targets, same & _abandoned(as_of, grace_seconds), values)


def unreferenced(claims: DataFrame, objects: DataFrame) -> DataFrame:
    """Claims (candidate_key) whose object no stored file refers to, and which may be deleted. objects: object_key."""
    return claims.join(objects.select(F.col("object_key").alias("candidate_key")), "candidate_key", "left_anti")


def cleaned(requests: DataFrame, claims: DataFrame, as_of: Column) -> DataFrame:
    """Ends the cleaning of claims (cleanup_token, removed): CLEANING is open for a new upload, a removed candidate is gone, one that stays may be tried again."""
    values = {
        "state": F.when(F.col("state") == "CLEANING", "IN_PROGRESS").otherwise(F.col("state")), "lease_expires_at": as_of,
        **{c: F.when(F.col("x_removed"), F.lit(None)).otherwise(F.col(c)) for c in CANDIDATE[:2]}, "cleanup_token": F.lit(None), "cleanup_lease_at": F.lit(None),
    }
    return _changed(requests, claims, F.col("cleanup_token") == F.col("x_cleanup_token"), values)
