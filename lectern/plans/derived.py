"""Tables that the supplied data lacks (users, grants, collections, jobs, ...), derived from it by arithmetic.

Each is a SELECT that reads the same in Spark and in ANSI SQL, so that both sides of a check start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "orders", "lineitem", "events", "documents", "embeddings", "labels", "conversations", "part", "supplier", "pages", "benchmark")

#: Fixed moments that stand for "now".
AS_OF = "TIMESTAMP_NTZ '2001-08-02 00:00:00'"

DERIVED = {
    "users": """SELECT c_custkey AS id, c_nationkey AS department_id, c_name AS name, concat(lower(replace(c_name, '#', '.')), '@mail.test') AS email,
        CASE WHEN c_custkey % 29 = 0 THEN 'DELETED' WHEN c_custkey % 31 = 0 THEN 'LOCKED' ELSE 'ACTIVE' END AS status FROM customer""",
    "user_roles": """SELECT id AS user_id, id % 5 + 1 AS role_id FROM users UNION ALL SELECT id AS user_id, 6 AS role_id FROM users WHERE id % 10 = 0""",
    "roles": """SELECT r_regionkey + 1 AS id, concat('ROLE_', r_name) AS code FROM region UNION ALL SELECT 6 AS id, 'ADMIN' AS code FROM region WHERE r_regionkey = 0""",
    "files": """SELECT doc_id AS id, owner_user_id, title, visibility, status, current_version_id, source, lang FROM (
        SELECT doc_id, doc_id % 150 + 1 AS owner_user_id, concat(source, '/', lang) AS title, source, lang,
        CASE doc_id % 4 WHEN 0 THEN 'PRIVATE' WHEN 1 THEN 'COLLECTION' WHEN 2 THEN 'DEPARTMENT' ELSE 'PUBLIC' END AS visibility,
        CASE WHEN doc_id % 17 = 0 THEN 'INDEXING' WHEN doc_id % 23 = 0 THEN 'DELETED' ELSE 'INDEXED' END AS status,
        CASE WHEN doc_id % 41 = 0 THEN NULL ELSE doc_id * 10 + 2 END AS current_version_id FROM documents) AS d""",
    "versions": """SELECT doc_id * 10 + 1 AS id, doc_id AS document_id, 1 AS version_no, 'INDEXED' AS status, 400 AS age_minutes FROM documents UNION ALL
        SELECT doc_id * 10 + 2 AS id, doc_id AS document_id, 2 AS version_no,
        CASE WHEN doc_id % 17 = 0 THEN 'EMBEDDING' WHEN doc_id % 19 = 0 THEN 'FAILED' WHEN doc_id % 37 = 0 THEN 'PARSING' ELSE 'INDEXED' END AS status, CAST(doc_id % 90 AS INT) AS age_minutes FROM documents""",
    "collections": """SELECT 1000 + r_regionkey AS id, CAST(NULL AS INT) AS parent_id, r_name AS name, 'by region' AS description, 1 AS owner_user_id, 'PUBLIC' AS visibility, 'ACTIVE' AS status, CAST(r_regionkey AS INT) AS created_day FROM region UNION ALL
        SELECT 2000 + n_nationkey AS id, 1000 + n_regionkey AS parent_id, n_name AS name, CAST(NULL AS STRING) AS description, n_nationkey % 7 + 1 AS owner_user_id,
        CASE n_nationkey % 3 WHEN 0 THEN 'PRIVATE' WHEN 1 THEN 'DEPARTMENT' ELSE 'PUBLIC' END AS visibility, CASE WHEN n_nationkey % 8 = 7 THEN 'DELETED' ELSE 'ACTIVE' END AS status, CAST(n_nationkey % 5 AS INT) AS created_day FROM nation UNION ALL
        SELECT 3000 + n_nationkey AS id, 2000 + n_nationkey AS parent_id, concat('Shelf ', n_name) AS name, 'shelf' AS description, n_nationkey % 11 + 1 AS owner_user_id,
        CASE n_nationkey % 2 WHEN 0 THEN 'PRIVATE' ELSE 'COLLECTION' END AS visibility, 'ACTIVE' AS status, CAST(n_nationkey % 3 AS INT) AS created_day FROM nation""",
    "collection_documents": "SELECT CAST(3000 + doc_id % 25 AS INT) AS collection_id, doc_id AS document_id FROM documents",
    "document_grants": """SELECT doc_id AS document_id, CASE doc_id % 3 WHEN 0 THEN 'USER' WHEN 1 THEN 'DEPARTMENT' ELSE 'ROLE' END AS target_type,
        CASE WHEN doc_id % 3 = 0 THEN doc_id % 13 + 1 END AS user_id, CASE WHEN doc_id % 3 = 1 THEN doc_id % 25 END AS department_id, CASE WHEN doc_id % 3 = 2 THEN doc_id % 5 + 1 END AS role_id,
        doc_id % 2 = 0 OR doc_id % 7 = 3 AS can_read, doc_id % 9 = 0 AS can_write, doc_id % 27 = 0 AS can_admin,
        CASE WHEN doc_id % 11 = 0 THEN TIMESTAMP_NTZ '2000-01-01 00:00:00' WHEN doc_id % 11 = 1 THEN TIMESTAMP_NTZ '2030-01-01 00:00:00' END AS expires_at FROM documents WHERE doc_id % 5 < 2""",
    "collection_grants": """SELECT id AS collection_id, CASE id % 3 WHEN 0 THEN 'USER' WHEN 1 THEN 'DEPARTMENT' ELSE 'ROLE' END AS target_type,
        CASE WHEN id % 3 = 0 THEN id % 13 + 1 END AS user_id, CASE WHEN id % 3 = 1 THEN id % 25 END AS department_id, CASE WHEN id % 3 = 2 THEN id % 5 + 1 END AS role_id,
        TRUE AS can_read, id % 4 = 0 AS can_write, FALSE AS can_admin, CASE WHEN id % 8 = 0 THEN TIMESTAMP_NTZ '2000-01-01 00:00:00' END AS expires_at FROM collections WHERE id % 2 = 0 OR id < 2000""",
    "access_cache": """SELECT (doc_id * 7) % 150 + 1 AS user_id, doc_id AS document_id, TRUE AS can_read, doc_id % 4 = 0 AS can_write, FALSE AS can_admin,
        CASE doc_id % 3 WHEN 0 THEN 'OWNER' WHEN 1 THEN 'DIRECT_DOCUMENT_PERMISSION' ELSE 'DIRECT_COLLECTION_PERMISSION' END AS source_type, doc_id % 6 = 0 AS invalidated,
        CASE WHEN doc_id % 13 = 0 THEN TIMESTAMP_NTZ '2000-01-01 00:00:00' END AS expires_at FROM documents WHERE doc_id % 8 < 5""",
    "jobs": """SELECT o_orderkey AS id, o_custkey AS version_id, CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'PROCESSING' ELSE 'FAILED' END AS status,
        CAST(substring(o_orderpriority, 1, 1) AS INT) AS priority, CAST(o_orderkey % 4 AS INT) AS retry_count, 3 AS max_retry_count, o_orderdate AS created_at,
        CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL '5' DAY END AS next_retry_at, CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL '30' DAY END AS lock_expires_at,
        o_orderkey % 10 AS worker_id FROM orders""",
    "workers": """SELECT s_suppkey AS id, s_name AS name, CASE s_suppkey % 4 WHEN 0 THEN 'STOPPED' WHEN 1 THEN 'IDLE' ELSE 'RUNNING' END AS status,
        CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE TIMESTAMP_NTZ '2001-08-01 23:00:00' END AS last_heartbeat_at, CAST(s_suppkey % 120 AS INT) AS idle_minutes FROM supplier""",
    "stored_vectors": """SELECT vec_id AS id, vec_id * 1000 AS chunk_id, vec_id AS document_id, vec_id * 10 + CASE WHEN vec_id % 9 = 4 THEN 1 ELSE 2 END AS document_version_id, CASE WHEN vec_id % 13 = 5 THEN 2 ELSE 1 END AS embedding_model_id,
        CASE WHEN vec_id % 11 = 3 THEN 'STALE' ELSE 'ACTIVE' END AS status, CASE WHEN vec_id % 29 = 7 THEN 32 ELSE 64 END AS dimension, embedding AS vector FROM embeddings""",
    "models": "SELECT CAST(r_regionkey AS INT) AS id FROM region WHERE r_regionkey BETWEEN 1 AND 3",
    "uploads": """SELECT c_custkey % 9 AS user_id, concat('upload-', CAST(c_custkey AS STRING)) AS request_key, c_mktsegment AS input_fingerprint, CASE c_custkey % 5 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'CLEANING' ELSE 'IN_PROGRESS' END AS state,
        concat('o', CAST(c_custkey % 4 AS STRING)) AS owner_token, CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP_NTZ '2001-08-02 00:04:00' ELSE TIMESTAMP_NTZ '2001-08-01 23:00:00' END AS lease_expires_at,
        CASE WHEN c_custkey % 7 > 1 THEN concat('k', CAST(c_custkey % 50 AS STRING)) END AS candidate_key, CASE WHEN c_custkey % 7 > 1 THEN TIMESTAMP_NTZ '2001-08-01 00:00:00' + CAST(c_custkey % 30 AS INT) * INTERVAL '1' HOUR END AS candidate_at,
        CASE WHEN c_custkey % 7 > 1 AND c_custkey % 8 = 0 THEN concat('c', CAST(c_custkey % 6 AS STRING)) END AS cleanup_token, CASE WHEN c_custkey % 7 > 1 AND c_custkey % 8 = 0 THEN TIMESTAMP_NTZ '2001-08-01 22:00:00' + CAST(c_custkey % 4 AS INT) * INTERVAL '1' HOUR END AS cleanup_lease_at,
        CASE WHEN c_custkey % 5 = 0 THEN c_custkey END AS document_id FROM customer""",
    "attempts": "SELECT l_orderkey AS job_id, l_linenumber AS attempt_no, l_shipdate AS started_at, l_quantity AS seconds, CASE l_returnflag WHEN 'R' THEN 'FAILED' WHEN 'A' THEN 'TIMEOUT' ELSE 'DONE' END AS status FROM lineitem",
}

#: What each derived table reads.
NEEDS = {"users": ("customer",), "user_roles": ("users",), "roles": ("region",), "files": ("documents",), "versions": ("documents",), "collections": ("region", "nation"), "collection_documents": ("documents",), "document_grants": ("documents",), "collection_grants": ("collections",), "access_cache": ("documents",), "jobs": ("orders",), "workers": ("supplier",), "attempts": ("lineitem",), "stored_vectors": ("embeddings",), "models": ("region",), "uploads": ("customer",)}


_known: dict[tuple[str, str], Tables] = {}


class Tables:
    """Base and derived tables of a data folder, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self.known = spark, sf_dir, {}

    @staticmethod
    def of(spark: SparkSession, sf_dir: str) -> Tables:
        """The tables of a folder as the session knows them: a folder's files are listed and their schemas read once, as a catalog does. Files that change need Tables() anew."""
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in _known:
            _known[key] = Tables(spark, sf_dir)
        return _known[key]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self.known:
            if name in BASE:
                self.known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                text = DERIVED[name]
                for need in NEEDS[name]:
                    text = text.replace(f"FROM {need}", f"FROM {{{need}}}")
                self.known[name] = self.spark.sql(text, **{need: getattr(self, need) for need in NEEDS[name]})
        return self.known[name]


def sql(text: str) -> str:
    """text for DuckDB with the derived tables that it names as common table expressions."""
    used: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, ()):
            if need in DERIVED:
                add(need)
        if name not in used:
            used.append(name)

    words = set(text.replace("(", " ").replace(")", " ").replace(",", " ").split())
    for name in DERIVED:
        if name in words:
            add(name)
    plain = lambda t: t.replace("TIMESTAMP_NTZ '", "TIMESTAMP '").replace("AS STRING)", "AS VARCHAR)")
    ctes = [f"{n} AS ({plain(DERIVED[n])})" for n in used]
    recursive = "RECURSIVE " if "WITH RECURSIVE " in text else ""
    body = plain(text.strip())
    if body.startswith("WITH "):
        return f"WITH {recursive}" + ", ".join([*ctes, body.removeprefix("WITH RECURSIVE ").removeprefix("WITH ")])
    return (f"WITH {', '.join(ctes)} " if ctes else "") + body
