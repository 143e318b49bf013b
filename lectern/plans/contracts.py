"""Queries of what may be searched, of complete sets of vectors, of failures and events with their models, and of uploads, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as fn
from lectern.operators import circuit, indexing, outbox, search, uploads
from lectern.plans.catalog import CHUNKS, READABLE, TREE, chunks, now, query, question_vector, readable
from lectern.plans.derived import AS_OF, Tables

VISIBLE = "visible AS (SELECT v.* FROM stored_vectors v JOIN files f ON f.id = v.document_id AND f.current_version_id = v.document_version_id WHERE embedding_model_id = 1 AND v.status = 'ACTIVE' AND f.status = 'INDEXED' AND f.id IN (SELECT id FROM readable))"


def visible(t: Tables) -> DataFrame:
    return indexing.searchable(t.stored_vectors, t.files, readable(t), 1)


@query(f"WITH RECURSIVE {TREE}, {READABLE}, {VISIBLE} SELECT id, chunk_id, document_id FROM visible")
def searchable_vectors(t: Tables) -> DataFrame:
    """FIL-01: all six conditions."""
    return visible(t).select("id", "chunk_id", "document_id")


@query(f"""WITH RECURSIVE {TREE}, {READABLE}, {VISIBLE}, {CHUNKS}, k AS (SELECT chunk_id, document_id, list_cosine_similarity(vector::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS s FROM visible ORDER BY s DESC, chunk_id LIMIT 10)
SELECT k.chunk_id, k.document_id, sha256(c.chunk_text) AS text_hash, f.title AS document_title, round(s, 4) AS similarity FROM k JOIN chunks c USING (chunk_id) JOIN files f ON f.id = k.document_id""")
def searchable_topk(t: Tables) -> DataFrame:
    """JOIN-01: the ten nearest of them with text and title."""
    best = search.scored(visible(t), question_vector(t)).orderBy(F.desc("raw"), "chunk_id").limit(10)
    found = indexing.with_sources(best, chunks(t).select("chunk_id", "chunk_text"), t.files)
    return found.select("chunk_id", "document_id", F.sha2("chunk_text", 256).alias("text_hash"), "document_title", F.round("raw", 4).alias("similarity"))


@query("""WITH v AS (SELECT *, CASE WHEN id % 31 = 4 THEN NULL WHEN id % 37 = 5 THEN 'short' ELSE sha256(id::VARCHAR) END AS vector_hash FROM stored_vectors),
c AS (SELECT doc_id * 1000 AS chunk_id, doc_id * 10 + CASE WHEN doc_id % 23 = 6 THEN 1 ELSE 2 END AS document_version_id FROM documents UNION ALL SELECT doc_id * 1000 + 1, doc_id * 10 + 2 FROM documents WHERE doc_id % 4 = 1),
j AS (SELECT id AS version_id, CASE WHEN id % 4 = 0 THEN 'FAILED' ELSE 'PENDING' END AS status FROM versions),
b AS (SELECT v.*, c.document_version_id AS cv FROM v JOIN c USING (chunk_id) WHERE embedding_model_id = 1),
i AS (SELECT x.id, count(*) AS n FROM versions x JOIN b ON b.document_version_id = x.id OR b.cv = x.id
  WHERE b.document_id <> x.document_id OR b.document_version_id <> x.id OR cv <> x.id OR dimension <> 64 OR len(vector) <> 64 OR vector_hash IS NULL OR NOT regexp_matches(vector_hash, '^[0-9a-f]{64}$') GROUP BY x.id),
k AS (SELECT x.id, (SELECT count(*) FROM c WHERE c.document_version_id = x.id) AS chunks, (SELECT count(*) FROM v WHERE v.document_version_id = x.id) AS all_vectors, (SELECT count(*) FROM v WHERE v.document_version_id = x.id AND embedding_model_id = 1) AS model_vectors,
  (SELECT count(*) FROM v WHERE v.document_version_id = x.id AND embedding_model_id = 1 AND v.status = 'ACTIVE') AS active_vectors, (SELECT count(*) FROM j WHERE version_id = x.id AND j.status IN ('PENDING', 'PROCESSING')) AS live_jobs, coalesce((SELECT n FROM i WHERE i.id = x.id), 0) AS invalid FROM versions x)
SELECT id AS version_id, chunks, all_vectors, model_vectors, active_vectors, live_jobs, invalid, live_jobs = 1 AND chunks > 0 AND model_vectors = chunks AND active_vectors = chunks AND invalid = 0 AS complete FROM k""")
def completion_counts(t: Tables) -> DataFrame:
    """AGG-25: over chunks, vectors and jobs of which some don't fit."""
    hashed = F.when(F.col("id") % 31 == 4, F.lit(None)).when(F.col("id") % 37 == 5, F.lit("short")).otherwise(F.sha2(F.col("id").cast("string"), 256))
    first = t.documents.selectExpr("doc_id * 1000 AS chunk_id", "doc_id * 10 + CASE WHEN doc_id % 23 = 6 THEN 1 ELSE 2 END AS document_version_id")
    parts = first.union(t.documents.filter("doc_id % 4 = 1").selectExpr("doc_id * 1000 + 1", "doc_id * 10 + 2"))
    jobs = t.versions.selectExpr("id AS version_id", "CASE WHEN id % 4 = 0 THEN 'FAILED' ELSE 'PENDING' END AS status")
    return indexing.completion(t.versions, parts, t.stored_vectors.withColumn("vector_hash", hashed), jobs, 1, 64)


ALL_CODES = [*indexing.OWNERSHIP_LOST, *(c for codes in indexing.CODES.values() for c in codes), "SOMETHING_ELSE"]
CODE_OF = f"CASE l_partkey % {len(ALL_CODES) + 1} {' '.join(f'WHEN {k} THEN {c!r}' for k, c in enumerate(ALL_CODES))} END"
TYPE_OF = " ".join(f"WHEN error_code IN ({', '.join(map(repr, codes))}) THEN {name!r}" for name, codes in indexing.CODES.items())


@query(f"""WITH e AS (SELECT {CODE_OF} AS error_code, (l_suppkey * 100)::BIGINT AS d FROM lineitem), k AS (SELECT *, coalesce(error_code IN ({', '.join(map(repr, indexing.OWNERSHIP_LOST))}), FALSE) AS lost FROM e),
x AS (SELECT *, CASE WHEN lost THEN NULL {TYPE_OF} ELSE 'WORKER_INTERNAL_ERROR' END AS failure_type FROM k)
SELECT error_code, NOT lost AS reported, failure_type, failure_type IN ({', '.join(repr(k) for k, v in indexing.RETRYABLE.items() if v)}) AS retryable, count(*) AS n,
  sum(CASE WHEN failure_type IN ({', '.join(map(repr, indexing.PROVIDER_WAITS))}) THEN d WHEN NOT lost THEN 0 END)::BIGINT AS delays FROM x GROUP BY ALL""")
def failure_types(t: Tables) -> DataFrame:
    """STR-27: all types, lost ownership, and the delay that a provider asks for."""
    rows = indexing.classified(t.lineitem.select(F.expr(CODE_OF).alias("error_code"), (F.col("l_suppkey") * 100).cast("long").alias("provider_delay_ms")))
    return rows.groupBy("error_code", "reported", "failure_type", "retryable").agg(F.count("*").alias("n"), F.sum("minimum_delay_ms").alias("delays"))


JOBS_OF_MODELS = "j AS (SELECT id, (SELECT min(doc_id) FROM documents) * 10 + (id % (SELECT count(*) FROM documents)) * 10 + id % 2 + 1 AS version_id, (1 + id % 2)::INT AS embedding_model_id, CASE WHEN id % 6 = 1 THEN 'INDEXED' ELSE status END AS status, CASE WHEN id % 4 = 0 THEN id * 3 END AS source_event_id FROM jobs)"
MODEL_EVENTS = "e AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'DOCUMENT_REINDEX_REQUESTED' ELSE 'DOCUMENT_VERSION_CREATED' END AS event_type, low * 10 + (event_id % (n + 3)) * 10 + event_id % 2 + 1 AS version_id, (1 + event_id % 5)::INT AS embedding_model_id FROM events, (SELECT min(doc_id) AS low, count(*) AS n FROM documents) d)"


@query(f"""WITH {JOBS_OF_MODELS}, {MODEL_EVENTS}, l AS (SELECT version_id, embedding_model_id, arg_max(status, id) AS s FROM j GROUP BY ALL)
SELECT e.event_id, CASE WHEN v.status IS NULL OR m.id IS NULL THEN 'INCONSISTENT' WHEN o.version_id = e.version_id AND o.embedding_model_id = e.embedding_model_id THEN 'ALREADY_HANDLED' WHEN o.version_id IS NOT NULL THEN 'INCONSISTENT'
  WHEN event_type = 'DOCUMENT_REINDEX_REQUESTED' AND s = 'FAILED' THEN 'RETRY' WHEN event_type = 'DOCUMENT_REINDEX_REQUESTED' AND s IN ('PENDING', 'PROCESSING') THEN 'REUSE' WHEN event_type = 'DOCUMENT_REINDEX_REQUESTED' AND s = 'INDEXED' THEN 'REPAIR_VECTORS'
  WHEN s IS NOT NULL OR v.status NOT IN ('UPLOADED', 'PARSING', 'CHUNKED', 'EMBEDDING') THEN 'INCONSISTENT' ELSE 'CREATE_JOB' END AS decision
FROM e LEFT JOIN versions v ON v.id = e.version_id LEFT JOIN models m ON m.id = e.embedding_model_id LEFT JOIN j o ON o.source_event_id = e.event_id LEFT JOIN l ON l.version_id = e.version_id AND l.embedding_model_id = e.embedding_model_id""")
def model_event_decisions(t: Tables) -> DataFrame:
    """STR-24: with models."""
    span = t.documents.agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    jobs = t.jobs.crossJoin(F.broadcast(span)).selectExpr("id", "low * 10 + (id % n) * 10 + id % 2 + 1 AS version_id", "cast(1 + id % 2 AS int) AS embedding_model_id", "CASE WHEN id % 6 = 1 THEN 'INDEXED' ELSE status END AS status", "CASE WHEN id % 4 = 0 THEN id * 3 END AS source_event_id")
    events = t.events.crossJoin(F.broadcast(span)).selectExpr(
        "event_id", "CASE WHEN event_id % 2 = 0 THEN 'DOCUMENT_REINDEX_REQUESTED' ELSE 'DOCUMENT_VERSION_CREATED' END AS event_type", "low * 10 + (event_id % (n + 3)) * 10 + event_id % 2 + 1 AS version_id", "cast(1 + event_id % 5 AS int) AS embedding_model_id"
    )
    return indexing.model_event_decisions(events, t.versions, t.models, jobs)


@query("SELECT id, CASE WHEN s IN ('ACTIVE', 'IDLE') AND (last_heartbeat_at IS NULL OR last_heartbeat_at <= TIMESTAMP '2001-08-01 23:00:00') THEN 'DEAD' ELSE s END AS effective_status FROM (SELECT id, last_heartbeat_at, CASE status WHEN 'RUNNING' THEN 'ACTIVE' ELSE status END AS s FROM workers)")
def current_workers(t: Tables) -> DataFrame:
    """FIL-16: with the names of the statuses."""
    named = t.workers.withColumn("status", F.when(F.col("status") == "RUNNING", "ACTIVE").otherwise(F.col("status")))
    return indexing.current_workers(named, F.expr("TIMESTAMP_NTZ '2001-08-01 23:00:00'")).select("id", "effective_status")


SOURCES_OF = "d.low + (conv_id * 7 + turn * 3) % d.n, d.low + (conv_id + turn) % d.n"


@query(f"""WITH RECURSIVE {TREE}, {READABLE}, d AS (SELECT min(doc_id) AS low, count(*) AS n FROM documents), h AS (SELECT conv_id AS query_id, turn, [{SOURCES_OF}] AS sources FROM conversations, d),
r AS (SELECT DISTINCT conv_id AS query_id, k AS rank_no, d.low + (conv_id * 5 + k * 11) % d.n AS document_id FROM conversations, d, range(1, 9) AS g(k)),
a AS (SELECT query_id, document_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_no) AS place FROM r WHERE document_id IN (SELECT id FROM readable)) WHERE place <= 3),
u AS (SELECT query_id, turn, unnest(sources) AS document_id FROM h), hidden AS (SELECT DISTINCT query_id, turn FROM u WHERE document_id NOT IN (SELECT id FROM readable)),
s AS (SELECT * FROM (SELECT h.*, row_number() OVER (PARTITION BY h.query_id ORDER BY h.turn DESC) AS back FROM h ANTI JOIN hidden ON hidden.query_id = h.query_id AND hidden.turn = h.turn) WHERE back <= 3)
SELECT query_id, document_id FROM a UNION SELECT query_id, unnest(sources) FROM s""")
def prompt_sources(t: Tables) -> DataFrame:
    """RET-10: the sources of each prompt: of its first three readable results, and of the earlier turns all of whose sources are readable."""
    span = t.documents.agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    turns = t.conversations.select("conv_id", "turn").crossJoin(F.broadcast(span))
    history = turns.selectExpr("conv_id AS query_id", "turn", "array(low + (conv_id * 7 + turn * 3) % n, low + (conv_id + turn) % n) AS sources")
    results = turns.select("conv_id", "low", "n").distinct().selectExpr("conv_id AS query_id", "low", "n", "explode(sequence(1, 8)) AS rank_no").selectExpr("query_id", "rank_no", "low + (query_id * 5 + rank_no * 11) % n AS document_id")
    return indexing.prepared(results, history, readable(t))[2]


ABANDONED = f"candidate_key IS NOT NULL AND candidate_at <= {AS_OF} - INTERVAL '6' HOUR AND (state = 'COMPLETED' OR state IN ('IN_PROGRESS', 'CLEANING') AND lease_expires_at <= {AS_OF}) AND (cleanup_lease_at IS NULL OR cleanup_lease_at <= {AS_OF})"


@query(f"""WITH a AS (SELECT *, state = 'IN_PROGRESS' AND owner_token = 'o2' AS d FROM uploads),
b AS (SELECT user_id, request_key, CASE WHEN d THEN 'COMPLETED' ELSE state END AS state, owner_token, lease_expires_at, CASE WHEN d AND request_key < 'upload-5' THEN NULL ELSE candidate_key END AS candidate_key, CASE WHEN d AND request_key < 'upload-5' THEN NULL ELSE candidate_at END AS candidate_at, cleanup_token, cleanup_lease_at FROM a),
c AS (SELECT *, {ABANDONED} AS taken FROM b), e AS (SELECT *, taken AND candidate_key NOT IN (SELECT concat('k', s_suppkey % 60) FROM supplier WHERE s_suppkey % 60 < 20) AS removed FROM c)
SELECT user_id, request_key, CASE WHEN taken AND state = 'CLEANING' THEN 'IN_PROGRESS' ELSE state END AS state, CASE WHEN taken THEN {AS_OF} ELSE lease_expires_at END AS lease_expires_at, CASE WHEN removed THEN NULL ELSE candidate_key END AS candidate_key,
  CASE WHEN taken THEN concat('new-', request_key) ELSE owner_token END AS owner_token, CASE WHEN taken THEN NULL ELSE cleanup_token END AS cleanup_token FROM e""")
def upload_cleanup(t: Tables) -> DataFrame:
    """STR-22: uploads after their owners completed some, and the abandoned candidates of the rest were taken, deleted unless a file refers to them, and let go."""
    keys = t.uploads.select("user_id", "request_key")
    done = keys.select("*", F.lit("o2").alias("owner_token"), F.lit(1).cast("long").alias("document_id"), (F.col("request_key") < "upload-5").alias("claimed"))
    rows = uploads.completed(t.uploads, done)
    targets = rows.filter("candidate_key IS NOT NULL").select("user_id", "request_key", "candidate_key", F.concat(F.lit("new-"), "request_key").alias("owner_token"), F.concat(F.lit("clean-"), "request_key").alias("cleanup_token"))
    rows = uploads.reserved(rows, targets, now(), 6 * 3600)
    claims = rows.filter("done").select("user_id", "request_key", "candidate_key", "cleanup_token")
    files = t.supplier.filter("s_suppkey % 60 < 20").select(F.concat(F.lit("k"), (F.col("s_suppkey") % 60).cast("string")).alias("object_key"))
    free = uploads.unreferenced(claims, files).select("user_id", "request_key", F.lit(True).alias("removed"))
    ended = claims.join(free, ["user_id", "request_key"], "left").select("user_id", "request_key", "cleanup_token", F.coalesce("removed", F.lit(False)).alias("removed"))
    return uploads.cleaned(rows, ended, now()).select("user_id", "request_key", "state", "lease_expires_at", "candidate_key", "owner_token", "cleanup_token")


@query(f"SELECT user_id, request_key, candidate_key FROM uploads WHERE {ABANDONED} ORDER BY candidate_at, user_id, request_key LIMIT 100")
def cleanup_targets(t: Tables) -> DataFrame:
    """STR-22: a page of candidates to clean up; the limit is the operator's own."""
    return uploads.cleanup_targets(t.uploads, now(), 6 * 3600, 100)


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 3) AS squares, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) * (embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)))), 5) AS first FROM embeddings")
def vector_round_trip(t: Tables) -> DataFrame:
    """The vector's text form read back, and its unit form stretched again, against the stored numbers."""
    v = F.col("embedding")
    back = fn.parse_vector(fn.vector_text(v))
    squares = F.aggregate(back, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    unit = fn.normalised(v)
    return t.embeddings.select("vec_id", F.round(squares, 3).alias("squares"), F.round(F.sqrt(squares) * F.get(unit, F.lit(0)), 5).alias("first"))


# -- outbox, answers, failures, snapshots

EVENTS_AT = "TIMESTAMP_NTZ '2024-01-15 00:00:00'"
OUTBOX = f"""SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'PROCESSING' WHEN event_id % 11 = 1 THEN 'DONE' ELSE 'PENDING' END AS status, ts AS occurred_at, ts + CAST(event_id % 5 AS INT) * INTERVAL '1' HOUR AS available_at,
  CASE WHEN event_id % 3 = 0 THEN ts + CAST(event_id % 700 AS INT) * INTERVAL '1' HOUR END AS lock_expires_at, CAST(event_id % 4 AS INT) AS retry_count, 3 AS max_retry_count FROM events"""
ANSWERS = f"""SELECT conv_id * 100 + turn AS id, CASE WHEN turn % 3 = 1 THEN 'DONE' ELSE 'PROCESSING' END AS status, {EVENTS_AT} - CAST((conv_id * 37 + turn * 11) % 900 AS INT) * INTERVAL '1' MINUTE AS created_at,
  CASE WHEN (conv_id + turn) % 4 > 0 THEN concat('c', CAST(conv_id AS STRING)) END AS claim_token, CASE WHEN (conv_id + turn) % 4 > 0 THEN {EVENTS_AT} + CAST(conv_id % 7 - 3 AS INT) * INTERVAL '1' MINUTE END AS claim_lease_until FROM conversations"""


def _plain(text: str) -> str:
    return text.replace("TIMESTAMP_NTZ '", "TIMESTAMP '").replace("AS STRING)", "AS VARCHAR)")


def _from(t: Tables, text: str, **tables: DataFrame) -> DataFrame:
    for name in tables:
        text = text.replace(f"FROM {name}", f"FROM {{{name}}}")
    return t.spark.sql(text, **tables)


def moment() -> Column:
    return F.expr(EVENTS_AT)


@query(f"WITH o AS ({_plain(OUTBOX)}) SELECT row_number() OVER (ORDER BY available_at, occurred_at, id) - 1 AS slot, id, available_at, occurred_at FROM o WHERE status = 'PENDING' AND available_at <= {EVENTS_AT} ORDER BY available_at, occurred_at, id LIMIT 50")
def claimed_events(t: Tables) -> DataFrame:
    """STR-02; the slots are the operator's own limit."""
    return outbox.claimed_events(_from(t, OUTBOX, events=t.events), moment(), 50)


@query(f"""WITH o AS ({_plain(OUTBOX)}) SELECT id, lock_expires_at, retry_count + 1 AS retry_count, CASE WHEN retry_count + 1 < max_retry_count THEN 'PENDING' ELSE 'FAILED' END AS next_status, CASE WHEN retry_count + 1 < max_retry_count THEN least(1000 * pow(2, retry_count), 60000)::BIGINT END AS delay_ms
FROM o WHERE status = 'PROCESSING' AND lock_expires_at <= {EVENTS_AT} ORDER BY lock_expires_at, id LIMIT 200""")
def recovered_events(t: Tables) -> DataFrame:
    """STR-29, TOP-07; the batch is the operator's own limit."""
    return outbox.recovered_events(_from(t, OUTBOX, events=t.events), moment(), 200)


@query(f"WITH a AS ({_plain(ANSWERS)}) SELECT row_number() OVER (ORDER BY created_at, id) - 1 AS slot, id, created_at FROM a WHERE status = 'PROCESSING' AND (claim_token IS NULL OR claim_lease_until < {EVENTS_AT}) ORDER BY created_at, id LIMIT 50")
def claimable_answers(t: Tables) -> DataFrame:
    """STR-03; the slots are the operator's own limit."""
    return outbox.claimable_answers(_from(t, ANSWERS, conversations=t.conversations), moment(), 50)


FAILED = """SELECT id AS job_id, low * 10 + (id % n) * 10 + id % 2 + 1 AS version_id, retry_count, max_retry_count, id % 3 > 0 AS retryable, created_at AS failed_at, CAST(id % 9 * 1000 AS BIGINT) AS minimum_delay_ms FROM jobs"""
IN_WORKS = "SELECT id, document_id, CASE WHEN id % 7 < 4 THEN CASE id % 4 WHEN 0 THEN 'UPLOADED' WHEN 1 THEN 'PARSING' WHEN 2 THEN 'CHUNKED' ELSE 'EMBEDDING' END ELSE status END AS status FROM versions"
DOCS_NOW = "SELECT id, CASE WHEN id % 5 = 0 THEN 'UPLOADED' ELSE status END AS status, CASE WHEN id % 3 = 0 THEN id * 10 + 1 ELSE current_version_id END AS current_version_id FROM files"


@query(f"""WITH d AS (SELECT min(doc_id) AS low, count(*) AS n FROM documents), f AS ({FAILED}, d), v AS ({IN_WORKS}), g AS ({DOCS_NOW}),
x AS (SELECT f.*, v.document_id, v.status AS vs, g.status AS ds, g.current_version_id AS cur, c.document_id AS cd, c.status AS cs FROM f JOIN v ON v.id = f.version_id JOIN g ON g.id = v.document_id LEFT JOIN v c ON c.id = g.current_version_id),
y AS (SELECT *, CASE WHEN vs NOT IN ('UPLOADED', 'PARSING', 'CHUNKED', 'EMBEDDING') THEN 'INCONSISTENT' WHEN retryable AND retry_count + 1 < max_retry_count THEN 'RETRY' WHEN cs IS NULL OR cd <> document_id THEN 'INCONSISTENT'
  WHEN cur <> version_id AND cs = 'INDEXED' AND ds = 'INDEXED' THEN 'FAILED_DOCUMENT_KEPT' WHEN (cur = version_id OR cs = 'FAILED') AND ds IN ('UPLOADED', 'INDEXING', 'FAILED') THEN 'FAILED' ELSE 'INCONSISTENT' END AS outcome FROM x)
SELECT job_id, outcome, CASE WHEN outcome = 'RETRY' THEN 'PENDING' WHEN outcome LIKE 'FAILED%' THEN 'FAILED' ELSE 'PROCESSING' END AS job_status,
  CASE WHEN outcome = 'RETRY' THEN failed_at + to_milliseconds(greatest(least(1000 * pow(2, retry_count), 60000)::BIGINT, minimum_delay_ms)) END AS next_retry_at, CASE WHEN outcome LIKE 'FAILED%' THEN 'FAILED' ELSE vs END AS version_status,
  CASE WHEN outcome = 'FAILED' THEN 'FAILED' ELSE ds END AS document_status, outcome LIKE 'FAILED%' AS vectors_stale, CASE WHEN outcome <> 'INCONSISTENT' THEN CASE WHEN vs IN ('UPLOADED', 'PARSING') THEN '{outbox.STAGES["PARSING"]}' ELSE '{outbox.STAGES["EMBEDDING"]}' END END AS stage_event FROM y""")
def failure_transitions(t: Tables) -> DataFrame:
    """STR-26."""
    span = t.documents.agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    failed = _from(t, FAILED, jobs=t.jobs.crossJoin(F.broadcast(span)))
    return outbox.failure_transitions(failed, _from(t, IN_WORKS, versions=t.versions), _from(t, DOCS_NOW, files=t.files))


PARENTS = {"chunk": ("chunk_id", "SELECT doc_id * 1000 AS id FROM documents WHERE doc_id % 13 <> 5"), "document": ("document_id", "SELECT id FROM files WHERE lang <> 'fr'"), "version": ("document_version_id", "SELECT id FROM versions WHERE status <> 'FAILED'"), "model": ("embedding_model_id", "SELECT id FROM models WHERE id <> 2")}


@query(f"""WITH {', '.join(f'{k}s AS ({text})' for k, (_, text) in PARENTS.items()).replace('models AS', 'kinds AS').replace('versions AS', 'kept AS').replace('documents AS', 'docs AS')},
m AS (SELECT v.id, list_filter([CASE WHEN v.chunk_id NOT IN (SELECT id FROM chunks) THEN 'chunk' END, CASE WHEN v.document_id NOT IN (SELECT id FROM docs) THEN 'document' END, CASE WHEN v.document_version_id NOT IN (SELECT id FROM kept) THEN 'version' END, CASE WHEN v.embedding_model_id NOT IN (SELECT id FROM kinds) THEN 'model' END], lambda x: x IS NOT NULL) AS gone FROM stored_vectors v)
SELECT id, array_to_string(gone, ',') AS missing FROM m WHERE len(gone) > 0""")
def orphaned_vectors(t: Tables) -> DataFrame:
    """JOIN-06: four parents, of each of which some are gone."""
    chunks_ = t.documents.filter("doc_id % 13 <> 5").selectExpr("doc_id * 1000 AS chunk_id")
    return outbox.orphaned(t.stored_vectors, chunks_, t.files.filter("lang <> 'fr'"), t.versions.filter("status <> 'FAILED'"), t.models.filter("id <> 2"))


@query(f"""WITH o AS ({_plain(OUTBOX)}), a AS ({_plain(ANSWERS)}), w AS (SELECT CASE status WHEN 'RUNNING' THEN 'ACTIVE' ELSE status END AS status, last_heartbeat_at FROM workers), j AS (SELECT *, status = 'PENDING' AND (next_retry_at IS NULL OR next_retry_at <= {AS_OF}) AS due FROM jobs)
SELECT (SELECT count(*) FROM j WHERE due) AS claimable_jobs, (SELECT count(*) FROM j WHERE status = 'PENDING' AND next_retry_at > {AS_OF}) AS delayed_jobs, (SELECT count(*) FROM j WHERE status = 'PROCESSING') AS processing_jobs, (SELECT min(coalesce(next_retry_at, created_at)) FROM j WHERE due) AS oldest_job_at,
  (SELECT count(*) FROM w WHERE status IN ('ACTIVE', 'IDLE') AND last_heartbeat_at > TIMESTAMP '2001-08-01 22:30:00') AS active_workers, (SELECT count(*) FROM a WHERE status = 'PROCESSING') AS processing_answers, (SELECT min(created_at) FROM a WHERE status = 'PROCESSING') AS oldest_answer_at,
  (SELECT count(*) FROM o WHERE status = 'PENDING' AND available_at <= {AS_OF} + INTERVAL '8200' DAY) AS claimable_events, (SELECT count(*) FROM o WHERE status = 'PROCESSING') AS processing_events, (SELECT min(available_at) FROM o WHERE status = 'PENDING' AND available_at <= {AS_OF} + INTERVAL '8200' DAY) AS oldest_event_at""")
def operations_snapshot(t: Tables) -> DataFrame:
    """AGG-16. The outbox's clock runs some years ahead of that of the jobs, so its times are set back."""
    back = lambda c: F.col(c) - F.expr("INTERVAL '8200' DAY")
    events = _from(t, OUTBOX, events=t.events).withColumn("available_at", back("available_at"))
    workers = t.workers.withColumn("status", F.when(F.col("status") == "RUNNING", "ACTIVE").otherwise(F.col("status")))
    out = outbox.operations(t.jobs, workers, _from(t, ANSWERS, conversations=t.conversations), events, now(), F.expr("TIMESTAMP_NTZ '2001-08-01 22:30:00'"))
    return out.withColumn("oldest_event_at", F.col("oldest_event_at") + F.expr("INTERVAL '8200' DAY"))


@query(f"""SELECT (SELECT count(*) FROM files WHERE status <> 'DELETED') AS documents, (SELECT count(*) FROM files WHERE status = 'INDEXED') AS indexed, (SELECT count(*) FROM files WHERE status IN ('UPLOADED', 'INDEXING')) AS pending_documents, (SELECT count(*) FROM jobs WHERE status = 'PENDING') AS pending_jobs,
  (SELECT count(*) FROM jobs WHERE status = 'PROCESSING') AS processing_jobs, (SELECT count(*) FROM jobs WHERE status = 'FAILED') AS failed_jobs, (SELECT round(avg(seconds * 1000))::BIGINT FROM attempts WHERE status = 'DONE') AS mean_ms, (SELECT count(*) FROM workers WHERE status IN ('RUNNING', 'IDLE')) AS active_workers, (SELECT count(*) FROM workers) AS workers,
  (SELECT count(*) FROM events WHERE event_type = 'search' AND ts > {EVENTS_AT} - INTERVAL '24' HOUR) AS recent_searches""")
def dashboard(t: Tables) -> DataFrame:
    """AGG-14: all parts."""
    workers = t.workers.withColumn("status", F.when(F.col("status") == "RUNNING", "ACTIVE").otherwise(F.col("status")))
    return outbox.dashboard(t.files, t.jobs, t.attempts, workers, t.events.filter("event_type = 'search'").withColumnRenamed("ts", "created_at"), moment())


@query(f"""WITH RECURSIVE {TREE}, {READABLE}, d AS (SELECT min(doc_id) AS low, count(*) AS n FROM documents), q AS (SELECT conv_id * 100 + turn AS query_id, conv_id, turn, text, low, n FROM conversations, d),
r AS (SELECT query_id, k AS rank_no, (low + (query_id * 5 + k * 11) % n) * 1000 AS chunk_id, low + (query_id * 5 + k * 11) % n AS document_id FROM q, range(1, 5) AS g(k)),
a AS (SELECT query_id, text AS answer, CASE WHEN turn % 5 = 4 THEN NULL ELSE [low + (query_id * 5 + 11) % n, low + query_id % n] END AS sources FROM q WHERE turn % 2 = 1),
c AS (SELECT query_id, rank_no AS citation_order, chunk_id, 'p' || rank_no AS quote, rank_no * 2 AS page_no, 1.0 / rank_no AS score, document_id FROM r WHERE rank_no <= 2 AND query_id % 3 > 0),
s AS (SELECT query_id, string_agg(rank_no || ':' || chunk_id, ',' ORDER BY rank_no) AS results FROM r WHERE document_id IN (SELECT id FROM readable) GROUP BY 1),
k AS (SELECT query_id, string_agg('[' || citation_order || ']' || chunk_id, ',' ORDER BY citation_order) AS citations, bool_and(document_id IN (SELECT id FROM readable)) AS ok FROM c GROUP BY 1),
b AS (SELECT DISTINCT query_id FROM (SELECT query_id, unnest(sources) AS x FROM a) WHERE x NOT IN (SELECT id FROM readable)),
z AS (SELECT q.*, s.results, a.answer, k.citations, a.answer IS NOT NULL AND (a.sources IS NULL OR q.query_id IN (SELECT query_id FROM b) OR NOT coalesce(k.ok, TRUE)) AS withheld FROM q LEFT JOIN s USING (query_id) LEFT JOIN a USING (query_id) LEFT JOIN k USING (query_id))
SELECT conv_id, query_id, results, CASE WHEN NOT withheld THEN sha256(answer) END AS answer_hash, CASE WHEN NOT withheld THEN citations END AS citations, withheld FROM z""")
def conversation_turns(t: Tables) -> DataFrame:
    """JOIN-15: turns with results, answers and citations under the present rights."""
    span = t.documents.agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    q = t.conversations.crossJoin(F.broadcast(span)).selectExpr("conv_id * 100 + turn AS query_id", "conv_id", "turn", "text", "low", "n")
    r = q.selectExpr("*", "explode(sequence(1, 4)) AS rank_no").selectExpr("query_id", "rank_no", "(low + (query_id * 5 + rank_no * 11) % n) * 1000 AS chunk_id", "low + (query_id * 5 + rank_no * 11) % n AS document_id")
    a = q.filter("turn % 2 = 1").selectExpr("query_id", "text AS answer", "CASE WHEN turn % 5 = 4 THEN NULL ELSE array(low + (query_id * 5 + 11) % n, low + query_id % n) END AS sources")
    c = r.filter("rank_no <= 2 AND query_id % 3 > 0").selectExpr("query_id", "rank_no AS citation_order", "chunk_id", "concat('p', rank_no) AS quote", "rank_no * 2 AS page_no", "1.0D / rank_no AS score", "document_id")
    out = outbox.conversation_turns(q.select("query_id", "conv_id", "turn", "text"), r, a, c, readable(t))
    joined = lambda name, f: F.array_join(F.transform(name, f), ",")
    return out.select(
        "conv_id", "query_id", joined("results", lambda x: F.concat(x["rank_no"].cast("string"), F.lit(":"), x["chunk_id"].cast("string"))).alias("results"), F.sha2("answer", 256).alias("answer_hash"),
        joined("citations", lambda x: F.concat(x["label"], x["chunk_id"].cast("string"))).alias("citations"), "withheld",
    )


@query("""WITH k AS (SELECT n_nationkey, n_name, n_regionkey FROM nation ORDER BY n_name LIMIT 10 OFFSET 20)
SELECT concat('{"content":[', (SELECT string_agg(concat('{"n_nationkey":', n_nationkey, ',"n_name":"', n_name, '","n_regionkey":', n_regionkey, '}'), ',' ORDER BY n_name) FROM k), '],"page":2,"size":10,"totalElements":', (SELECT count(*) FROM nation), ',"totalPages":', (SELECT ceil(count(*) / 10)::INT FROM nation), ',"first":false,"last":true}') AS value""")
def page_envelope(t: Tables) -> DataFrame:
    """SRC-24: the third page of nations by name; the page is the feature."""
    return outbox.envelope(t.nation.select("n_nationkey", "n_name", "n_regionkey"), [F.asc("n_name")], 2, 10)


@query("""WITH RECURSIVE c AS (SELECT user_id AS key, event_id AS call_id, epoch_us(ts) // 1000 AS ms, value > 60 AS bad, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS nth FROM events),
r AS (SELECT key, 0::BIGINT AS call_id, 0::BIGINT AS nth, FALSE AS admitted, 'CLOSED' AS seen, 0::BIGINT AS wait_ms, 'CLOSED' AS state, 0 AS failures, 0::BIGINT AS until FROM (SELECT DISTINCT key FROM c) UNION ALL
  SELECT key, call_id, nth, ok, CASE WHEN NOT ok THEN 'OPEN' WHEN state = 'CLOSED' THEN 'CLOSED' ELSE 'HALF_OPEN' END, CASE WHEN ok THEN 0 ELSE until - ms END,
    CASE WHEN NOT ok THEN 'OPEN' WHEN bad AND (state <> 'CLOSED' OR failures + 1 >= 3) THEN 'OPEN' ELSE 'CLOSED' END, CASE WHEN ok AND bad AND state = 'CLOSED' AND failures + 1 < 3 THEN failures + 1 ELSE 0 END, CASE WHEN ok AND bad AND (state <> 'CLOSED' OR failures + 1 >= 3) THEN ms + 172800000 ELSE until END
  FROM (SELECT c.*, r.state, r.failures, r.until, r.state <> 'OPEN' OR c.ms >= r.until AS ok FROM r JOIN c ON c.key = r.key AND c.nth = r.nth + 1))
SELECT key, call_id, admitted, seen AS state, wait_ms FROM r WHERE nth > 0""")
def circuit_breaker(t: Tables) -> DataFrame:
    """ING-09: each user's events as calls of no length; three failures in a row open a circuit for two days."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    calls = t.events.select(F.col("user_id").alias("key"), F.col("event_id").alias("call_id"), ms.alias("at_ms"), ms.alias("end_ms"), F.when(F.col("value") > 60, "FAILURE").otherwise("SUCCESS").alias("outcome"))
    return circuit.replayed(calls, 3, 172_800_000)
