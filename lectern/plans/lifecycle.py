"""Queries of requests, events, answers, cached rights, prompts and audits, with their SQL; registered in the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as fn
from lectern.operators import analytics, chunking, lifecycle, permissions, search
from lectern.plans.catalog import CHUNKS, CITED, JOBS, NEAR, READABLE, TREE, USER, _cited, chunks, now, query, question_vector, readable, vectors, version_jobs
from lectern.plans.derived import AS_OF, Tables

MARK = "TIMESTAMP_NTZ '2000-06-01 00:00:00'"


# -- joins and counts


@query(f"""WITH {JOBS} SELECT f.id AS document_id, f.status, v.id AS processing_version_id, j.id AS job_id FROM files f LEFT JOIN versions v ON v.document_id = f.id AND v.status IN ('UPLOADED', 'PARSING', 'CHUNKED', 'EMBEDDING')
  LEFT JOIN version_jobs j ON j.version_id = v.id AND j.status IN ('PENDING', 'PROCESSING')""")
def document_status(t: Tables) -> DataFrame:
    """JOIN-04: conditions on the right side stand before the outer join, so documents without a match stay."""
    works = t.versions.filter(F.col("status").isin(*lifecycle.RECOVERABLE)).select(F.col("document_id").alias("id"), F.col("id").alias("processing_version_id"))
    live = version_jobs(t).filter(F.col("status").isin(*lifecycle.LIVE_JOBS)).select(F.col("version_id").alias("processing_version_id"), F.col("id").alias("job_id"))
    return t.files.select("id", "status").join(works, "id", "left").join(live, "processing_version_id", "left").select(F.col("id").alias("document_id"), "status", "processing_version_id", "job_id")


@query("SELECT u.id AS user_id, r.id AS role_id FROM users u, roles r WHERE u.status = 'LOCKED' AND r.code = 'ADMIN'")
def seeded_roles(t: Tables) -> DataFrame:
    """JOIN-12: a comma join in which a filter leaves one row of the one side."""
    return t.users.filter("status = 'LOCKED'").select(F.col("id").alias("user_id")).crossJoin(F.broadcast(t.roles.filter("code = 'ADMIN'").select(F.col("id").alias("role_id"))))


@query("SELECT id AS worker_id, n AS slot FROM workers, range(1, 4) AS r(n) WHERE status <> 'STOPPED'")
def worker_slots(t: Tables) -> DataFrame:
    """JOIN-13: rows times a series, as an exploded sequence."""
    return t.workers.filter("status <> 'STOPPED'").select(F.col("id").alias("worker_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("slot"))


@query(f"WITH {JOBS} SELECT v.id AS version_id, v.version_no, max(j.id) AS job_id, arg_max(j.status, j.id) AS job_status FROM versions v LEFT JOIN version_jobs j ON j.version_id = v.id GROUP BY v.id, v.version_no")
def version_history(t: Tables) -> DataFrame:
    """JOIN-14: each version with its latest job."""
    last = version_jobs(t).groupBy("version_id").agg(F.max("id").alias("job_id"), F.max_by("status", "id").alias("job_status"))
    return t.versions.select(F.col("id").alias("version_id"), "version_no").join(last, "version_id", "left")


@query("SELECT conv_id, count(*) AS turns, string_agg(concat(turn, ':', role, ':', length(text)), ',' ORDER BY turn, role, length(text)) AS outline FROM conversations GROUP BY conv_id")
def conversation_detail(t: Tables) -> DataFrame:
    """JOIN-15: the turns of each conversation in one row, in order."""
    part = F.struct("turn", "role", F.length("text").alias("n"))
    rows = t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_sort(F.collect_list(part)).alias("parts"))
    return rows.select("conv_id", "turns", F.array_join(F.transform("parts", lambda x: F.concat_ws(":", x["turn"].cast("string"), x["role"], x["n"].cast("string"))), ",").alias("outline"))


@query(f"WITH {JOBS} SELECT event_type, count(*) AS events, count(j.id) AS with_job FROM events e LEFT JOIN version_jobs j ON j.source_event_id = e.event_id GROUP BY event_type")
def events_with_jobs(t: Tables) -> DataFrame:
    """JOIN-20."""
    jobs = version_jobs(t).filter("source_event_id IS NOT NULL").select(F.col("source_event_id").alias("event_id"), F.col("id").alias("job_id"))
    return t.events.select("event_id", "event_type").join(jobs, "event_id", "left").groupBy("event_type").agg(F.count("*").alias("events"), F.count("job_id").alias("with_job"))


@query(f"WITH {JOBS} SELECT count(*) AS failed_repairs FROM versions v JOIN version_jobs j ON j.version_id = v.id WHERE v.status = 'FAILED' AND j.status = 'FAILED'")
def failed_repairs(t: Tables) -> DataFrame:
    """JOIN-23: what is under repair and whose repair failed, counted."""
    failed = version_jobs(t).filter("status = 'FAILED'").select(F.col("version_id").alias("id"))
    return t.versions.filter("status = 'FAILED'").select("id").join(failed, "id").agg(F.count("*").alias("failed_repairs"))


@query(f"WITH {JOBS} SELECT document_id, count(DISTINCT v.id) AS versions, count(DISTINCT j.id) AS jobs FROM versions v LEFT JOIN version_jobs j ON j.version_id = v.id GROUP BY document_id")
def distinct_counts(t: Tables) -> DataFrame:
    """AGG-06: the fan-out of the join is avoided: jobs are counted by version first."""
    jobs = version_jobs(t).groupBy(F.col("version_id").alias("id")).agg(F.count("*").alias("n"))
    return t.versions.select("id", "document_id").join(jobs, "id", "left").groupBy("document_id").agg(F.count("*").alias("versions"), F.coalesce(F.sum("n"), F.lit(0)).alias("jobs"))


@query("SELECT f.id AS document_id, coalesce(max(version_no), 0) + 1 AS next_version FROM files f LEFT JOIN versions v ON v.document_id = f.id AND v.status = 'FAILED' GROUP BY f.id")
def next_version(t: Tables) -> DataFrame:
    """AGG-09, over the failed versions, so that documents without any stand beside those with one."""
    most = t.versions.filter("status = 'FAILED'").groupBy(F.col("document_id").alias("id")).agg(F.max("version_no").alias("n"))
    return t.files.select("id").join(most, "id", "left").select(F.col("id").alias("document_id"), (F.coalesce("n", F.lit(0)) + 1).alias("next_version"))


@query(f"WITH {NEAR} SELECT label, round(max(s), 6) AS best, count(*) AS n FROM near GROUP BY label")
def best_by_label(t: Tables) -> DataFrame:
    return search.best_by_group(vectors(t), question_vector(t), "label").withColumn("best", F.round("best", 6))


@query("""SELECT (SELECT count(*) FROM embeddings WHERE len(embedding) <> 64) AS wrong_dimension, (SELECT count(*) FROM documents WHERE NOT regexp_matches(CASE WHEN doc_id % 9 = 0 THEN 'x' ELSE md5(coalesce(text, '')) || md5(source) END, '^[0-9a-f]{64}$')) AS wrong_hash,
  (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS without_vector""")
def completion_counts(t: Tables) -> DataFrame:
    """AGG-25, FIL-08: rows that forbid completing an index: wrong dimensions, hashes not of 64 hex digits, documents without a vector."""
    dimension = t.embeddings.agg(F.count_if(F.size("embedding") != 64).alias("wrong_dimension"))
    hashed = F.when(F.col("doc_id") % 9 == 0, F.lit("x")).otherwise(F.concat(F.md5(F.coalesce("text", F.lit("")).cast("binary")), F.md5(F.col("source").cast("binary"))))
    wrong = t.documents.agg(F.count_if(~hashed.rlike("^[0-9a-f]{64}$")).alias("wrong_hash"))
    lacking = t.documents.select("doc_id").join(t.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti").agg(F.count("*").alias("without_vector"))
    return dimension.crossJoin(F.broadcast(wrong)).crossJoin(F.broadcast(lacking))


@query(f"""WITH s AS (SELECT o_orderkey AS request_id, o_orderstatus <> 'F' AS acked, o_orderdate AS sent_at FROM orders), d AS (SELECT l_orderkey AS request_id, count(*) FILTER (l_linenumber < 2 AND l_orderkey % 40 > 0 OR l_orderkey % 50 = 1) AS row_count FROM lineitem GROUP BY 1),
j AS (SELECT s.*, coalesce(row_count, 0) AS n FROM s LEFT JOIN d USING (request_id))
SELECT count(*) FILTER (acked) AS acked, count(*) FILTER (NOT acked) AS refused, count(*) FILTER (acked AND n = 0) AS missing, min(sent_at) FILTER (acked AND n = 0) AS first_missing, max(sent_at) FILTER (acked AND n = 0) AS last_missing,
  count(*) FILTER (n > 1) AS repeated, count(*) FILTER (sent_at >= {MARK}) AS later, count(*) FILTER (sent_at >= {MARK} AND acked AND n = 0) AS later_missing, count(*) FILTER (acked AND n = 0) = 0 AND count(*) FILTER (n > 1) = 0 AS passed FROM j""")
def ledger_audit(t: Tables) -> DataFrame:
    stored = t.lineitem.groupBy(F.col("l_orderkey").alias("request_id")).agg(F.count_if((F.col("l_linenumber") < 2) & (F.col("l_orderkey") % 40 > 0) | (F.col("l_orderkey") % 50 == 1)).alias("row_count"))
    return analytics.ledger_audit(t.orders.selectExpr("o_orderkey AS request_id", "o_orderstatus <> 'F' AS acked", "o_orderdate AS at"), stored, F.expr(MARK))


@query("SELECT event_type, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY event_type")
def observed_bounds(t: Tables) -> DataFrame:
    return analytics.bounds(t.events, "event_type")


# -- functions


@query("SELECT vec_id, md5(array_to_string(list_transform(embedding, lambda x: floor(x::DOUBLE * 1000)::BIGINT), ',')) AS vector_md5 FROM embeddings")
def vector_md5(t: Tables) -> DataFrame:
    """FN-10: MD5 of a vector's text, in whole thousandths, which every engine spells alike."""
    parts = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("string"))
    return t.embeddings.select("vec_id", F.md5(F.array_join(parts, ",").cast("binary")).alias("vector_md5"))


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1)::INT AS ord FROM part")
def words_with_place(t: Tables) -> DataFrame:
    """FN-23: elements with their place, from 1."""
    return t.part.select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("k", "word")).select("p_partkey", "word", (F.col("k") + 1).alias("ord"))


HEADINGS = "[source, lang, substr(text, 1, 30 + doc_id % 250)]"


@query(f"""WITH h AS (SELECT doc_id, text, {HEADINGS} AS h FROM documents WHERE text IS NOT NULL), p AS (SELECT *, [array_to_string(h, ' > '), array_to_string(h[2:], ' > '), h[3]] AS paths FROM h)
SELECT doc_id, sha256(coalesce(list_filter(paths, lambda p: length(p) <= 200)[1], substr(h[3], 1, 200)) || chr(10) || substr(text, 1, 50)) AS input_hash FROM p""")
def embedding_inputs(t: Tables) -> DataFrame:
    """FN-27 over headings of 30 code points or more."""
    headings = F.array("source", "lang", F.substring(F.col("text"), F.lit(1), (F.lit(30) + F.col("doc_id") % 250).cast("int")))
    given = chunking.embedding_input(headings, F.substring("text", 1, 50))
    return t.documents.filter("text IS NOT NULL").select("doc_id", F.sha2(given, 256).alias("input_hash"))


@query("""SELECT id AS version_id, '{"liveJob":true}' AS expected, '{"liveJob":false,"versionStatus":"' || status || '"}' AS actual FROM versions WHERE status IN ('PARSING', 'EMBEDDING')""")
def issue_details(t: Tables) -> DataFrame:
    """FN-29: what an issue expects and what is there, as JSON."""
    actual = F.to_json(F.struct(F.lit(False).alias("liveJob"), F.col("status").alias("versionStatus")))
    return t.versions.filter("status IN ('PARSING', 'EMBEDDING')").select(F.col("id").alias("version_id"), F.to_json(F.struct(F.lit(True).alias("liveJob"))).alias("expected"), actual.alias("actual"))


@query("SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def mapped_names(t: Tables) -> DataFrame:
    """FN-32: a look-up in a map, which is one broadcast row as long as its table is as small as that of nations."""
    names = t.nation.agg(F.map_from_entries(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("names"))
    return t.customer.crossJoin(F.broadcast(names)).select("c_custkey", F.try_element_at("names", F.col("c_nationkey")).alias("nation"))


# -- indexing


def hashed_encoder(texts: list[str]) -> list[list[float]]:
    """Stands for an embedding model: eight numbers from a text's bytes."""
    import hashlib

    return [[x / 255 for x in hashlib.sha256(s.encode()).digest()[:8]] for s in texts]


@query()
def encoded_chunks(t: Tables) -> DataFrame:
    """ING-06, ING-07 with an encoder that stands for the model."""
    out = chunking.embedded(chunks(t), hashed_encoder, "hashed-8", 8)
    return out.select("document_id", "chunk_index", "model", fn.vector_hash("vector").alias("vector_hash"))


@query(f"""WITH {CHUNKS}, c AS (SELECT document_id, count(*) AS chunks, count(*) FILTER (document_id % 5 > 0 AND (chunk_index < 2 OR document_id % 3 = 0)) AS vectors FROM chunks GROUP BY 1)
SELECT doc_id AS document_id, coalesce(chunks, 0) AS chunks, coalesce(vectors, 0) AS vectors, CASE WHEN coalesce(chunks, 0) = 0 THEN 'UPLOADED' WHEN vectors = 0 THEN 'CHUNKED' WHEN vectors < chunks THEN 'EMBEDDING' ELSE 'INDEXED' END AS status FROM documents LEFT JOIN c ON c.document_id = doc_id""")
def index_stages(t: Tables) -> DataFrame:
    """ING-10 over chunks of which some have no vector yet."""
    parts = chunks(t).select("document_id", "chunk_index")
    return chunking.index_stages(t.documents.select(F.col("doc_id").alias("document_id")), parts, parts.filter("document_id % 5 > 0 AND (chunk_index < 2 OR document_id % 3 = 0)"))


# -- retrieval


@query(f"WITH RECURSIVE {TREE}, {READABLE}, {NEAR}, n AS (SELECT *, row_number() OVER (ORDER BY s DESC, chunk_id) AS nth FROM near) SELECT 1 AS query_id, chunk_id, document_id, row_number() OVER (ORDER BY nth) AS rank_no FROM n WHERE nth <= 40 AND document_id IN (SELECT id FROM readable)")
def rechecked_candidates(t: Tables) -> DataFrame:
    """RET-07: candidates ranked without rights, then checked against the present ones."""
    near = search.scored(vectors(t), question_vector(t)).orderBy(F.desc("raw"), "chunk_id").limit(40)
    ranked = near.selectExpr("1 AS query_id", "chunk_id", "document_id", "row_number() OVER (ORDER BY raw DESC, chunk_id) AS rank_no")
    return search.rechecked(ranked, readable(t)).select("query_id", "chunk_id", "document_id", "rank_no")


@query(f"""WITH {CITED}, k AS (SELECT *, least(800, greatest(1, 3200 // count(*) OVER (PARTITION BY query_id))) AS m FROM cited WHERE rank_no <= 3),
l AS (SELECT query_id, string_agg(concat('[', rank_no, '] ', title, CASE WHEN page_no IS NOT NULL THEN concat(' p.', page_no) ELSE '' END, ': "', CASE WHEN length(chunk_text) <= m THEN chunk_text ELSE concat(substr(chunk_text, 1, m - 1), '…') END, '"', chr(10)), '' ORDER BY rank_no) AS context FROM k GROUP BY query_id),
u AS (SELECT conv_id, turn, text AS question, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, role FROM conversations),
w AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM u WHERE role = 'user' AND answer IS NOT NULL),
e AS (SELECT conv_id, string_agg(concat('[', n, '] Q: ', CASE WHEN length(question) <= 600 THEN question ELSE concat(substr(question, 1, 599), '…') END, chr(10), 'A: ', CASE WHEN length(answer) <= 600 THEN answer ELSE concat(substr(answer, 1, 599), '…') END, chr(10)), '' ORDER BY n) AS earlier FROM w GROUP BY conv_id)
SELECT DISTINCT conv_id AS query_id, sha256('Answer from the sources.' || chr(10) || coalesce(earlier || chr(10), '') || coalesce(context, '') || chr(10) || 'Question: ' || 'what is it' || chr(10)) AS prompt_hash
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN e USING (conv_id) LEFT JOIN l ON l.query_id = conv_id""")
def prompts(t: Tables) -> DataFrame:
    """RET-09, RET-10: one prompt a conversation with the first three sources and its earlier turns."""
    history = t.conversations.selectExpr("conv_id AS query_id", "turn", "text AS question", "lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer", "role").filter("role = 'user' AND answer IS NOT NULL")
    questions = t.conversations.select(F.col("conv_id").alias("query_id")).distinct().withColumn("question", F.lit("what is it"))
    out = search.prompts(questions, _cited(t).filter("rank_no <= 3"), history, "Answer from the sources.\n", "\n")
    return out.select("query_id", F.sha2("prompt", 256).alias("prompt_hash"))


@query("""SELECT conv_id, turn, CASE WHEN starts_with(trim(text), 'The') THEN NULL ELSE trim(string_split(text, 'The')[1]) END AS answer, CASE WHEN length(text) <= 300 THEN text ELSE concat(substr(text, 1, 299), '…') END || CASE WHEN turn % 2 = 1 THEN concat(' (p.', turn, ')') ELSE '' END AS fallback
FROM conversations""")
def answers(t: Tables) -> DataFrame:
    """RET-11, RET-12 with a short phrase in the place of the one that says that nothing was found."""
    page = F.when(F.col("turn") % 2 == 1, F.col("turn"))
    return t.conversations.select("conv_id", "turn", search.clean_answer(F.col("text"), "The").alias("answer"), search.fallback_answer(F.col("text"), page).alias("fallback"))


@query("SELECT doc_id, sha256(substr(text, 1, 1000)) AS cut_hash FROM documents WHERE text IS NOT NULL")
def unit_caps(t: Tables) -> DataFrame:
    """RET-15; the texts have no characters of two units, so that code points tell the same."""
    return t.documents.filter("text IS NOT NULL").select("doc_id", F.sha2(search.capped_units(F.col("text")), 256).alias("cut_hash"))


# -- requests, events, leases


DECISIONS = """CASE WHEN v.status IS NULL THEN 'INCONSISTENT' WHEN o.own = e.version_id THEN 'ALREADY_HANDLED' WHEN o.own IS NOT NULL THEN 'INCONSISTENT' WHEN e.event_type = 'DOCUMENT_REINDEX_REQUESTED' AND l.job_status = 'FAILED' THEN 'RETRY'
  WHEN e.event_type = 'DOCUMENT_REINDEX_REQUESTED' AND l.job_status IN ('PENDING', 'PROCESSING') THEN 'REUSE' WHEN e.event_type = 'DOCUMENT_REINDEX_REQUESTED' AND l.job_status = 'INDEXED' THEN 'REPAIR_VECTORS'
  WHEN l.job_status IS NOT NULL OR v.status NOT IN ('UPLOADED', 'PARSING', 'CHUNKED', 'EMBEDDING') THEN 'INCONSISTENT' ELSE 'CREATE_JOB' END"""
EVENT_TYPE = "CASE WHEN event_id % 2 = 0 THEN 'DOCUMENT_REINDEX_REQUESTED' ELSE 'DOCUMENT_VERSION_CREATED' END"


@query(f"""WITH {JOBS}, d AS (SELECT min(doc_id) AS low, count(*) AS n FROM documents), e AS (SELECT event_id, {EVENT_TYPE} AS event_type, low * 10 + (event_id % (n + 3)) * 10 + event_id % 2 + 1 AS version_id FROM events, d),
o AS (SELECT source_event_id, min(version_id) AS own FROM version_jobs WHERE source_event_id IS NOT NULL GROUP BY 1), l AS (SELECT version_id, arg_max(status, id) AS job_status FROM version_jobs GROUP BY 1)
SELECT e.event_id, {DECISIONS} AS decision FROM e LEFT JOIN versions v ON v.id = e.version_id LEFT JOIN o ON o.source_event_id = e.event_id LEFT JOIN l ON l.version_id = e.version_id""")
def event_decisions(t: Tables) -> DataFrame:
    """STR-24."""
    span = t.documents.agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    events = t.events.select("event_id").crossJoin(F.broadcast(span)).selectExpr("event_id", f"{EVENT_TYPE} AS event_type", "low * 10 + (event_id % (n + 3)) * 10 + event_id % 2 + 1 AS version_id")
    return lifecycle.event_decisions(events, t.versions, version_jobs(t))


@query("SELECT CASE event_type WHEN 'click' THEN 'counter' WHEN 'view' THEN 'counter' WHEN 'purchase' THEN 'ledger' ELSE 'UNSUPPORTED' END AS handler, count(*) AS n FROM events GROUP BY 1")
def handler_counts(t: Tables) -> DataFrame:
    """STR-30."""
    return lifecycle.dispatched(t.events, {"click": "counter", "view": "counter", "purchase": "ledger"}).groupBy("handler").agg(F.count("*").alias("n"))


STORED = "SELECT c_custkey % 9 AS user_id, concat('upload-', lpad(CAST(c_custkey AS STRING), 6, '0')) AS request_key, c_mktsegment AS input_fingerprint, CASE WHEN c_custkey % 3 = 0 THEN 'COMPLETED' ELSE 'IN_PROGRESS' END AS state, CASE WHEN c_custkey % 4 = 1 THEN TIMESTAMP_NTZ '2001-08-01 23:00:00' ELSE TIMESTAMP_NTZ '2001-08-02 00:03:00' END AS lease_expires_at FROM customer WHERE c_custkey % 5 > 0"
REQUESTS = "SELECT c_custkey % 9 AS user_id, CASE WHEN c_custkey % 11 = 0 THEN concat('up ', CAST(c_custkey AS STRING)) ELSE concat('upload-', lpad(CAST(c_custkey AS STRING), 6, '0')) END AS request_key, CASE WHEN c_custkey % 7 = 0 THEN 'OTHER' ELSE c_mktsegment END AS fingerprint FROM customer"


@query(f"""WITH stored AS ({STORED}), requests AS ({REQUESTS}), o AS (SELECT r.user_id, r.request_key, lease_expires_at, CASE WHEN NOT regexp_matches(r.request_key, '^[A-Za-z0-9_-]{{8,128}}$') THEN 'KEY_INVALID' WHEN state IS NULL THEN 'CREATED' WHEN input_fingerprint <> fingerprint THEN 'CONFLICT'
  WHEN state = 'COMPLETED' THEN 'REPLAYED' WHEN lease_expires_at <= {AS_OF} THEN 'RECLAIMED' ELSE 'IN_PROGRESS' END AS outcome FROM requests r LEFT JOIN stored s ON s.user_id = r.user_id AND s.request_key = r.request_key)
SELECT user_id, request_key, outcome, CASE WHEN outcome IN ('CREATED', 'RECLAIMED') THEN {AS_OF} + INTERVAL 5 MINUTE WHEN outcome = 'IN_PROGRESS' THEN lease_expires_at END AS lease_expires_at FROM o""")
def acquired_uploads(t: Tables) -> DataFrame:
    """STR-22."""
    read = lambda text: t.spark.sql(text.replace("FROM customer", "FROM {customer}"), customer=t.customer)
    return lifecycle.acquired(read(STORED), read(REQUESTS), now())


LEASES = f"SELECT id, status, concat('t', CAST(id % 5 AS STRING)) AS token, CASE WHEN id % 3 = 0 THEN {AS_OF} - INTERVAL '1' HOUR ELSE {AS_OF} + INTERVAL '1' HOUR END AS lease_expires_at, created_at FROM jobs"


@query(f"""WITH leases AS ({LEASES}), x AS (SELECT *, coalesce(status = 'PROCESSING' AND token = concat('t', CAST(id % 10 AS VARCHAR)) AND lease_expires_at > {AS_OF}, FALSE) AS renewed FROM leases)
SELECT id, renewed, CASE WHEN renewed THEN {AS_OF} + INTERVAL 90 SECOND ELSE lease_expires_at END AS lease_expires_at FROM x""")
def renewed_leases(t: Tables) -> DataFrame:
    """STR-04: half of the tokens that are offered are those of the leases."""
    rows = t.spark.sql(LEASES.replace("FROM jobs", "FROM {jobs}"), jobs=t.jobs)
    return lifecycle.renewed(rows, t.jobs.select("id", F.concat(F.lit("t"), (F.col("id") % 10).cast("string")).alias("token")), now(), 90)


@query(f"SELECT id, CASE WHEN status = 'PROCESSING' AND created_at < {AS_OF} - INTERVAL 525600 MINUTE THEN 'FAILED' ELSE status END AS status FROM jobs")
def swept_answers(t: Tables) -> DataFrame:
    """STR-08, RET-17: what has been in the works for over a year fails."""
    return lifecycle.swept(t.jobs.select("id", "status", "created_at"), now(), 525_600).select("id", "status")


# Error codes with their type of failure, and whether a retry makes sense.
FAILURES = [("R", "STORAGE_UNAVAILABLE", True, 1000), ("A", "DOCUMENT_CONTENT_INVALID", False, 0)]


@query(f"""WITH k(error_code, failure_type, retryable, min_delay_ms) AS (VALUES {', '.join(f"('{c}', '{k}', {r}, {d}::BIGINT)" for c, k, r, d in FAILURES)}), x AS (SELECT coalesce(failure_type, 'WORKER_INTERNAL_ERROR') AS failure_type, coalesce(retryable, TRUE) AS retryable, coalesce(min_delay_ms, 0) AS min_delay_ms FROM lineitem LEFT JOIN k ON error_code = l_returnflag)
SELECT failure_type, retryable, max(min_delay_ms) AS min_delay_ms, count(*) AS n FROM x GROUP BY ALL""")
def classified_failures(t: Tables) -> DataFrame:
    """STR-27."""
    known = t.spark.sql("SELECT error_code, failure_type, retryable, CAST(min_delay_ms AS BIGINT) AS min_delay_ms FROM VALUES " + ", ".join(map(str, FAILURES)) + " AS t(error_code, failure_type, retryable, min_delay_ms)")
    rows = lifecycle.classified_failures(t.lineitem.select(F.col("l_returnflag").alias("error_code")), known)
    return rows.groupBy("failure_type", "retryable").agg(F.max("min_delay_ms").alias("min_delay_ms"), F.count("*").alias("n"))


# -- cached rights


GRANTS = "SELECT user_id, document_id, 'DIRECT_DOCUMENT_PERMISSION' AS source_type, can_read, can_write, can_admin FROM document_grants WHERE target_type = 'USER'"


@query(f"""WITH g AS ({GRANTS}), c AS (SELECT user_id::BIGINT AS user_id, document_id, source_type, can_read, can_write, can_admin, invalidated FROM access_cache)
SELECT coalesce(c.user_id, g.user_id) AS user_id, coalesce(c.document_id, g.document_id) AS document_id, coalesce(c.source_type, g.source_type) AS source_type, CASE WHEN g.user_id IS NOT NULL THEN g.can_read ELSE c.can_read END AS can_read,
  CASE WHEN g.user_id IS NOT NULL THEN g.can_write ELSE c.can_write END AS can_write, CASE WHEN g.user_id IS NOT NULL THEN g.can_admin ELSE c.can_admin END AS can_admin, CASE WHEN g.user_id IS NOT NULL THEN FALSE ELSE c.invalidated END AS invalidated
FROM c FULL JOIN g ON c.user_id = g.user_id AND c.document_id = g.document_id AND c.source_type = g.source_type""")
def granted_cache(t: Tables) -> DataFrame:
    """PERM-06."""
    grants = t.document_grants.filter("target_type = 'USER'").withColumn("source_type", F.lit("DIRECT_DOCUMENT_PERMISSION"))
    return lifecycle.granted_cache(t.access_cache, grants)


@query("""WITH c AS (SELECT user_id, document_id, document_id % 40 AS source_id, can_read, invalidated FROM access_cache), e AS (SELECT event_id % 40 AS source_id, arg_max(CASE WHEN event_id % 3 = 0 THEN 'REVOKED' ELSE 'GRANTED' END, event_id) AS kind FROM events WHERE event_id % 40 < 30 GROUP BY 1),
g AS (SELECT document_id AS id, target_type, can_read FROM document_grants WHERE document_id < 40), j AS (SELECT c.*, e.kind, g.target_type, g.can_read AS now_read, coalesce(e.kind = 'REVOKED' OR e.kind IS NOT NULL AND g.target_type IS DISTINCT FROM 'USER', FALSE) AS gone FROM c LEFT JOIN e USING (source_id) LEFT JOIN g ON g.id = c.source_id)
SELECT user_id, document_id, CASE WHEN gone THEN TRUE WHEN kind IS NOT NULL THEN FALSE ELSE invalidated END AS invalidated, CASE WHEN kind IS NOT NULL AND NOT gone THEN now_read ELSE can_read END AS can_read FROM j""")
def refreshed_cache(t: Tables) -> DataFrame:
    """PERM-09: grants of the first forty documents stand for the sources; some have no event."""
    cache = t.access_cache.withColumn("source_id", F.col("document_id") % 40)
    events = t.events.filter("event_id % 40 < 30").selectExpr("event_id % 40 AS source_id", "event_id AS event_no", "CASE WHEN event_id % 3 = 0 THEN 'REVOKED' ELSE 'GRANTED' END AS kind")
    return lifecycle.refreshed_cache(cache, events, t.document_grants.filter("document_id < 40").select(F.col("document_id").alias("id"), "target_type", "can_read"))


@query("SELECT id, name, email FROM users WHERE status = 'ACTIVE' AND (contains(lower(name), '00002') OR contains(lower(email), '00002')) ORDER BY name, id LIMIT 20")
def target_users(t: Tables) -> DataFrame:
    return lifecycle.target_users(t.users, "  00002 ")


@query("SELECT a.* FROM (SELECT date_trunc('day', ts) AS at, user_id, max(value) AS stalled FROM events WHERE event_type = 'click' GROUP BY ALL HAVING max(value) > 50) a WHERE EXISTS (SELECT 1 FROM events b WHERE b.event_type <> 'click' AND b.value > 70 AND b.user_id = a.user_id AND date_trunc('day', b.ts) = a.at)")
def joint_alert(t: Tables) -> DataFrame:
    """STR-19, STR-32: two conditions that hold at the same labels and time."""
    one = t.events.filter("event_type = 'click'").groupBy(F.date_trunc("day", "ts").alias("at"), "user_id").agg(F.max("value").alias("stalled")).filter("stalled > 50")
    two = t.events.filter("event_type <> 'click' AND value > 70").select(F.date_trunc("day", "ts").alias("at"), "user_id")
    return lifecycle.in_both(one, two, "at", "user_id")


@query(f"SELECT v.id, v.status, coalesce(f.title, 'none') AS title, f.source FROM versions v LEFT JOIN files f ON f.id = v.document_id AND f.owner_user_id <= {USER * 10}")
def backfilled_versions(t: Tables) -> DataFrame:
    """SRC-21, SRC-22: columns of another table filled in where it has them, and derived ones."""
    known = t.files.filter(F.col("owner_user_id") <= USER * 10).select(F.col("id").alias("document_id"), "title", "source")
    return t.versions.select("id", "document_id", "status").join(known, "document_id", "left").select("id", "status", F.coalesce("title", F.lit("none")).alias("title"), "source")


@query("SELECT id, name FROM collections WHERE status = 'ACTIVE' AND lower(name) LIKE '%a%' ORDER BY created_day, id")
def active_collections(t: Tables) -> DataFrame:
    return t.collections.filter((F.col("status") == "ACTIVE") & permissions.contains("a", "name")).orderBy("created_day", "id").select("id", "name")
