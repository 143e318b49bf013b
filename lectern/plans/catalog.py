"""All queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as fn
from lectern.operators import analytics, chunking, lifecycle, limits, permissions, quantiles, queues, reconcile, search, series, spine
from lectern.operators import tree as trees
from lectern.operators.lineage import cut, kept
from lectern.plans.derived import AS_OF, Tables, sql
from lectern.sources import files as sources
from lectern.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
USER, QUESTION = 7, "Where is the station and what of the thing?"
EVENTS_NOW = "TIMESTAMP_NTZ '2024-01-15 00:00:00'"


def now() -> Column:
    return F.expr(AS_OF)


def query(oracle: str | None = None):  # noqa: ANN201
    """Registers a query under its function's name; oracle may name base and derived tables."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables.of(spark, sf_dir))
        if oracle:
            SQL[f.__name__] = sql(oracle)
        return f

    return add


# -- permissions and trees


def tree(t: Tables) -> DataFrame:
    """The closure of the collections, a maintained table: built once a session and folder."""
    return kept(t.spark, ("closure", t.sf_dir), lambda: trees.closure(t.collections.select("id", "parent_id")))


TREE = "tree(ancestor_id, descendant_id, depth) AS (SELECT id, id, 0 FROM collections UNION ALL SELECT n.parent_id, tree.descendant_id, tree.depth + 1 FROM tree JOIN collections n ON n.id = tree.ancestor_id WHERE n.parent_id IS NOT NULL)"
ME = f"me AS (SELECT * FROM users WHERE id = {USER})"
LIVE = f"(expires_at IS NULL OR expires_at > {AS_OF})"
REACHED = "(target_type = 'ROLE' AND role_id IN (SELECT role_id FROM user_roles WHERE user_id = (SELECT id FROM me)) OR target_type = 'DEPARTMENT' AND department_id = (SELECT department_id FROM me))"
READABLE = f"""{ME}, readable AS (SELECT f.id FROM files f WHERE f.status = 'INDEXED' AND (f.owner_user_id = {USER} OR f.visibility = 'PUBLIC'
   OR f.visibility = 'DEPARTMENT' AND (SELECT department_id FROM users u WHERE u.id = f.owner_user_id) = (SELECT department_id FROM me)
   OR f.id IN (SELECT document_id FROM access_cache WHERE user_id = {USER} AND can_read AND NOT invalidated AND {LIVE})
   OR f.id IN (SELECT document_id FROM document_grants WHERE can_read AND {LIVE} AND {REACHED})
   OR f.id IN (SELECT document_id FROM collection_documents c JOIN tree ON tree.descendant_id = c.collection_id JOIN collection_grants g ON g.collection_id = tree.ancestor_id WHERE can_read AND {LIVE} AND {REACHED})))"""


def readable(t: Tables) -> DataFrame:
    return permissions.readable_documents(t, USER, now(), tree(t))


@query(f"WITH RECURSIVE {TREE}, {READABLE} SELECT id FROM readable")
def readable_documents(t: Tables) -> DataFrame:
    return readable(t)


@query(f"WITH RECURSIVE {TREE}, {READABLE} SELECT id FROM readable WHERE id IN (SELECT document_id FROM collection_documents WHERE collection_id = 3004)")
def readable_in_collection(t: Tables) -> DataFrame:
    return readable(t).join(t.collection_documents.filter("collection_id = 3004").select(F.col("document_id").alias("id")), "id", "left_semi")


COLLECTIONS = f"""{ME}, shelves AS (SELECT id, name, parent_id, description, created_day FROM collections c WHERE status = 'ACTIVE' AND (owner_user_id = {USER} OR visibility = 'PUBLIC'
   OR id IN (SELECT collection_id FROM collection_grants WHERE target_type = 'USER' AND user_id = {USER} AND can_read AND {LIVE})
   OR id IN (SELECT descendant_id FROM tree JOIN collection_grants g ON g.collection_id = tree.ancestor_id WHERE can_read AND {LIVE} AND {REACHED})))"""


@query(f"WITH RECURSIVE {TREE}, {COLLECTIONS}, k AS (SELECT id, name, parent_id, created_day FROM shelves WHERE lower(name) LIKE '%a%' OR lower(description) LIKE '%a%') SELECT *, (SELECT count(*) FROM k) AS total_count FROM k ORDER BY created_day, id LIMIT 10 OFFSET 2")
def readable_collections(t: Tables) -> DataFrame:
    return permissions.page(permissions.readable_collections(t, USER, now(), tree(t), "a"), F.col("created_day"), F.col("id"), limit=10, offset=2)


@query(f"WITH RECURSIVE {TREE}, {COLLECTIONS} SELECT id, name FROM shelves WHERE parent_id = 1003")
def readable_children(t: Tables) -> DataFrame:
    return permissions.readable_collections(t, USER, now(), tree(t)).filter("parent_id = 1003").select("id", "name")


@query(f"WITH RECURSIVE {TREE} SELECT * FROM tree")
def collection_closure(t: Tables) -> DataFrame:
    return tree(t)


@query(f"WITH RECURSIVE {TREE} SELECT ancestor_id AS id, depth FROM tree WHERE descendant_id = 3007")
def ancestors(t: Tables) -> DataFrame:
    return permissions.ancestors(tree(t), 3007)


@query(f"WITH RECURSIVE {TREE} SELECT descendant_id AS id, depth FROM tree WHERE ancestor_id = 1002")
def descendants(t: Tables) -> DataFrame:
    return permissions.descendants(tree(t), 1002)


@query(f"WITH RECURSIVE {TREE} SELECT DISTINCT ancestor_id AS id FROM tree JOIN collection_documents ON descendant_id = collection_id WHERE document_id = 42")
def effective_collections(t: Tables) -> DataFrame:
    return permissions.effective_collections(tree(t), t.collection_documents, 42)


@query(f"WITH RECURSIVE {TREE} SELECT 9000 AS ancestor_id, 9000 AS descendant_id, 0 AS depth UNION ALL SELECT ancestor_id, 9000, depth + 1 FROM tree WHERE descendant_id = 3001")
def closure_insert(t: Tables) -> DataFrame:
    new = t.spark.range(9000, 9001).select(F.col("id").cast("int").alias("id"), F.lit(3001).alias("parent_id"))
    return trees.inserted(tree(t), new).filter("descendant_id = 9000")


@query(f"WITH RECURSIVE {TREE} SELECT * FROM tree WHERE descendant_id NOT IN (SELECT descendant_id FROM tree WHERE ancestor_id = 1001)")
def closure_delete(t: Tables) -> DataFrame:
    return trees.deleted(tree(t), t.collections.filter("id = 1001"))


LEAVES = "leaves AS (SELECT (10000 + c_custkey)::INT AS id, 3000 + c_nationkey AS parent_id FROM customer UNION ALL SELECT (90000000 + s_suppkey)::INT, (10000 + (SELECT min(c_custkey) FROM customer) + s_suppkey % (SELECT count(*) FROM customer))::INT FROM supplier)"


@query(f"WITH RECURSIVE {LEAVES}, nodes AS (SELECT id, parent_id FROM collections UNION ALL SELECT * FROM leaves), up(ancestor_id, descendant_id, depth) AS (SELECT id, id, 0 FROM nodes UNION ALL SELECT n.parent_id, up.descendant_id, up.depth + 1 FROM up JOIN nodes n ON n.id = up.ancestor_id WHERE n.parent_id IS NOT NULL) SELECT * FROM up")
def closure_grown(t: Tables) -> DataFrame:
    """The closure after a subtree of two levels was put below each shelf: a node for each customer, and suppliers below customers."""
    low = t.customer.agg(F.min("c_custkey").alias("low"), F.count("*").alias("n"))
    firms = t.supplier.crossJoin(F.broadcast(low)).select((90_000_000 + F.col("s_suppkey")).cast("int").alias("id"), (10_000 + F.col("low") + F.col("s_suppkey") % F.col("n")).cast("int").alias("parent_id"))
    new = t.customer.select((10_000 + F.col("c_custkey")).cast("int").alias("id"), (3000 + F.col("c_nationkey")).alias("parent_id")).union(firms)
    return trees.inserted(tree(t), new)


@query("WITH RECURSIVE nodes AS (SELECT id, CASE WHEN id >= 3000 THEN 1000 + n_regionkey ELSE parent_id END AS parent_id FROM collections LEFT JOIN nation ON id = 3000 + n_nationkey), up(ancestor_id, descendant_id, depth) AS (SELECT id, id, 0 FROM nodes UNION ALL SELECT n.parent_id, up.descendant_id, up.depth + 1 FROM up JOIN nodes n ON n.id = up.ancestor_id WHERE n.parent_id IS NOT NULL) SELECT * FROM up")
def closure_moved(t: Tables) -> DataFrame:
    """The closure after all shelves were moved from their nations to the regions."""
    return trees.moved(tree(t), t.nation.select((3000 + F.col("n_nationkey")).alias("id"), (1000 + F.col("n_regionkey")).alias("parent_id")))


LINES = "lines AS (SELECT c_custkey AS id, lag(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS parent_id FROM customer)"


@query(f"WITH RECURSIVE {LINES}, up(ancestor_id, descendant_id, depth) AS (SELECT id, id, 0 FROM lines UNION ALL SELECT n.parent_id, up.descendant_id, up.depth + 1 FROM up JOIN lines n ON n.id = up.ancestor_id WHERE n.parent_id IS NOT NULL) SELECT * FROM up")
def reporting_lines(t: Tables) -> DataFrame:
    """The closure of deep chains: each user reports to the one before in the same department."""
    return trees.closure(t.customer.selectExpr("c_custkey AS id", "lag(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS parent_id"))


@query(f"""WITH {ME}, a AS (
  SELECT id, 'OWNER' AS rule, TRUE AS can_read, TRUE AS can_write, TRUE AS can_admin FROM files WHERE owner_user_id = {USER} UNION ALL
  SELECT id, 'PUBLIC', TRUE, FALSE, FALSE FROM files WHERE visibility = 'PUBLIC' UNION ALL
  SELECT id, 'DEPARTMENT', TRUE, FALSE, FALSE FROM files f WHERE visibility = 'DEPARTMENT' AND (SELECT department_id FROM users u WHERE u.id = f.owner_user_id) = (SELECT department_id FROM me) UNION ALL
  SELECT document_id, concat(target_type, '_GRANT'), can_read, can_write, can_admin FROM document_grants WHERE {LIVE} AND ({REACHED} OR target_type = 'USER' AND user_id = {USER}))
SELECT id AS document_id, bool_or(can_read) AS can_read, bool_or(can_write) AS can_write, bool_or(can_admin) AS can_admin, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM a WHERE can_read OR can_write OR can_admin GROUP BY id""")
def permission_summary(t: Tables) -> DataFrame:
    return permissions.permission_summary(t, USER, now(), None)


MINE = f"target_type = 'USER' AND user_id = {USER} AND {LIVE}"
SUMMED = "bool_or(can_read) AS can_read, bool_or(can_write) AS can_write, bool_or(can_admin) AS can_admin, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM a WHERE can_read OR can_write OR can_admin GROUP BY id"


@query(f"""WITH RECURSIVE {TREE}, {ME}, b AS (
  SELECT id AS document_id, 'OWNER' AS source_type, TRUE AS r, TRUE AS w, TRUE AS x FROM files WHERE owner_user_id = {USER} UNION ALL
  SELECT document_id, 'DIRECT_DOCUMENT_PERMISSION', can_read, can_write, can_admin FROM document_grants WHERE {MINE} UNION ALL
  SELECT document_id, 'DIRECT_COLLECTION_PERMISSION', can_read, can_write, can_admin FROM collection_documents JOIN collection_grants USING (collection_id) WHERE {MINE}),
a AS (
  SELECT id, 'OWNER' AS rule, TRUE AS can_read, TRUE AS can_write, TRUE AS can_admin FROM files WHERE owner_user_id = {USER} UNION ALL
  SELECT id, 'PUBLIC', TRUE, FALSE, FALSE FROM files WHERE visibility = 'PUBLIC' UNION ALL
  SELECT id, 'DEPARTMENT', TRUE, FALSE, FALSE FROM files f WHERE visibility = 'DEPARTMENT' AND (SELECT department_id FROM users u WHERE u.id = f.owner_user_id) = (SELECT department_id FROM me) UNION ALL
  SELECT document_id, concat(target_type, '_GRANT'), can_read, can_write, can_admin FROM document_grants WHERE {LIVE} AND ({REACHED} OR target_type = 'USER' AND user_id = {USER}) UNION ALL
  SELECT document_id, 'USER_CACHE', can_read AND r, can_write AND w, can_admin AND x FROM access_cache JOIN b USING (document_id, source_type) WHERE user_id = {USER} AND NOT invalidated AND {LIVE} UNION ALL
  SELECT c.document_id, concat(target_type, '_COLLECTION_GRANT'), can_read, can_write, can_admin FROM collection_documents c JOIN tree ON tree.descendant_id = c.collection_id JOIN collection_grants g ON g.collection_id = tree.ancestor_id WHERE {LIVE} AND {REACHED})
SELECT id AS document_id, {SUMMED}""")
def document_permissions(t: Tables) -> DataFrame:
    return permissions.permission_summary(t, USER, now(), tree(t))


@query(f"""WITH RECURSIVE {TREE}, {ME}, a AS (
  SELECT id, 'OWNER' AS rule, TRUE AS can_read, TRUE AS can_write, TRUE AS can_admin FROM collections WHERE owner_user_id = {USER} UNION ALL
  SELECT id, 'PUBLIC', TRUE, FALSE, FALSE FROM collections WHERE visibility = 'PUBLIC' UNION ALL
  SELECT collection_id, 'USER_GRANT', can_read, can_write, can_admin FROM collection_grants WHERE {MINE} UNION ALL
  SELECT descendant_id, concat(target_type, '_GRANT'), can_read, can_write, can_admin FROM tree JOIN collection_grants g ON g.collection_id = tree.ancestor_id WHERE {LIVE} AND {REACHED})
SELECT id AS collection_id, {SUMMED}""")
def collection_permissions(t: Tables) -> DataFrame:
    return permissions.collection_summary(t, USER, now(), tree(t))


CHECKED = """bool_or(can_read) AS can_read, bool_or(can_write) AS can_write, bool_or(can_admin) AS can_admin, array_to_string(list_transform(list_sort(list(DISTINCT k)), lambda x: ['OWNER', 'PUBLIC', {names}][x + 1]), ',') AS sources
FROM a WHERE (can_read OR can_write OR can_admin) AND (k = 0 OR id NOT IN (SELECT id FROM a WHERE k = 0)) GROUP BY id"""
DOCUMENT_SOURCES, COLLECTION_SOURCES = "'DEPARTMENT_VISIBILITY', 'USER_CACHE', 'ROLE', 'DEPARTMENT'", "'USER', 'ROLE', 'DEPARTMENT'"


@query(f"""WITH RECURSIVE {TREE}, {ME}, b AS (
  SELECT id AS document_id, 'OWNER' AS source_type, TRUE AS r, TRUE AS w, TRUE AS x FROM files WHERE owner_user_id = {USER} UNION ALL
  SELECT document_id, 'DIRECT_DOCUMENT_PERMISSION', can_read, can_write, can_admin FROM document_grants WHERE {MINE} UNION ALL
  SELECT document_id, 'DIRECT_COLLECTION_PERMISSION', can_read, can_write, can_admin FROM collection_documents JOIN collection_grants USING (collection_id) WHERE {MINE}),
a AS (
  SELECT id, 0 AS k, TRUE AS can_read, TRUE AS can_write, TRUE AS can_admin FROM files WHERE owner_user_id = {USER} UNION ALL
  SELECT id, 1, TRUE, FALSE, FALSE FROM files WHERE visibility = 'PUBLIC' UNION ALL
  SELECT id, 2, TRUE, FALSE, FALSE FROM files f WHERE visibility = 'DEPARTMENT' AND (SELECT department_id FROM users u WHERE u.id = f.owner_user_id) = (SELECT department_id FROM me) UNION ALL
  SELECT document_id, 3, can_read AND r, can_write AND w, can_admin AND x FROM access_cache JOIN b USING (document_id, source_type) WHERE user_id = {USER} AND NOT invalidated AND {LIVE} UNION ALL
  SELECT document_id, CASE target_type WHEN 'ROLE' THEN 4 ELSE 5 END, can_read, can_write, can_admin FROM document_grants WHERE {LIVE} AND {REACHED} UNION ALL
  SELECT c.document_id, CASE target_type WHEN 'ROLE' THEN 4 ELSE 5 END, can_read, can_write, can_admin FROM collection_documents c JOIN tree ON tree.descendant_id = c.collection_id JOIN collection_grants g ON g.collection_id = tree.ancestor_id WHERE {LIVE} AND {REACHED})
SELECT id AS document_id, {CHECKED.format(names=DOCUMENT_SOURCES)}""")
def checked_documents(t: Tables) -> DataFrame:
    return permissions.checked_documents(t, USER, now(), tree(t))


@query(f"""WITH RECURSIVE {TREE}, {ME}, a AS (SELECT x.* FROM (
  SELECT id, 0 AS k, TRUE AS can_read, TRUE AS can_write, TRUE AS can_admin FROM collections WHERE owner_user_id = {USER} UNION ALL
  SELECT id, 1, TRUE, FALSE, FALSE FROM collections WHERE visibility = 'PUBLIC' UNION ALL
  SELECT collection_id, 2, can_read, can_write, can_admin FROM collection_grants WHERE {MINE} UNION ALL
  SELECT descendant_id, CASE target_type WHEN 'ROLE' THEN 3 ELSE 4 END, can_read, can_write, can_admin FROM tree JOIN collection_grants g ON g.collection_id = tree.ancestor_id WHERE {LIVE} AND {REACHED}) x
  JOIN collections c ON c.id = x.id AND c.status = 'ACTIVE')
SELECT id AS collection_id, {CHECKED.format(names=COLLECTION_SOURCES)}""")
def checked_collections(t: Tables) -> DataFrame:
    return permissions.checked_collections(t, USER, now(), tree(t))


@query(f"""SELECT user_id, document_id, source_type FROM access_cache c WHERE NOT invalidated AND can_read AND {LIVE} AND (
  source_type = 'OWNER' AND EXISTS (SELECT 1 FROM files f WHERE f.id = c.document_id AND f.owner_user_id = c.user_id)
  OR source_type = 'DIRECT_DOCUMENT_PERMISSION' AND EXISTS (SELECT 1 FROM document_grants g WHERE g.document_id = c.document_id AND g.user_id = c.user_id AND g.target_type = 'USER' AND g.can_read AND (g.expires_at IS NULL OR g.expires_at > {AS_OF}))
  OR source_type = 'DIRECT_COLLECTION_PERMISSION' AND EXISTS (SELECT 1 FROM collection_grants g JOIN collection_documents d ON d.collection_id = g.collection_id WHERE d.document_id = c.document_id AND g.user_id = c.user_id AND g.target_type = 'USER' AND g.can_read AND (g.expires_at IS NULL OR g.expires_at > {AS_OF})))""")
def authoritative_cache(t: Tables) -> DataFrame:
    return permissions.authoritative_cache(t, now())


@query(f"SELECT target_type, count(*) AS grants, count(*) FILTER (can_write) AS writing FROM document_grants WHERE {LIVE} GROUP BY target_type")
def active_grants(t: Tables) -> DataFrame:
    return t.document_grants.filter(permissions.active(now())).groupBy("target_type").agg(F.count("*").alias("grants"), F.count_if("can_write").alias("writing"))


@query("SELECT id, name, email, status FROM users WHERE status <> 'DELETED' AND (lower(name) LIKE '%00001%' OR lower(email) LIKE '%00001%') ORDER BY name, id LIMIT 20")
def admin_users(t: Tables) -> DataFrame:
    return t.users.filter((F.col("status") != "DELETED") & permissions.contains("00001", "name", "email")).orderBy("name", "id").select("id", "name", "email", "status").limit(20)


@query("SELECT u.id, string_agg(r.code, ',' ORDER BY r.code) AS codes FROM users u JOIN user_roles x ON x.user_id = u.id JOIN roles r ON r.id = x.role_id GROUP BY u.id")
def all_user_role_codes(t: Tables) -> DataFrame:
    rows = t.users.join(t.user_roles, F.col("user_id") == F.col("id")).select("user_id", "role_id").join(t.roles, F.col("role_id") == F.col("id"))
    return rows.groupBy(F.col("user_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("code")), ",").alias("codes"))


# -- chunks


def chunks(t: Tables) -> DataFrame:
    parts = chunking.chunks(t.documents.select(F.col("doc_id").alias("document_id"), F.lit(0).alias("segment_no"), "text"), whole=True)
    return parts.withColumn("chunk_id", F.col("document_id") * 1000 + F.col("chunk_index"))


CHUNKS = """s AS (SELECT doc_id AS document_id, text, unnest(range(0, greatest(0, ceil((length(text) - 1000) / 800.0)::BIGINT) * 800 + 1, 800)) AS a FROM documents WHERE length(text) > 0),
chunks AS (SELECT document_id, document_id * 1000 + a // 800 AS chunk_id, (a // 800)::INT AS chunk_index, a AS char_start, a + length(substr(text, a + 1, 1000)) AS char_end, substr(text, a + 1, 1000) AS chunk_text FROM s)"""


@query(f"WITH {CHUNKS} SELECT document_id, chunk_index, char_start, char_end, len(list_filter(regexp_split_to_array(chunk_text, '\\s+'), lambda x: x <> '')) AS token_count, sha256(chunk_text) AS content_hash FROM chunks")
def chunk_fixed(t: Tables) -> DataFrame:
    return chunks(t).select("document_id", "chunk_index", "char_start", "char_end", "token_count", "content_hash")


@query("SELECT doc_id AS document_id, sha256(text) AS restored_hash FROM documents WHERE length(text) > 0")
def chunk_restore(t: Tables) -> DataFrame:
    return chunking.restored(chunks(t)).select("document_id", F.sha2("text", 256).alias("restored_hash"))


@query(f"""WITH {CHUNKS}, k AS (SELECT document_id, chunk_index, char_end, length(chunk_text) AS size, char_start + CASE WHEN chunk_index = 3 THEN 1 ELSE 0 END AS char_start FROM chunks WHERE chunk_index <> 1 AND NOT (chunk_index = 0 AND document_id % 7 = 3)),
  p AS (SELECT *, row_number() OVER w - 1 AS place, coalesce(lag(char_end) OVER w, 0) AS before FROM k WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index)),
  r AS (SELECT document_id, chunk_index, CASE WHEN chunk_index <> place THEN 'INDEX' WHEN char_end - char_start <> size OR place = 0 AND char_start <> 0 THEN 'OFFSET' WHEN char_start > before + 1 OR char_end <= before THEN 'GAP' END AS reason FROM p)
SELECT * FROM r WHERE reason IS NOT NULL""")
def chunk_contiguity(t: Tables) -> DataFrame:
    """Over chunks of which some are taken out and some moved by one place."""
    parts = chunks(t).filter("chunk_index <> 1 AND NOT (chunk_index = 0 AND document_id % 7 = 3)").withColumn("char_start", F.col("char_start") + (F.col("chunk_index") == 3).cast("int"))
    return chunking.discontinuities(parts)


FULL = "r.n + 1 > 4 OR r.ch + c.ch > 4000 OR r.tk + c.tk > 900"


@query(f"""WITH RECURSIVE {CHUNKS}, c AS (SELECT document_id, chunk_index, length(chunk_text) AS ch, len(list_filter(regexp_split_to_array(chunk_text, '\\s+'), lambda x: x <> '')) AS tk FROM chunks),
r AS (SELECT document_id, chunk_index, 0 AS batch_no, 1 AS n, ch, tk FROM c WHERE chunk_index = 0 UNION ALL
  SELECT c.document_id, c.chunk_index, r.batch_no + ({FULL})::INT, CASE WHEN {FULL} THEN 1 ELSE r.n + 1 END, CASE WHEN {FULL} THEN c.ch ELSE r.ch + c.ch END, CASE WHEN {FULL} THEN c.tk ELSE r.tk + c.tk END
  FROM r JOIN c ON c.document_id = r.document_id AND c.chunk_index = r.chunk_index + 1)
SELECT document_id, chunk_index, batch_no FROM r""")
def chunk_batches(t: Tables) -> DataFrame:
    return chunking.plan_batches(chunks(t))


@query(f"WITH {CHUNKS} SELECT document_id, count(*) AS missing FROM chunks WHERE NOT (chunk_index = 0 AND document_id IN (SELECT vec_id FROM embeddings)) GROUP BY document_id")
def missing_embeddings(t: Tables) -> DataFrame:
    have = t.embeddings.select(F.col("vec_id").alias("document_id"), F.lit(0).alias("chunk_index"))
    return chunking.missing_embeddings(chunks(t), have).groupBy("document_id").agg(F.count("*").alias("missing"))


@query("SELECT sha256(text) AS file_hash, length(text) AS size, min(doc_id) AS object_id, count(*) AS uploads FROM documents GROUP BY ALL")
def content_objects(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.sha2("text", 256).alias("file_hash"), F.length("text").cast("long").alias("size")).agg(F.min("doc_id").alias("object_id"), F.count("*").alias("uploads"))


@query()
def markdown_sections(t: Tables) -> DataFrame:
    text = F.concat(F.lit("# "), F.col("source"), F.lit("\n\n## "), F.col("lang"), F.lit("\n"), F.col("text"))
    return chunking.parse_markdown(t.documents.select(F.col("doc_id").alias("document_id"), text.alias("text")))


# -- search


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select((F.col("vec_id") * 1000).alias("chunk_id"), F.col("vec_id").alias("document_id"), F.col("embedding").alias("vector"), "label")


def question_vector(t: Tables) -> list[float]:
    """One vector, looked up by its key."""
    return t.embeddings.filter("vec_id = 0").select("embedding").first()[0]


NEAR = "near AS (SELECT e.vec_id AS document_id, e.vec_id * 1000 AS chunk_id, label, list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS s FROM embeddings e)"


@query(f"""WITH RECURSIVE {TREE}, {READABLE}, {NEAR}, c AS (SELECT n.*, row_number() OVER (PARTITION BY document_id ORDER BY s DESC, chunk_id) AS mine FROM (SELECT * FROM near WHERE document_id IN (SELECT id FROM readable) ORDER BY s DESC, chunk_id LIMIT 40) n WHERE s >= 0.05),
r AS (SELECT chunk_id, document_id, s FROM c WHERE mine <= 2 ORDER BY s DESC, chunk_id LIMIT 10) SELECT chunk_id, document_id::BIGINT AS document_id, round(s, 4) AS similarity, row_number() OVER (ORDER BY s DESC, chunk_id) AS rank_no FROM r""")
def vector_topk_permitted(t: Tables) -> DataFrame:
    """The nearest chunks in the user's scope, at most two of one document; these vectors lie far apart, so the least similarity is low."""
    scope = search.in_scope(vectors(t), readable(t))
    near = search.vector_candidates(scope, question_vector(t), 40).filter(F.col("similarity") >= 0.05)
    return search.capped(near, F.desc("similarity"), F.col("chunk_id")).withColumn("similarity", F.round(F.col("similarity").cast("double"), 4))


@query("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id * 1000 AS chunk_id, e.vec_id AS document_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS similarity FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank_no FROM s) SELECT query_id, chunk_id, document_id, round(similarity, 6) AS similarity, rank_no FROM r WHERE rank_no <= 10""")
def vector_topk_many(t: Tables) -> DataFrame:
    """The ten nearest of all vectors for each query, which are the vectors whose id is divisible by 100."""
    queries = t.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return search.nearest_many(vectors(t), queries, 10).withColumn("similarity", F.round("similarity", 6))


TERMS = ["where", "is", "the", "station", "and", "what", "of", "thing"]
HITS = ", ".join(f"regexp_matches(lower(chunk_text), '(^|[^a-z0-9]){w}([^a-z0-9]|$)')" for w in TERMS)
SCOPE = f"{CHUNKS}, scope AS (SELECT chunk_id, document_id, [{HITS}] AS hits FROM chunks WHERE document_id IN (SELECT id FROM readable))"
WEIGHTS = f"f AS (SELECT i AS ord, [{', '.join(repr(w) for w in TERMS)}][i] AS term, (SELECT count(*) FILTER (hits[i]) FROM scope) AS matched FROM range(1, {len(TERMS) + 1}) AS r(i)), w AS (SELECT ord, term, round(ln(((SELECT count(*) FROM scope) + 1) / (matched + 0.5)), 10) AS weight FROM f WHERE matched > 0)"
COVERED = "v AS (SELECT chunk_id, document_id, CASE WHEN (SELECT sum(weight) FROM w) > 0 THEN round(coalesce((SELECT sum(weight) FROM w WHERE hits[ord]), 0) / (SELECT sum(weight) FROM w), 6) ELSE 0 END AS coverage FROM scope)"


def scoped_hits(t: Tables, permitted: DataFrame) -> DataFrame:
    return search.hits(search.in_scope(chunks(t).select("chunk_id", "document_id", "chunk_text"), permitted), fn.query_terms(QUESTION))


@query(f"WITH RECURSIVE {TREE}, {READABLE}, {SCOPE}, {WEIGHTS} SELECT ord::INT AS ord, term, matched FROM f UNION ALL SELECT 0, NULL, (SELECT count(*) FROM scope)")
def term_frequency(t: Tables) -> DataFrame:
    """The permitted ids are a table first: Spark knows its size and sends it to the texts, if it is small, and not the texts through a shuffle."""
    return search.term_frequencies(scoped_hits(t, cut(readable(t))), fn.query_terms(QUESTION))


def _covered(t: Tables, permitted: DataFrame) -> DataFrame:
    terms, rows = fn.query_terms(QUESTION), cut(scoped_hits(t, permitted))
    return search.coverage(rows, terms, search.weighted_terms(search.term_frequencies(rows, terms)))


@query(f"""WITH RECURSIVE {TREE}, {READABLE}, {SCOPE}, {WEIGHTS}, {COVERED}, {NEAR}, n AS (SELECT chunk_id FROM near WHERE document_id IN (SELECT id FROM readable) ORDER BY s DESC, chunk_id LIMIT 40)
SELECT chunk_id, document_id, round(coverage, 4) AS coverage FROM ((SELECT * FROM v WHERE coverage >= 0.5 ORDER BY coverage DESC, chunk_id LIMIT 40) UNION SELECT * FROM v WHERE coverage > 0 AND chunk_id IN (SELECT chunk_id FROM n)) u""")
def lexical_candidates(t: Tables) -> DataFrame:
    permitted = cut(readable(t))
    near = search.vector_candidates(search.in_scope(vectors(t), permitted), question_vector(t), 40)
    return search.lexical_candidates(_covered(t, permitted), near, 40).withColumn("coverage", F.round("coverage", 4))


@query(f"""WITH RECURSIVE {TREE}, {READABLE}, {SCOPE}, {WEIGHTS}, {COVERED}, {NEAR}, a AS (SELECT chunk_id, document_id, round(greatest(s, 0), 6) AS s, s AS raw FROM near WHERE document_id IN (SELECT id FROM readable)),
n AS (SELECT * FROM a ORDER BY raw DESC, chunk_id LIMIT 40), l AS ((SELECT * FROM v WHERE coverage >= 0.5 ORDER BY coverage DESC, chunk_id LIMIT 40) UNION SELECT * FROM v WHERE coverage > 0 AND chunk_id IN (SELECT chunk_id FROM n)),
b AS (SELECT coalesce(n.chunk_id, l.chunk_id) AS chunk_id, coalesce(n.document_id, l.document_id) AS document_id, coalesce(n.s, (SELECT s FROM a WHERE a.chunk_id = l.chunk_id), 0) AS s, coalesce(l.coverage, 0) AS c FROM n FULL JOIN l ON n.chunk_id = l.chunk_id),
k AS (SELECT *, round(s + 0.1 * c, 6) AS score FROM b WHERE s >= 0.45 OR c >= 0.5), m AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, s DESC, chunk_id) AS mine FROM k),
r AS (SELECT * FROM m WHERE mine <= 2 ORDER BY score DESC, s DESC, chunk_id LIMIT 10) SELECT chunk_id, document_id, round(score, 4) AS score, row_number() OVER (ORDER BY score DESC, s DESC, chunk_id) AS rank_no FROM r""")
def hybrid_fusion(t: Tables) -> DataFrame:
    permitted = cut(readable(t))
    scope = cut(search.scored(search.in_scope(vectors(t), permitted), question_vector(t)))
    near = search.nearest(scope, 40)
    lexical = search.lexical_candidates(_covered(t, permitted), near, 40)
    out = search.fused(near, lexical, scope.select("chunk_id", fn.similarity(1 - F.col("raw")).alias("similarity")), 10)
    return out.select("chunk_id", "document_id", F.round("score", 4).alias("score"), "rank_no")


RANKED = "ranked AS (SELECT e.vec_id % 20 AS query_id, e.vec_id AS item_id, row_number() OVER (PARTITION BY e.vec_id % 20 ORDER BY e.embedding[1] DESC, e.vec_id) AS rank_no FROM embeddings e), rel AS (SELECT vec_id % 20 AS query_id, vec_id AS item_id FROM embeddings WHERE label = 3)"


def _ranked(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.embeddings.select((F.col("vec_id") % 20).alias("query_id"), F.col("vec_id").alias("item_id"), F.col("embedding")[0].alias("x"), "label")
    nth = F.expr("row_number() OVER (PARTITION BY query_id ORDER BY x DESC, item_id)")
    return rows.withColumn("rank_no", nth), rows.filter("label = 3").select("query_id", "item_id")


@query(f"""WITH {RANKED}, f AS (SELECT rel.query_id, min(rank_no) FILTER (rank_no <= 10) AS first FROM rel LEFT JOIN ranked USING (query_id, item_id) GROUP BY rel.query_id)
SELECT round(avg(CASE WHEN first IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS found, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0 END), 6) AS hit1, round(avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0 END), 6) AS hit3, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM f""")
def retrieval_metrics(t: Tables) -> DataFrame:
    return search.retrieval_metrics(*_ranked(t))


@query(f"WITH {RANKED}, x AS (SELECT query_id, list(item_id) AS e FROM rel GROUP BY 1), y AS (SELECT query_id, list(item_id) AS a FROM ranked WHERE rank_no <= 10 GROUP BY 1) SELECT query_id, round(len(list_intersect(e, a)) / len(e), 6) AS recall FROM x LEFT JOIN y USING (query_id)")
def recall_at_k(t: Tables) -> DataFrame:
    ranked, relevant = _ranked(t)
    ids = lambda d: d.groupBy("query_id").agg(F.collect_list("item_id").alias("ids"))
    return search.recall(ids(ranked.filter("rank_no <= 10")), ids(relevant))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS retrieval_text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS nth FROM conversations WHERE role = 'user') WHERE nth <= 2 GROUP BY conv_id")
def conversation_context(t: Tables) -> DataFrame:
    return search.context_text(t.conversations)


CITED = "cited AS (SELECT doc_id % 50 AS query_id, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY n_chars DESC, doc_id) AS rank_no, source AS title, CASE WHEN doc_id % 2 = 0 THEN doc_id % 9 + 1 END AS page_no, text AS chunk_text, doc_id FROM documents)"


def _cited(t: Tables) -> DataFrame:
    return t.documents.selectExpr("doc_id % 50 AS query_id", "row_number() OVER (PARTITION BY doc_id % 50 ORDER BY n_chars DESC, doc_id) AS rank_no", "source AS title", "CASE WHEN doc_id % 2 = 0 THEN doc_id % 9 + 1 END AS page_no", "text AS chunk_text", "doc_id").filter("rank_no <= 8")


@query(f"""WITH {CITED}, k AS (SELECT *, least(800, greatest(1, 3200 // count(*) OVER (PARTITION BY query_id))) AS m FROM cited WHERE rank_no <= 8)
SELECT query_id, rank_no, concat('[', rank_no, ']') AS label, concat('[', rank_no, '] ', title, CASE WHEN page_no IS NOT NULL THEN concat(' p.', page_no) ELSE '' END, ': "', CASE WHEN length(chunk_text) <= m THEN chunk_text ELSE concat(substr(chunk_text, 1, m - 1), '…') END, '"') AS line FROM k""")
def prompt_citations(t: Tables) -> DataFrame:
    return search.citations(_cited(t))


@query(f"""WITH {CITED}, g AS (SELECT query_id, length(title) AS document_id, string_agg(DISTINCT doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR) AS chunk_ids, max(rank_no) AS best, min(rank_no) AS first_rank FROM cited WHERE rank_no <= 8 GROUP BY ALL)
SELECT query_id, document_id, chunk_ids, best, first_rank, row_number() OVER (PARTITION BY query_id ORDER BY first_rank, document_id) AS place FROM g""")
def grouped_sources(t: Tables) -> DataFrame:
    rows = _cited(t).select("query_id", F.length("title").alias("document_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("rank_no").alias("score"), "rank_no")
    return search.grouped_sources(rows).withColumn("chunk_ids", F.array_join("chunk_ids", ","))


@query(f"WITH RECURSIVE {TREE}, {READABLE} SELECT user_id AS answer_id, count(*) FILTER (document_id NOT IN (SELECT id FROM readable)) > 0 AS withheld FROM access_cache GROUP BY user_id")
def withheld_answers(t: Tables) -> DataFrame:
    """An answer is shown only if all its sources are readable: as a join, for source lists of any size."""
    known = t.access_cache.select(F.col("user_id").alias("answer_id"), F.col("document_id").alias("id")).join(readable(t).withColumn("ok", F.lit(True)), "id", "left")
    return known.groupBy("answer_id").agg((F.count_if(F.col("ok").isNull()) > 0).alias("withheld"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) / list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 6) AS norm, len(embedding) = 64 AS valid, TRUE AS same FROM embeddings")
def vector_codec(t: Tables) -> DataFrame:
    v = F.col("embedding")
    unit = fn.normalised(v)
    norm = F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x * x), 6)
    return t.embeddings.select("vec_id", norm.alias("norm"), fn.valid_vector(v, 64).alias("valid"), (fn.parse_vector(fn.vector_text(v)) == v).alias("same"))


@query()
def vector_hashes(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", fn.vector_hash("embedding").alias("vector_hash"))


# -- queues

DUE = f"status = 'PENDING' AND (next_retry_at IS NULL OR next_retry_at <= {AS_OF})"


@query(f"SELECT row_number() OVER (ORDER BY priority DESC, created_at, id) - 1 AS slot, id, priority, created_at FROM jobs WHERE {DUE} ORDER BY priority DESC, created_at, id LIMIT 25")
def claim_order(t: Tables) -> DataFrame:
    return queues.claim(t.jobs, now(), 25)


@query(f"SELECT id, lock_expires_at, retry_count + 1 AS retry_count, CASE WHEN retry_count + 1 < max_retry_count THEN 'PENDING' ELSE 'FAILED' END AS next_status FROM jobs WHERE status = 'PROCESSING' AND lock_expires_at <= {AS_OF}")
def expired_leases(t: Tables) -> DataFrame:
    return queues.expired(t.jobs, now())


@query("SELECT id, CASE WHEN retry_count + 1 >= max_retry_count THEN 'FAILED' ELSE 'PENDING' END AS next_status, CASE WHEN retry_count + 1 < max_retry_count THEN least(1000 * pow(2, retry_count), 60000)::BIGINT ELSE 0 END AS delay_ms FROM jobs")
def retry_schedule(t: Tables) -> DataFrame:
    return queues.failures(t.jobs).withColumn("delay_ms", F.coalesce("delay_ms", F.lit(0).cast("long")))


@query("SELECT id, CASE WHEN status IN ('RUNNING', 'IDLE') AND (last_heartbeat_at IS NULL OR last_heartbeat_at <= TIMESTAMP '2001-08-01 22:00:00') THEN 'DEAD' ELSE status END AS effective_status FROM workers")
def dead_workers(t: Tables) -> DataFrame:
    return queues.worker_status(t.workers, F.expr("TIMESTAMP_NTZ '2001-08-01 22:00:00'")).select("id", "effective_status")


JOBS = "version_jobs AS (SELECT id, (SELECT min(doc_id) FROM documents) * 10 + (id % (SELECT count(*) FROM documents)) * 10 + id % 2 + 1 AS version_id, status, CASE WHEN id % 4 = 0 THEN id * 3 END AS source_event_id FROM jobs)"


def version_jobs(t: Tables) -> DataFrame:
    """Jobs spread over the versions of all documents."""
    n = t.documents.agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    rows = t.jobs.select("id", "status").crossJoin(F.broadcast(n))
    return rows.select("id", (F.col("low") * 10 + (F.col("id") % F.col("n")) * 10 + F.col("id") % 2 + 1).alias("version_id"), "status", F.when(F.col("id") % 4 == 0, F.col("id") * 3).alias("source_event_id"))


@query(f"""WITH {JOBS}, l AS (SELECT document_id, arg_max(id, version_no) AS latest FROM versions GROUP BY document_id), a AS (SELECT DISTINCT version_id FROM version_jobs WHERE status IN ('PENDING', 'PROCESSING'))
SELECT j.id, j.version_id, CASE WHEN j.status <> 'FAILED' THEN 'JOB_NOT_FAILED' WHEN v.status <> 'FAILED' THEN 'VERSION_NOT_FAILED' WHEN f.status = 'DELETED' THEN 'DOCUMENT_DELETED' WHEN f.status NOT IN ('INDEXED', 'INDEXING', 'FAILED') THEN 'DOCUMENT_STATUS_INVALID'
  WHEN c.document_id IS DISTINCT FROM f.id THEN 'CURRENT_VERSION_INCONSISTENT' WHEN latest IS NULL THEN 'DATA_INCONSISTENT' WHEN latest <> j.version_id THEN 'SUPERSEDED_VERSION' WHEN a.version_id IS NOT NULL THEN 'LIVE_JOB_EXISTS' ELSE 'ELIGIBLE' END AS verdict
FROM version_jobs j JOIN versions v ON v.id = j.version_id LEFT JOIN files f ON f.id = v.document_id LEFT JOIN versions c ON c.id = f.current_version_id LEFT JOIN l ON l.document_id = v.document_id LEFT JOIN a ON a.version_id = j.version_id""")
def manual_retry(t: Tables) -> DataFrame:
    return lifecycle.retry_verdict(version_jobs(t), t.versions, t.files)


@query(f"SELECT count(*) FILTER ({DUE}) AS claimable, count(*) FILTER (status = 'PENDING' AND next_retry_at > {AS_OF}) AS delayed, count(*) FILTER (status = 'PROCESSING') AS processing, count(*) FILTER (status = 'FAILED') AS failed, min(coalesce(next_retry_at, created_at)) FILTER ({DUE}) AS oldest_due_at FROM jobs")
def queue_snapshot(t: Tables) -> DataFrame:
    return queues.queue_snapshot(t.jobs, now())


@query("SELECT id, version_id, status, priority FROM jobs WHERE status = 'FAILED' AND worker_id = 3 ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 20")
def jobs_page(t: Tables) -> DataFrame:
    rows = t.jobs.filter(permissions.optional("status", "FAILED") & permissions.optional("worker_id", 3) & permissions.optional("version_id", None))
    return rows.orderBy(F.desc("created_at"), F.desc("id")).offset(20).limit(20).select("id", "version_id", "status", "priority")


@query("SELECT id, document_id, version_no FROM versions WHERE id > 500 ORDER BY id LIMIT 50")
def keyset_page(t: Tables) -> DataFrame:
    return t.versions.filter("id > 500").orderBy("id").limit(50).select("id", "document_id", "version_no")


@query("SELECT l_orderkey, l_suppkey, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(t: Tables) -> DataFrame:
    return reconcile.duplicates(t.lineitem, "l_orderkey", "l_suppkey")


@query("WITH s AS (SELECT doc_id AS k, source AS payload FROM documents WHERE doc_id % 3 > 0), r AS (SELECT doc_id AS k, CASE WHEN doc_id % 5 = 0 THEN 'other' ELSE source END AS payload FROM documents) SELECT r.k, r.payload, CASE WHEN s.k IS NULL THEN 'CREATED' WHEN s.payload IS NOT DISTINCT FROM r.payload THEN 'REPLAYED' ELSE 'CONFLICT' END AS outcome FROM r LEFT JOIN s USING (k)")
def conflict_classification(t: Tables) -> DataFrame:
    rows = t.documents.selectExpr("doc_id AS k", "CASE WHEN doc_id % 5 = 0 THEN 'other' ELSE source END AS payload")
    return queues.classify_writes(t.documents.filter("doc_id % 3 > 0").selectExpr("doc_id AS k", "source AS payload"), rows, "k", "payload")


@query("SELECT user_id, min(event_id) AS event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) GROUP BY user_id")
def insert_all_absent(t: Tables) -> DataFrame:
    target = t.customer.filter("c_nationkey < 5").select(F.col("c_custkey").alias("user_id"))
    return queues.insert_absent(target, t.events.select("user_id", "event_id"), "user_id")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def unreferenced_objects(t: Tables) -> DataFrame:
    return queues.unreferenced(t.part.select("p_partkey"), t.lineitem.filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


# -- consistency

FACTS = """x AS (SELECT id AS version_id, CASE WHEN id % 7 = 0 THEN 0 ELSE id % 5 + 1 END AS chunk_count, CASE WHEN id % 3 = 0 THEN id % 5 + 1 ELSE id % 4 END AS active_vectors, CASE WHEN id % 11 = 0 THEN 0 WHEN id % 3 = 0 THEN id % 5 + 1 ELSE id % 4 END AS model_vectors, CASE WHEN id % 13 < 4 AND id % 3 > 0 THEN id % 4 ELSE id % 5 + 1 END AS all_vectors, id % 4 = 0 AS live_job FROM versions),
facts AS (SELECT v.id, v.status, v.age_minutes, f.status AS document_status, f.current_version_id, x.*, f.current_version_id IS NOT DISTINCT FROM v.id AS is_current, sum(x.active_vectors) OVER (PARTITION BY v.document_id) AS document_vectors FROM versions v JOIN files f ON f.id = v.document_id JOIN x ON x.version_id = v.id)"""


def _facts(t: Tables) -> DataFrame:
    v = t.versions
    chunk_counts = v.selectExpr("id AS version_id", "CASE WHEN id % 7 = 0 THEN 0 ELSE id % 5 + 1 END AS chunk_count").filter("chunk_count > 0")
    vector_counts = v.selectExpr("id AS version_id", "CASE WHEN id % 3 = 0 THEN id % 5 + 1 ELSE id % 4 END AS active_vectors", "CASE WHEN id % 11 = 0 THEN 0 WHEN id % 3 = 0 THEN id % 5 + 1 ELSE id % 4 END AS model_vectors", "CASE WHEN id % 13 < 4 AND id % 3 > 0 THEN id % 4 ELSE id % 5 + 1 END AS all_vectors")
    return reconcile.facts(v, t.files, chunk_counts, vector_counts, v.filter("id % 4 = 0").selectExpr("id AS version_id"))


BUSY = "status IN ('UPLOADED', 'PARSING', 'CHUNKED', 'EMBEDDING')"
SHORT = "status = 'INDEXED' AND is_current AND document_status <> 'DELETED' AND chunk_count > active_vectors"
PART = "model_vectors = active_vectors AND model_vectors < chunk_count"


@query(f"""WITH {FACTS} SELECT id AS version_id, 'MISSING_JOB' AS issue, 'ERROR' AS severity, TRUE AS repairable FROM facts WHERE {BUSY} AND NOT live_job
UNION ALL SELECT id, 'MISSING_CHUNKS', 'CRITICAL', FALSE FROM facts WHERE status IN ('CHUNKED', 'EMBEDDING', 'INDEXED') AND chunk_count = 0
UNION ALL SELECT id, CASE WHEN model_vectors = 0 AND all_vectors >= chunk_count THEN 'MODEL_MISMATCH' ELSE 'MISSING_EMBEDDINGS' END, 'CRITICAL', {PART} FROM facts WHERE {SHORT}
UNION ALL SELECT id, 'INVALID_CURRENT_VERSION', 'CRITICAL', FALSE FROM facts WHERE document_status = 'INDEXED' AND (current_version_id IS NULL OR is_current AND status <> 'INDEXED')
UNION ALL SELECT id, 'STALLED_VERSION', CASE WHEN live_job THEN 'WARNING' ELSE 'ERROR' END, FALSE FROM facts WHERE {BUSY} AND age_minutes > 60
UNION ALL SELECT id, 'DELETED_DOCUMENT_RESIDUE', 'CRITICAL', FALSE FROM facts WHERE document_status = 'DELETED' AND is_current AND document_vectors > 0""")
def consistency_issues(t: Tables) -> DataFrame:
    return reconcile.inspect(_facts(t))


@query(f"WITH {FACTS} SELECT id AS version_id, chunk_count - active_vectors AS missing FROM facts WHERE status = 'INDEXED' AND is_current AND NOT live_job AND active_vectors > 0 AND active_vectors < chunk_count AND active_vectors = all_vectors")
def repairable_versions(t: Tables) -> DataFrame:
    return reconcile.repairable(_facts(t))


@query("SELECT e.vec_id, e.label FROM embeddings e WHERE e.vec_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'fr') OR e.label NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey > 0)")
def orphan_rows(t: Tables) -> DataFrame:
    parents = {"vec_id": t.documents.filter("lang <> 'fr'").select(F.col("doc_id").alias("id")), "label": t.nation.filter("n_regionkey > 0").select(F.col("n_nationkey").alias("id"))}
    return reconcile.orphans(t.embeddings.select("vec_id", "label"), parents)


@query("WITH o AS (SELECT doc_id AS issue_key FROM documents WHERE doc_id % 3 = 0), s AS (SELECT doc_id AS issue_key, CASE doc_id % 4 WHEN 0 THEN 'RESOLVED' ELSE 'OPEN' END AS status FROM documents WHERE doc_id % 2 = 0) SELECT issue_key, CASE WHEN s.status IS NULL THEN 'OPEN' WHEN o.issue_key IS NOT NULL AND s.status = 'RESOLVED' THEN 'REOPEN' WHEN o.issue_key IS NOT NULL THEN 'KEEP' WHEN s.status <> 'RESOLVED' THEN 'RESOLVE' ELSE 'NONE' END AS action FROM o FULL JOIN s USING (issue_key)")
def issue_resolution(t: Tables) -> DataFrame:
    stored = t.documents.filter("doc_id % 2 = 0").selectExpr("doc_id AS issue_key", "CASE doc_id % 4 WHEN 0 THEN 'RESOLVED' ELSE 'OPEN' END AS status")
    return reconcile.resolve(t.documents.filter("doc_id % 3 = 0").selectExpr("doc_id AS issue_key"), stored)


@query("SELECT document_id, max(version_no) AS version_no, arg_max(status, version_no) AS status FROM versions GROUP BY document_id")
def latest_version(t: Tables) -> DataFrame:
    return reconcile.latest(t.versions.select("document_id", "version_no", "status"), "document_id", "version_no")


@query("SELECT v.id AS version_id, CASE WHEN f.id IS NOT NULL THEN 'ACTIVE' ELSE 'STALE' END AS status FROM versions v LEFT JOIN files f ON f.current_version_id = v.id")
def stale_vectors(t: Tables) -> DataFrame:
    rows = t.versions.select(F.col("id").alias("version_id"), F.lit("ACTIVE").alias("status"))
    return reconcile.stale_vectors(rows, t.files.filter("current_version_id IS NOT NULL").select(F.col("current_version_id").alias("version_id")))


# -- analytics


@query("SELECT round(avg(date_diff('microsecond', o_orderdate, l_shipdate) / 1000))::BIGINT AS mean_ms FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def mean_latency(t: Tables) -> DataFrame:
    return analytics.mean_millis(t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderdate", "l_shipdate"), "o_orderdate", "l_shipdate")


@query("SELECT event_type, round(quantile_disc(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.5), 6) AS median, count(*) AS n FROM events GROUP BY event_type")
def percentiles(t: Tables) -> DataFrame:
    return analytics.percentiles(t.events, "value", "event_type").select("event_type", F.round("p95", 6).alias("p95"), F.round("median", 6).alias("median"), "n")


@query("SELECT l_returnflag, round(quantile_disc(l_extendedprice, 0.95), 6) AS p95, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def rank_percentiles(t: Tables) -> DataFrame:
    """percentiles() with a limit that makes each of the three keys one of many rows: all ranks are looked for in cells."""
    found = quantiles.percentiles(t.lineitem, "l_extendedprice", "l_returnflag", limit=1000)
    return found.select("l_returnflag", F.round("p95", 6).alias("p95"), F.round("median", 6).alias("median"), "n")


@query("SELECT date_trunc('hour', ts) AS bucket, count(*) FILTER (value < 80) AS good, count(*) FILTER (NOT value < 80) AS bad FROM events GROUP BY 1")
def status_buckets(t: Tables) -> DataFrame:
    return analytics.buckets(t.events.select("ts", (F.col("value") < 80).alias("ok")), "hour")


@query("WITH s AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value < 80 AS ok FROM events), w AS (SELECT key, step, bool_and(ok) OVER x AS a, count(*) OVER x AS n FROM s WINDOW x AS (PARTITION BY key ORDER BY step ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) SELECT key, min(step) AS steady_from FROM w WHERE a AND n = 5 GROUP BY key")
def first_steady(t: Tables) -> DataFrame:
    return analytics.first_steady(t.events.selectExpr("user_id AS key", "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step", "value < 80 AS ok"), "key")


@query("""WITH s AS (SELECT user_id, epoch_us(ts) // 86400000000 AS unit, value < 95 AS ok FROM events), seen AS (SELECT user_id, unit, bool_and(ok) AS ok FROM s GROUP BY ALL),
ends AS (SELECT user_id, min(unit) AS low, max(unit) AS high, max(unit) FILTER (NOT ok) AS last_bad FROM s GROUP BY user_id), axis AS (SELECT user_id, unnest(range(low, high + 1)) AS unit FROM ends),
j AS (SELECT a.user_id, a.unit, coalesce(ok, FALSE) AS ok FROM axis a LEFT JOIN seen USING (user_id, unit)),
w AS (SELECT j.user_id, unit, bool_and(ok) OVER x AS a, count(*) OVER x AS n FROM j JOIN ends e ON e.user_id = j.user_id AND (last_bad IS NULL OR unit > last_bad) WINDOW x AS (PARTITION BY j.user_id ORDER BY unit ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING))
SELECT user_id, last_bad, steady_from, steady_from - coalesce(last_bad, low - 1) AS recovery_units FROM ends LEFT JOIN (SELECT user_id, min(unit) AS steady_from FROM w WHERE a AND n = 2 GROUP BY user_id) USING (user_id)""")
def steady_recovery(t: Tables) -> DataFrame:
    """For each user the first two days in a row with good events alone, after the last bad one; a day without events isn't good."""
    rows = t.events.select("user_id", "ts", (F.col("value") < 95).alias("ok"))
    return spine.steady_from(spine.dense(rows, "user_id", 86_400), rows, "user_id", 86_400, 2)


@query("""WITH s AS (SELECT user_id, event_id, value < 80 AND lead(value, 1) OVER o < 80 AND lead(value, 2) OVER o < 80 AS hit, lag(event_id) OVER o AS before, lead(event_id, 2) OVER o AS third FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, arg_min(coalesce(before, -1), event_id) AS not_before, min(event_id) AS reached_at, arg_min(third, event_id) AS confirmed_at FROM s WHERE hit GROUP BY user_id""")
def confirmed_recovery(t: Tables) -> DataFrame:
    """For each user the first of three good events in a row, the event before it (-1: none) and the one that confirms it."""
    rows = t.events.select("user_id", F.col("event_id").alias("ts"), (F.col("value") < 80).alias("ok"))
    return spine.first_confirmed(rows, "user_id").withColumn("not_before", F.coalesce("not_before", F.lit(-1)))


@query(f"SELECT max(ts) FILTER (value < 80 AND ts < {EVENTS_NOW}) AS last_good, min(ts) FILTER (NOT value < 80 AND ts >= {EVENTS_NOW}) AS first_bad, min(ts) FILTER (value < 80 AND ts >= {EVENTS_NOW}) AS next_good FROM events")
def event_anchors(t: Tables) -> DataFrame:
    return analytics.anchors(t.events.select("ts", (F.col("value") < 80).alias("ok")), F.expr(EVENTS_NOW))


@query(f"WITH b AS (SELECT arg_max(value, ts) AS base FROM events WHERE ts < {EVENTS_NOW}) SELECT min(ts) AS first_ts, min(base) AS base FROM events, b WHERE ts >= {EVENTS_NOW} AND value > base")
def first_above(t: Tables) -> DataFrame:
    return analytics.first_above(t.events.select("ts", "value"), F.expr(EVENTS_NOW))


@query("WITH s AS (SELECT o_orderkey AS request_id, o_orderstatus <> 'F' AS acked FROM orders), d AS (SELECT l_orderkey + (l_orderkey % 97 = 0)::INT * 10000000 AS request_id, count(*) FILTER (l_linenumber < 2 OR l_orderkey % 50 = 0) AS row_count FROM lineitem GROUP BY 1), j AS (SELECT s.request_id AS sent, acked, coalesce(row_count, 0) AS n FROM s FULL JOIN d USING (request_id)) SELECT count(sent) AS sent, count(*) FILTER (acked AND n = 0) AS missing, count(*) FILTER (n > 1) AS duplicated, count(*) FILTER (sent IS NULL) AS unknown, count(*) FILTER (acked AND n = 0 OR n > 1) = 0 AS clean FROM j")
def ledger_reconcile(t: Tables) -> DataFrame:
    stored = t.lineitem.groupBy((F.col("l_orderkey") + F.when(F.col("l_orderkey") % 97 == 0, 10_000_000).otherwise(0)).alias("request_id")).agg(F.count_if((F.col("l_linenumber") < 2) | (F.col("l_orderkey") % 50 == 0)).alias("row_count"))
    return analytics.reconcile_ledger(t.orders.selectExpr("o_orderkey AS request_id", "o_orderstatus <> 'F' AS acked"), stored)


@query("WITH a AS (SELECT date_trunc('hour', ts) AS bucket, round(sum(value), 4) AS left_value FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT date_trunc('hour', ts) AS bucket, round(sum(value), 4) AS right_value FROM events WHERE event_type <> 'click' GROUP BY 1) SELECT bucket, left_value, right_value FROM a FULL JOIN b USING (bucket)")
def align_all_series(t: Tables) -> DataFrame:
    both = analytics.align(t.events.filter("event_type = 'click'").select("ts", "value"), t.events.filter("event_type <> 'click'").select("ts", "value"), "hour")
    return both.select("bucket", F.round("left_value", 4).alias("left_value"), F.round("right_value", 4).alias("right_value"))


@query("WITH s AS (SELECT event_type, ts, event_id, floor(value) AS value, lag(floor(value)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM events), i AS (SELECT event_type, ts, CASE WHEN p IS NULL THEN 0 WHEN value >= p THEN value - p ELSE value END AS g FROM s), w AS (SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) + k * INTERVAL 6 HOUR AS moment, g FROM i, (VALUES (1), (2)) AS v(k)) SELECT moment, event_type, sum(g) AS increase FROM w GROUP BY ALL")
def rate_windows(t: Tables) -> DataFrame:
    rows = t.events.select("event_type", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), F.floor("value").cast("double").alias("value"))
    return series.rates(rows, "12 hours", "6 hours", "event_type").select(F.col("at").cast("timestamp_ntz").alias("moment"), "event_type", "increase")


@query("""WITH s AS (SELECT event_type, ts, event_id, floor(value) AS value, lag(ts) OVER o AS pts, lag(floor(value)) OVER o AS pv FROM events WINDOW o AS (PARTITION BY event_type ORDER BY ts, event_id)),
w AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts - INTERVAL 1 MICROSECOND) + k * INTERVAL 6 HOUR AS moment FROM s, (VALUES (1), (2)) AS v(k)),
g AS (SELECT moment, event_type, count(*) AS n, min(ts) AS a, max(ts) AS b, arg_min(value, (ts, event_id)) AS v0, arg_max(value, (ts, event_id)) AS v1, sum(CASE WHEN pts > moment - INTERVAL 12 HOUR AND value < pv THEN pv ELSE 0 END) AS lost FROM w GROUP BY ALL HAVING count(*) > 1 AND max(ts) > min(ts)),
x AS (SELECT *, v1 - v0 + lost AS grown, epoch_us(b) / 1e6 - epoch_us(a) / 1e6 AS span, epoch_us(a) / 1e6 - epoch_us(moment - INTERVAL 12 HOUR) / 1e6 AS before, epoch_us(moment) / 1e6 - epoch_us(b) / 1e6 AS after FROM g),
y AS (SELECT *, span / (n - 1) AS mean, CASE WHEN grown > 0 AND v0 >= 0 THEN span * v0 / grown END AS zero FROM x)
SELECT moment, event_type, n AS samples, round(grown * (span + least(CASE WHEN before >= mean * 1.1 THEN mean / 2 ELSE before END, zero) + CASE WHEN after >= mean * 1.1 THEN mean / 2 ELSE after END) / span, 4) AS increase,
  round(grown * (span + least(CASE WHEN before >= mean * 1.1 THEN mean / 2 ELSE before END, zero) + CASE WHEN after >= mean * 1.1 THEN mean / 2 ELSE after END) / span / 43200, 6) AS rate FROM y""")
def counter_rates(t: Tables) -> DataFrame:
    rows = t.events.select("event_type", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), F.floor("value").cast("double").alias("value"))
    found = series.counter_rates(rows, "12 hours", "6 hours", "event_type")
    return found.select(F.col("at").cast("timestamp_ntz").alias("moment"), "event_type", "samples", F.round("increase", 4).alias("increase"), F.round("rate", 6).alias("rate"))


@query("WITH m AS (SELECT date_trunc('day', ts) AS moment, count(*) FILTER (value > 70) AS failed, count(*) AS total FROM events GROUP BY 1) SELECT moment, round(failed / greatest(total, 0.001), 6) AS share FROM m WHERE total >= 20 AND failed / greatest(total, 0.001) > 0.2")
def ratio_alert(t: Tables) -> DataFrame:
    rows = t.events.groupBy(F.date_trunc("day", "ts").alias("at")).agg(F.count_if(F.col("value") > 70).alias("failed"), F.count("*").alias("total"))
    return analytics.ratio_alert(rows).withColumnRenamed("at", "moment")


@query("WITH m AS (SELECT user_id, date_trunc('day', ts) AS moment, max(value) > 60 AS firing FROM events GROUP BY ALL), w AS (SELECT *, bool_and(firing) OVER x AS a, count(*) OVER x AS n FROM m WINDOW x AS (PARTITION BY user_id ORDER BY moment ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT user_id, moment FROM w WHERE a AND n = 3")
def held_alert(t: Tables) -> DataFrame:
    rows = t.events.groupBy("user_id", F.date_trunc("day", "ts").alias("at")).agg((F.max("value") > 60).alias("firing"))
    return analytics.held(rows, "user_id", steps=3).withColumnRenamed("at", "moment")


@query("WITH b AS (SELECT event_type, le, count(*) FILTER (value <= le) AS count FROM events, (VALUES (10.0::DOUBLE), (25.0), (50.0), (100.0), (1000.0)) AS v(le) GROUP BY ALL), w AS (SELECT *, coalesce(lag(le) OVER o, 0) AS low, coalesce(lag(count) OVER o, 0) AS under, 0.9 * max(count) OVER (PARTITION BY event_type) AS rank FROM b WINDOW o AS (PARTITION BY event_type ORDER BY le)) SELECT event_type, round(low + (le - low) * (rank - under) / (count - under), 6) AS quantile FROM w WHERE count >= rank AND under < rank")
def histogram_quantile(t: Tables) -> DataFrame:
    bounds = [10.0, 25.0, 50.0, 100.0, 1000.0]
    wide = t.events.groupBy("event_type").agg(*[F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(bounds)])
    rows = wide.select("event_type", F.inline(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(bounds)])))
    return analytics.histogram_quantile(rows, 0.9, "event_type")


@query("WITH w AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) SELECT user_id, count(*) FILTER (p <> event_type) AS changes FROM w GROUP BY user_id")
def value_changes(t: Tables) -> DataFrame:
    return analytics.changes(t.events.select("user_id", F.col("event_id").alias("ts"), F.col("event_type").alias("value")), "user_id")


@query("SELECT count(*) FILTER (status = 'DONE') AS done, count(*) FILTER (status = 'FAILED') AS failed, round(count(*) FILTER (status = 'DONE') * 1000 / nullif(count(*) FILTER (status IN ('DONE', 'FAILED')), 0)) / 10 AS per_cent FROM attempts")
def success_rate(t: Tables) -> DataFrame:
    return analytics.success_rate(t.attempts)


@query("WITH r AS (SELECT CASE WHEN o_orderkey % 100 = 1 THEN 'FAILED' ELSE 'INDEXED' END AS status, o_orderkey % 9 AS chunks, CASE WHEN o_orderkey % 101 = 0 THEN 0 ELSE o_orderkey % 9 END AS vectors, (o_orderkey % 500 = 0)::INT AS copies, o_orderkey % 4 AS retries FROM orders) SELECT count(*) AS seen, count(*) FILTER (status <> 'INDEXED') AS incomplete, count(*) FILTER (status = 'INDEXED' AND chunks <> vectors) AS mismatched, count(*) FILTER (copies > 0) AS duplicated, count(*) FILTER (retries > 0) AS retried, count(*) = 15000 AND count(*) FILTER (status <> 'INDEXED') + count(*) FILTER (status = 'INDEXED' AND chunks <> vectors) + count(*) FILTER (copies > 0) = 0 AS passed FROM r")
def recovery_verdict(t: Tables) -> DataFrame:
    rows = t.orders.selectExpr("CASE WHEN o_orderkey % 100 = 1 THEN 'FAILED' ELSE 'INDEXED' END AS status", "o_orderkey % 9 AS chunks", "CASE WHEN o_orderkey % 101 = 0 THEN 0 ELSE o_orderkey % 9 END AS vectors", "cast(o_orderkey % 500 = 0 AS int) AS copies", "o_orderkey % 4 AS retries")
    return analytics.recovery_verdict(rows, 15_000)


@query("SELECT CASE WHEN regexp_matches(p_type, 'BRASS|COPPER') THEN 'metal' WHEN regexp_matches(p_type, '^PROMO') THEN 'promo' END AS class, count(*) AS calls, round(sum(p_retailprice), 2) AS amount FROM part GROUP BY 1")
def classified_statements(t: Tables) -> DataFrame:
    rows = analytics.classified(t.part, {"metal": "BRASS|COPPER", "promo": "^PROMO"}, "p_type")
    return rows.groupBy("class").agg(F.count("*").alias("calls"), F.round(F.sum("p_retailprice"), 2).alias("amount"))


@query("SELECT (SELECT count(*) FROM files) AS documents, (SELECT count(*) FROM files WHERE status = 'INDEXED') AS indexed, (SELECT count(*) FROM jobs WHERE status = 'PENDING') AS pending, (SELECT count(*) FROM workers WHERE status <> 'STOPPED') AS live_workers")
def dashboard_summary(t: Tables) -> DataFrame:
    one = t.files.agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "INDEXED").alias("indexed"))
    two = t.jobs.agg(F.count_if(F.col("status") == "PENDING").alias("pending"))
    return one.crossJoin(F.broadcast(two)).crossJoin(F.broadcast(t.workers.agg(F.count_if(F.col("status") != "STOPPED").alias("live_workers"))))


@query("SELECT lang, source, visibility, count(*) AS n FROM (SELECT lang, source, visibility FROM files WHERE status <> 'DELETED') GROUP BY ALL")
def status_counts(t: Tables) -> DataFrame:
    return t.files.filter("status <> 'DELETED'").groupBy("lang", "source", "visibility").agg(F.count("*").alias("n"))


# -- sequential rules and streams


def _calls(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("at_ms"), F.col("event_id").alias("call_id"))


@query(f"""WITH RECURSIVE c AS (SELECT user_id AS key, event_id AS call_id, epoch_us(ts) // 1000 AS at_ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS nth FROM events),
r AS (SELECT key, call_id, nth, at_ms AS opened, 1 AS used FROM c WHERE nth = 1 UNION ALL
  SELECT c.key, c.call_id, c.nth, CASE WHEN c.at_ms - opened >= {36 * 3_600_000} THEN c.at_ms ELSE opened END, CASE WHEN c.at_ms - opened >= {36 * 3_600_000} THEN 1 ELSE used + 1 END FROM r JOIN c ON c.key = r.key AND c.nth = r.nth + 1)
SELECT key, call_id, used <= 3 AS allowed FROM r""")
def rate_limit(t: Tables) -> DataFrame:
    return limits.rate_limit(_calls(t), 3, 36 * 3_600_000)


@query("""WITH RECURSIVE c AS (SELECT user_id AS key, event_id AS poll_no, value > 60 AS found, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events),
r AS (SELECT key, poll_no, nth, CASE WHEN found THEN 500 ELSE 1000 END AS wait_ms FROM c WHERE nth = 1 UNION ALL
  SELECT c.key, c.poll_no, c.nth, CASE WHEN c.found THEN 500 ELSE least(wait_ms * 2, 8000) END FROM r JOIN c ON c.key = r.key AND c.nth = r.nth + 1)
SELECT key, poll_no, wait_ms FROM r""")
def idle_waits(t: Tables) -> DataFrame:
    return limits.idle_waits(t.events.select(F.col("user_id").alias("key"), F.col("event_id").alias("poll_no"), (F.col("value") > 60).alias("found")))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(t: Tables) -> DataFrame:
    """The batch run of the streaming plan in lectern.streaming.live."""
    rows = live.windowed_counts(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "1 day")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT to_json(n)::VARCHAR AS value FROM nation n")
def json_rows(t: Tables) -> DataFrame:
    return sources.as_json(t.nation)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permission-filtered hybrid retrieval."""
    return hybrid_fusion(Tables.of(spark, sf_dir))


from lectern.plans import lifecycle as _more  # noqa: E402, F401  registers its queries here
from lectern.plans import contracts as _contracts  # noqa: E402, F401
from lectern.plans import storage as _storage  # noqa: E402, F401
