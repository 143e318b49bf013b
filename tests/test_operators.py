import pytest
from pyspark.sql import functions as F

from lectern.functions import text as fn
from lectern.operators import analytics, chunking, limits, permissions, queues, search
from lectern.sources import files
from lectern.streaming import live


def test_chunks_cover_text_without_tail(spark):
    docs = spark.createDataFrame([(1, 0, "x" * 2600), (2, 0, "ab"), (3, 0, "é😀" * 600), (4, 0, "")], "document_id long, segment_no int, text string")
    parts = chunking.chunks(docs)
    spans = {d: [tuple(r) for r in parts.filter(f"document_id = {d}").orderBy("chunk_index").select("char_start", "char_end").collect()] for d in (1, 2, 3, 4)}
    assert spans == {1: [(0, 1000), (800, 1800), (1600, 2600)], 2: [(0, 2)], 3: [(0, 1000), (800, 1200)], 4: []}
    back = {r.document_id: r.text for r in chunking.restored(parts).collect()}
    assert back == {1: "x" * 2600, 2: "ab", 3: "é😀" * 600}
    assert chunking.discontinuities(parts).count() == 0


def test_segments_never_share_a_chunk(spark):
    docs = spark.createDataFrame([(1, 0, "a" * 1500), (1, 1, "b" * 10)], "document_id long, segment_no int, text string")
    parts = chunking.chunks(docs).orderBy("chunk_index").select("chunk_index", "char_start", "char_end").collect()
    assert [tuple(p) for p in parts] == [(0, 0, 1000), (1, 800, 1500), (2, 1501, 1511)]
    assert chunking.restored(chunking.chunks(docs)).first().text == "a" * 1500 + "\n" + "b" * 10


@pytest.mark.parametrize(("size", "overlap"), [(0, 0), (10, 10), (10, -1)])
def test_bad_settings(size, overlap):
    with pytest.raises(ValueError):
        chunking.check_settings(size, overlap)


def test_batches_fill_in_order(spark):
    rows = [(1, i, "x" * 900, 100) for i in range(6)] + [(1, 6, "x" * 900, 899), (2, 0, "x" * 5000, 1)]
    out = chunking.plan_batches(spark.createDataFrame(rows, "document_id long, chunk_index int, chunk_text string, token_count int"))
    assert [r.batch_no for r in out.filter("document_id = 1").orderBy("chunk_index").collect()] == [0, 0, 0, 0, 1, 1, 2]
    assert out.filter("document_id = 2").count() == 1


def test_markdown_sections():
    text = "# A\n\n## B\nbody\n```\n# no heading\n```\n# C ##\ntail\n# #\nend"
    assert [(title, text.split("\n")[0]) for title, _, text in chunking.markdown_sections(text)] == [("B", "# A"), ("C", "# C ##")]
    paths = [path for _, path, _ in chunking.markdown_sections(text)]
    assert '["A", "B"]' in paths[0] and '["C"]' in paths[1]


def test_query_terms():
    assert fn.query_terms("서버에서는 Redis를 'cache' cache로 어떻게?") == ["서버", "redis", "cache"]
    assert fn.query_terms(None) == [] and fn.query_terms("왜 a ?") == []
    assert fn.term_pattern("om") == "(^|[^a-z0-9])om([^a-z0-9]|$)" and fn.term_pattern("c++") == r"c\+\+"


def test_text_functions(spark):
    row = spark.range(1).select(
        fn.shortened(F.lit("a😀bcd"), 3).alias("short"), fn.id_list(F.lit("[1,2]")).alias("ids"), fn.id_list(F.lit('[1,"x"]')).alias("bad"), fn.ids_text(F.array(F.lit(3), F.lit(1), F.lit(3))).alias("text"),
        fn.heading_path(F.lit('{"headingPath":["a","b"]}'), F.lit("t")).alias("path"), fn.heading_path(F.lit("oops"), F.lit("t")).alias("title"), fn.backoff(F.lit(3), 1000, 60_000).alias("delay"),
        fn.jittered(F.lit(1000), F.lit(1.0), 0.2, F.lit(0), 1100).alias("jitter"), fn.token_count(F.lit("  a b\n c ")).alias("tokens"), fn.framed_hash(F.lit("ab"), F.lit(None).cast("string")).alias("framed"),
    ).first()
    import hashlib

    assert (row.short, row.ids, row.bad, row.text, row.path, row.title, row.delay, row.jitter, row.tokens) == ("a😀…", [1, 2], None, "[1,3]", "a > b", "t", 8000, 1100, 3)
    assert row.framed == hashlib.sha256(b"\0\0\0\2ab\xff\xff\xff\xff").hexdigest()


def test_scope_hides_other_documents(spark):
    chunks = spark.createDataFrame([(1, 1, "red cat"), (2, 2, "red dog"), (3, 3, "blue")], "chunk_id long, document_id long, chunk_text string")
    some = search.in_scope(chunks, spark.createDataFrame([(1,), (3,)], "id long"))
    counts = {r.ord: r.matched for r in search.term_frequencies(search.hits(some, ["red", "dog"]), ["red", "dog"]).collect()}
    assert counts == {0: 2, 1: 1, 2: 0}
    none = search.in_scope(chunks, spark.createDataFrame([], "id long"))
    assert {r.matched for r in search.term_frequencies(search.hits(none, ["red"]), ["red"]).collect()} == {0}


def test_fusion_thresholds_bonus_and_cap(spark):
    near = spark.createDataFrame([(1, 1, 0.9), (2, 1, 0.8), (3, 1, 0.7), (4, 2, 0.44), (5, 3, 0.45)], "chunk_id long, document_id long, similarity double").withColumn("similarity", F.col("similarity").cast("decimal(20,6)"))
    lexical = spark.createDataFrame([(6, 4, 0.9), (4, 2, 0.2), (2, 1, 1.0)], "chunk_id long, document_id long, coverage double")
    every = near.union(spark.createDataFrame([(6, 4, 0.1)], "chunk_id long, document_id long, similarity double").withColumn("similarity", F.col("similarity").cast("decimal(20,6)")))
    out = [(r.chunk_id, r.score) for r in search.fused(near, lexical, every, 10).orderBy("rank_no").collect()]
    assert out == [(1, 0.9), (2, 0.9), (5, 0.45), (6, 0.19)]


def test_rate_limit_window_starts_with_first_call(spark):
    calls = spark.createDataFrame([(1, t, i) for i, t in enumerate([0, 10, 20, 99, 100, 101, 250])], "key long, at_ms long, call_id long")
    allowed = [r.allowed for r in limits.rate_limit(calls, 2, 100).orderBy("call_id").collect()]
    assert allowed == [True, True, False, False, True, True, True]


def test_streamed_rate_limit_equals_batch(spark, tmp_path):
    calls = spark.createDataFrame([(k, t * 7 % 400, k * 100 + t) for k in range(3) for t in range(40)], "key long, at_ms long, call_id long")
    calls.write.parquet(str(tmp_path / "in"))
    out = live.rate_limited(spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in")), 3, 100)
    q = out.writeStream.format("memory").queryName("limited").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = {(r.call_id, r.allowed) for r in limits.rate_limit(calls, 3, 100).collect()}
    assert {(r.call_id, r.allowed) for r in spark.table("limited").collect()} == want


def test_windowed_stream(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id AS int)) AS ts, 'a' AS event_type, 1.0D AS value FROM range(300)")
    rows.write.parquet(str(tmp_path / "in"))
    q = live.windowed_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.n, r.total) for r in spark.table("windows").collect()} == {(60, 60.0)}


def test_keyed_sink_and_ledger(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id long, v string")
    rows.limit(0).write.parquet(str(tmp_path / "t"))
    assert files.append_absent(spark, rows, str(tmp_path / "t"), "id") == 2
    assert files.append_absent(spark, rows, str(tmp_path / "t"), "id") == 0
    (tmp_path / "l.csv").write_text("request_id,outcome,http_status,sent_at,completed_at\nr1,ok,200,2024-01-01 00:00:00,2024-01-01 00:00:01\n")
    assert files.ledger(spark, str(tmp_path / "l.csv")).first().http_status == 200
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfhi\r\nyou")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    found = chunking.parse_text(files.objects(spark, str(tmp_path / "*.txt")).filter(files.accepted(files.objects(spark, str(tmp_path / "*.txt")))))
    assert [r.text for r in found.collect()] == ["hi\nyou"]


def test_empty_tables(spark):
    jobs = spark.createDataFrame([], "id long, status string, priority int, created_at timestamp_ntz, next_retry_at timestamp_ntz")
    now = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")
    assert queues.claim(jobs, now, 3).count() == 0
    assert queues.queue_snapshot(jobs, now).first().claimable == 0
    assert analytics.success_rate(jobs.select("status")).first().per_cent is None
    tree = permissions.closure(spark, spark.createDataFrame([(1, None), (2, 1), (3, 2)], "id int, parent_id int"))
    assert {tuple(r) for r in tree.collect()} == {(1, 1, 0), (2, 2, 0), (3, 3, 0), (1, 2, 1), (2, 3, 1), (1, 3, 2)}


def test_closure_of_a_deep_tree(spark):
    chain = spark.range(30).selectExpr("cast(id AS int) AS id", "cast(CASE WHEN id > 0 THEN id - 1 END AS int) AS parent_id")
    out = permissions.closure(spark, chain)
    assert (out.count(), out.agg({"depth": "max"}).first()[0]) == (465, 29)


def test_retry_reasons_come_in_their_order(spark):
    from lectern.operators import lifecycle

    versions = [(11, 1, 1, "FAILED"), (12, 1, 2, "FAILED"), (21, 2, 1, "FAILED"), (31, 3, 1, "FAILED"), (41, 4, 1, "FAILED"), (51, 5, 1, "INDEXED"), (61, 6, 1, "FAILED")]
    docs = [(1, "FAILED", 11), (2, "DELETED", 21), (3, "ARCHIVED", 31), (4, "FAILED", 61), (5, "INDEXED", 51), (6, "FAILED", None)]
    jobs = [(1, 11, "FAILED"), (2, 12, "FAILED"), (3, 12, "PENDING"), (4, 21, "FAILED"), (5, 31, "FAILED"), (6, 41, "FAILED"), (7, 51, "FAILED"), (8, 61, "FAILED")]
    frames = [spark.createDataFrame(versions, "id long, document_id long, version_no int, status string"), spark.createDataFrame(docs, "id long, status string, current_version_id long")]
    out = {r.id: r.verdict for r in lifecycle.retry_verdict(spark.createDataFrame(jobs, "id long, version_id long, status string"), *frames).collect()}
    inconsistent = "CURRENT_VERSION_INCONSISTENT"
    assert out == {1: "SUPERSEDED_VERSION", 2: "LIVE_JOB_EXISTS", 3: "JOB_NOT_FAILED", 4: "DOCUMENT_DELETED", 5: "DOCUMENT_STATUS_INVALID", 6: inconsistent, 7: "VERSION_NOT_FAILED", 8: inconsistent}


def test_encoder_is_checked(spark):
    parts = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "document_id long, chunk_index int, chunk_text string")
    assert [r.vector for r in chunking.embedded(parts, lambda texts: [[float(len(t)), 2.0] for t in texts], "m", 2).collect()] == [[1.0, 2.0]] * 2
    for wrong in (lambda texts: [], lambda texts: [[1.0]] * len(texts), lambda texts: [[1.0, float("nan")]] * len(texts)):
        with pytest.raises(Exception, match="finite vectors"):
            chunking.embedded(parts, wrong, "m", 2).collect()


def test_utf16_cap_keeps_pairs_whole(spark):
    row = spark.range(1).select(search.capped_units(F.lit("ab😀c"), 3).alias("split"), search.capped_units(F.lit("ab😀c"), 4).alias("pair"), search.capped_units(F.lit("abc"), 3).alias("all")).first()
    assert tuple(row) == ("ab", "ab😀", "abc")


def test_embedding_input_drops_leading_headings(spark):
    rows = spark.createDataFrame([(1, ["a" * 150, "b" * 60, "c"], "t"), (2, ["x" * 300], "t"), (3, [], "t")], "id int, h array<string>, t string")
    out = {r.id: r.i for r in rows.select("id", chunking.embedding_input(F.col("h"), F.col("t")).alias("i")).collect()}
    assert out == {1: "b" * 60 + " > c\nt", 2: "x" * 200 + "\nt", 3: "t"}
