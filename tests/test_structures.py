"""Trees by doubling, ranks by cells, neighbours over ranges, blocked search, axes without gaps: against brute force."""

import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import lineage, quantiles, search, series, spine
from lectern.operators import tree as trees


def brute_closure(parents):
    out = set()
    for node in parents:
        at, depth = node, 0
        while at is not None:
            out.add((at, node, depth))
            at, depth = parents.get(at), depth + 1
    return out


def forest(seed, n=120):
    r = random.Random(seed)
    return {i: r.choice([None, *range(max(0, i - 8), i)]) if i else None for i in range(n)}


def nodes_of(spark, parents):
    return spark.createDataFrame(list(parents.items()), "id int, parent_id int")


def rows_of(df):
    return {tuple(r) for r in df.select("ancestor_id", "descendant_id", "depth").collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_closure_changes(spark, seed):
    parents = forest(seed)
    tree = lineage.written(trees.closure(nodes_of(spark, parents)))
    assert rows_of(tree) == brute_closure(parents) and tree.count() == len(brute_closure(parents))
    new = {1000: 5, 1001: 1000, 1002: 1001, 1003: None, 1004: 1003}
    assert rows_of(trees.inserted(tree, nodes_of(spark, new))) == brute_closure(parents | new)
    gone = {d for a, d, _ in brute_closure(parents) if a in (3, 40)}
    assert rows_of(trees.deleted(tree, spark.createDataFrame([(3,), (40,)], "id int"))) == brute_closure({k: v for k, v in parents.items() if k not in gone})
    moves = {119: None, 60: 2, 2: 100 if (100, 2) not in {(a, d) for a, d, _ in brute_closure(parents)} else None}
    want = parents | moves
    try:
        expected = brute_closure_or_circle(want)
    except RecursionError:
        with pytest.raises(trees.NotATree):
            rows_of(trees.moved(tree, nodes_of(spark, moves)))
    else:
        assert rows_of(trees.moved(tree, nodes_of(spark, moves))) == expected


def brute_closure_or_circle(parents):
    for node in parents:
        at, seen = node, set()
        while at is not None:
            if at in seen:
                raise RecursionError
            seen.add(at)
            at = parents.get(at)
    return brute_closure(parents)


def test_closure_refuses_what_is_no_tree(spark):
    with pytest.raises(trees.NotATree):
        trees.closure(nodes_of(spark, {1: 2, 2: 3, 3: 1, 4: None}))
    tree = trees.closure(nodes_of(spark, {1: None, 2: 1, 3: 2}))
    with pytest.raises(trees.NotATree):
        trees.inserted(tree, nodes_of(spark, {9: 77}))
    with pytest.raises(trees.NotATree):
        trees.moved(tree, nodes_of(spark, {1: 3}))
    assert trees.closure(nodes_of(spark, {1: None}).limit(0)).count() == 0


def test_deep_chain_takes_few_joins(spark, monkeypatch):
    joins, longer = [], trees._longer
    monkeypatch.setattr(trees, "_longer", lambda *a: (joins.append(1), longer(*a))[1])
    before = {k: spark.conf.get(k) for k in ("spark.sql.cteRecursionRowLimit",)}
    chain = spark.range(5000).selectExpr("cast(id AS int) AS id", "cast(CASE WHEN id > 0 THEN id - 1 END AS int) AS parent_id")
    out = trees.closure(chain).agg(F.count("*").alias("n"), F.max("depth").alias("deep"), F.sum("depth").alias("total")).first()
    assert (out.n, out.deep, out.total) == (5000 * 5001 // 2, 4999, sum(d * (5000 - d) for d in range(5000))) and len(joins) < 15
    assert before == {k: spark.conf.get(k) for k in before}


def stored(spark):
    """Bytes of the tables in the shared folder and of shuffle files."""
    tables = sum(f.stat().st_size for f in Path(lineage.shared_folder(spark).removeprefix("file:"), "lectern-tables").rglob("*.parquet"))
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return tables + sum(files.apply(i).length() for i in range(files.size()))


def test_closure_stores_no_pairs(spark):
    chains = spark.range(4000).selectExpr("id", "CASE WHEN id >= 2 THEN id - 2 END AS parent_id")
    before = stored(spark)
    tree = trees.closure(chains)
    out = tree.agg(F.count("*").alias("n"), F.max("depth").alias("deep"), F.sum("depth").alias("total")).first()
    assert (out.n, out.deep, out.total) == (2000 * 2001, 1999, 2 * sum(d * (2000 - d) for d in range(2000)))
    assert stored(spark) - before < out.n / 4  # 4 million pairs, of which even one byte each would be 4 MB


@pytest.mark.parametrize(("seed", "width"), [(3, 1), (4, 4), (5, 7), (6, 64)])
def test_closure_across_blocks_and_ranges(spark, monkeypatch, seed, width):
    """Many blocks, siblings dealt over ranges, deep and flat trees, parents without a row, a null id, ids as text."""
    monkeypatch.setattr(trees, "BLOCK", (width, width))
    r = random.Random(seed)
    parents = forest(seed) | {200 + i: 200 + i - 1 if i else None for i in range(60)} | {300 + i: 0 for i in range(60)} | {400 + i: 900 + i % 3 for i in range(9)}
    names = {i: f"{r.random()}" for i in [*parents, 900, 901, 902]} | {None: None}
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    kept = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        rows = [(names[i], names[p]) for i, p in parents.items()]
        r.shuffle(rows)
        tree = trees.closure(spark.createDataFrame([*rows, (None, names[0])], "id string, parent_id string"))
        found = sorted(map(repr, (tuple(x) for x in tree.collect())))
    finally:
        spark.conf.set(coalesce, kept)
    want = [(names[a], names[d], depth) for a, d, depth in brute_closure(parents)]
    assert found == sorted(map(repr, [*want, (None, None, 0)])) and tree.columns == ["ancestor_id", "descendant_id", "depth"]


def test_closure_of_repeated_ids_follows_each_path(spark):
    rows = [(1, None), (2, 1), (3, 1), (4, 2), (4, 3), (5, 4)]
    want, at = [], [(d, d, 0) for d, _ in rows]
    while at:  # as the SQL has it
        want += at
        at = [(p, d, depth + 1) for a, d, depth in at for i, p in rows if i == a and p is not None]
    assert sorted(tuple(r) for r in trees.closure(spark.createDataFrame(rows, "id int, parent_id int")).collect()) == sorted(want)


def nearest_rank(values, q):
    return sorted(values)[max(0, math.ceil(q * len(values)) - 1)]


def test_ranks_of_hot_keys(spark):
    r = random.Random(4)
    values = {
        "same": [7.0] * 3000, "spread": [r.uniform(-5, 5) for _ in range(4001)], "skewed": [r.random() ** 40 * 1e12 for _ in range(3000)], "wide": [r.choice([-1, 1]) * 10.0 ** r.randint(-300, 300) for _ in range(2500)],
        "ends": [float("inf"), float("-inf"), *range(2000)], "few": [1.0, 2.0, 10.0], "two": [1.0, 2.0] * 1200, "tiny": [5e-324 * r.randint(0, 3) for _ in range(2000)],
    }
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [(None, 3.0), ("nulls", None), ("few", None)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(5)
    for limit, few in ((1000, 10_000), (100, 10)):
        if few == 10:
            wanted = spark.createDataFrame([(k, "x", len(vs) // 3) for k, vs in values.items()], "k string, which string, rank long")
            out = {x.k: x.value for x in quantiles.by_rank(frame, "v", wanted, "k", few=few).collect()}
            assert out == {k: sorted(vs)[len(vs) // 3] for k, vs in values.items()}
        out = {x.k: x for x in quantiles.percentiles(frame, "v", "k", limit=limit).collect()}
        for k, vs in values.items():
            s = sorted(map(float, vs))
            assert out[k].p95 == nearest_rank(s, 0.95), k
            assert out[k].median == pytest.approx((s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2), k
        assert (out[None].median, out["nulls"].median, out["nulls"].n, out["few"].n) == (3.0, None, 1, 4)
    whole = quantiles.percentiles(frame.filter("k = 'spread'"), "v", limit=50).first()
    assert (whole.p95, whole.n) == (nearest_rank(values["spread"], 0.95), 4001)
    assert quantiles.percentiles(frame.limit(0), "v", "k").count() == 0


def test_previous_sample_over_ranges(spark):
    r = random.Random(6)
    rows = [("hot", i, r.random()) for i in range(500)] + [(f"k{i % 7}", i, float(i)) for i in range(50)] + [(None, 1, 1.0), (None, 2, 2.0), ("one", 5, 5.0)]
    frame = spark.createDataFrame(rows, "k string, ts long, v double").repartition(6)
    want, last = set(), {}
    for k, ts, v in sorted(rows, key=lambda x: (x[0] or "", x[1])):
        want.add((k, ts, v, last.get(k)))
        last[k] = v
    for ranges in (None, 1, 9, 40):
        out = series.with_previous(frame, ["k"], ["ts"], ["v"], ranges)
        assert {(x.k, x.ts, x.v, x.previous.v if x.previous else None) for x in out.collect()} == want
    assert series.with_previous(frame.limit(0), ["k"], ["ts"], ["v"]).count() == 0


def brute_increase(samples, begin, end):
    """PromQL's rules by hand: (begin, end], seconds."""
    inside = [(t, v) for t, v in samples if begin < t <= end and v == v]
    if len(inside) < 2 or inside[0][0] == inside[-1][0]:
        return None
    grown = inside[-1][1] - inside[0][1] + sum(a[1] for a, b in zip(inside, inside[1:], strict=False) if b[1] < a[1])
    span = inside[-1][0] - inside[0][0]
    mean = span / (len(inside) - 1)
    left, right = inside[0][0] - begin, end - inside[-1][0]
    left, right = (mean / 2 if left >= 1.1 * mean else left), (mean / 2 if right >= 1.1 * mean else right)
    if grown > 0 and inside[0][1] >= 0:
        left = min(left, span * inside[0][1] / grown)
    return grown * (span + left + right) / span


def test_counter_rates(spark):
    r = random.Random(8)
    samples, at, v = [], 1_700_000_000, 0.0
    for _ in range(300):
        at += r.choice([5, 15, 15, 15, 90])
        v = r.uniform(0, 3) if r.random() < 0.05 else v + r.randint(0, 9)
        samples.append((at, float("nan") if r.random() < 0.04 else v))
    frame = spark.createDataFrame([("a", *s) for s in samples] + [("b", samples[0][0], 1.0)], "k string, s long, value double").withColumn("ts", F.timestamp_seconds("s"))
    out = {(x.k, int(x.at.timestamp())): x for x in series.counter_rates(frame.select("k", "ts", "value"), "300 seconds", "60 seconds", "k").collect()}
    ends = {("a", e): brute_increase(samples, e - 300, e) for e in range(samples[0][0] // 60 * 60, samples[-1][0] + 400, 60)}
    want = {k: x for k, x in ends.items() if x is not None}
    assert set(out) == set(want) and all(out[k].increase == pytest.approx(want[k]) and out[k].rate == pytest.approx(want[k] / 300) for k in want)


@pytest.mark.parametrize("settings", [{}, {"query_bytes": 4000}])
def test_many_queries_at_once(spark, settings):
    g = np.random.default_rng(3)
    v = g.standard_normal((700, 16))
    v[100:400] = v[100]  # a vector that very many share
    v[5] = 0
    q = g.standard_normal((50 if settings else 1000, 16))
    q[3] = v[100]
    vectors = spark.createDataFrame([(i * 2, i, [float(x) for x in row]) for i, row in enumerate(v)] + [(9001, 1, [1.0]), (9002, 2, None)], "chunk_id long, document_id long, vector array<double>").repartition(5)
    queries = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(q)], "query_id long, vector array<double>")
    out = search.nearest_many(vectors, queries, 7, **settings).collect()
    norm = np.linalg.norm(v, axis=1)
    cosine = np.round((v @ q.T) / np.where(norm > 0, norm, 1)[:, None] / np.linalg.norm(q, axis=1), 9)
    want = {(j, i * 2, rank) for j in range(len(q)) for rank, i in enumerate(sorted((i for i in range(700) if norm[i] > 0), key=lambda i: (-cosine[i, j], i))[:7], 1)}
    assert {(x.query_id, x.chunk_id, x.rank_no) for x in out} == want and len(out) == 7 * len(q)
    assert search.nearest_many(vectors.limit(0), queries, 3).count() == 0 and search.nearest_many(vectors, queries.limit(0), 3).count() == 0


def test_axes_without_gaps(spark):
    r = random.Random(9)
    rows = [(k, 1_700_000_000 + s, r.random() < 0.8) for k in range(12) for s in sorted(r.sample(range(200), 120))]
    rows += [(50, 1_700_000_000 + s, True) for s in range(8)] + [(51, 1_700_000_000 + s, False) for s in range(8)]
    frame = spark.createDataFrame(rows, "k int, s long, ok boolean").withColumn("ts", F.timestamp_seconds("s"))
    axis = spine.dense(frame, "k")
    out = {x.k: x for x in spine.steady_from(axis, frame, "k", run=3).collect()}
    for k in {x[0] for x in rows}:
        mine = {s: ok for q, s, ok in rows if q == k}
        bad = max((s for s, ok in mine.items() if not ok), default=None)
        first, last = min(mine), max(mine)
        start = first if bad is None else bad + 1
        found = next((s for s in range(start, last - 1) if all(mine.get(s + i) for i in range(3))), None)
        assert (out[k].last_bad, out[k].steady_from) == (bad, found), k
        assert {(x.unit, x.ok) for x in axis.filter(F.col("k") == k).collect()} == {(s, bool(mine.get(s))) for s in range(first, last + 1)}
    confirmed = {x.k: x for x in spine.first_confirmed(frame.select("k", F.col("s").alias("ts"), "ok"), "k").collect()}
    for k in {x[0] for x in rows}:
        mine = sorted((s, ok) for q, s, ok in rows if q == k)
        at = next((i for i in range(len(mine) - 2) if all(ok for _, ok in mine[i : i + 3])), None)
        assert (k in confirmed) == (at is not None)
        if at is not None:
            assert (confirmed[k].reached_at, confirmed[k].confirmed_at, confirmed[k].not_before) == (mine[at][0], mine[at + 2][0], mine[at - 1][0] if at else None)


def test_uploads_by_hand(spark):
    from lectern.operators import uploads

    schema = "user_id long, request_key string, input_fingerprint string, state string, owner_token string, lease_expires_at timestamp_ntz, candidate_key string, candidate_at timestamp_ntz, cleanup_token string, cleanup_lease_at timestamp_ntz, document_id long"
    from datetime import datetime

    past, now, soon = datetime(2024, 1, 1), datetime(2024, 1, 2), datetime(2024, 1, 2, 0, 3)
    rows = [(1, "a", "f", "IN_PROGRESS", "o1", soon, None, None, None, None, None), (2, "b", "f", "IN_PROGRESS", "o2", past, "k2", past, None, None, None), (3, "c", "f", "COMPLETED", "o3", past, "k3", past, "t", soon, 7)]
    table, at = spark.createDataFrame(rows, schema), F.lit(now)
    state = lambda df: {r.request_key: r for r in df.collect()}
    asked = lambda *x, cols: spark.createDataFrame(list(x), f"user_id long, request_key string, {cols}")
    out = state(uploads.registered(table, asked((1, "a", "o1", "k1"), (2, "b", "o2", "k9"), cols="owner_token string, candidate_key string"), at))
    assert (out["a"].candidate_key, out["a"].done) == ("k1", True) and (out["b"].candidate_key, out["b"].done) == ("k2", False) and out["c"].done is None
    out = state(uploads.completed(table, asked((1, "a", "other", 5, True), (2, "b", "o2", 6, True), cols="owner_token string, document_id long, claimed boolean")))
    assert (out["a"].state, out["a"].done) == ("IN_PROGRESS", False) and (out["b"].state, out["b"].document_id, out["b"].candidate_key) == ("COMPLETED", 6, None)
    assert state(uploads.released(table, asked((1, "a", "o1"), cols="owner_token string"), at))["a"].lease_expires_at == now
    assert [r.request_key for r in uploads.cleanup_targets(table, at, 3600, 10).collect()] == ["b"]  # c is being cleaned
    taken = uploads.reserved(table, asked((2, "b", "k2", "n", "c2"), (3, "c", "k3", "n", "c3"), cols="candidate_key string, owner_token string, cleanup_token string"), at, 3600)
    out = state(taken)
    assert (out["b"].state, out["b"].owner_token, out["b"].done, out["c"].done) == ("CLEANING", "n", True, False)
    late = state(uploads.completed(taken, asked((2, "b", "o2", 6, False), cols="owner_token string, document_id long, claimed boolean")))
    assert late["b"].done is False  # the uploader before has lost its claim
    out = state(uploads.cleaned(taken, asked((2, "b", "c2", True), (3, "c", "c3", True), cols="cleanup_token string, removed boolean"), at))
    assert (out["b"].state, out["b"].candidate_key, out["b"].cleanup_token) == ("IN_PROGRESS", None, None) and out["c"].candidate_key == "k3"
    with pytest.raises(ValueError):
        uploads.cleanup_targets(table, at, 1, 101)


def test_hashes_encodings_and_sections_over_whole_tables(spark):
    """The three queries without SQL against brute force over their whole tables."""
    import hashlib
    import struct

    from lectern.plans import catalog, lifecycle

    sf = "/root/testdata/sf0.001"
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    out = {r.vec_id: r.vector_hash for r in catalog.QUERIES["vector_hashes"](spark, sf).collect()}
    assert out == {k: hashlib.sha256(struct.pack(f">{len(v)}f", *v)).hexdigest() for k, v in vectors.items()}
    texts = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = set()
    for d, r in texts.items():
        for k, at in enumerate(range(0, max(0, -(-(len(r.text) - 1000) // 800)) * 800 + 1, 800) if r.text else ()):
            v = lifecycle.hashed_encoder([r.text[at : at + 1000]])[0]
            want.add((d, k, "hashed-8", hashlib.sha256(struct.pack(">8f", *v)).hexdigest()))
    assert {tuple(r) for r in catalog.QUERIES["encoded_chunks"](spark, sf).select("document_id", "chunk_index", "model", "vector_hash").collect()} == want
    sections = {}
    for r in catalog.QUERIES["markdown_sections"](spark, sf).orderBy("document_id", "segment_no").collect():
        sections.setdefault(r.document_id, []).append(r)
    for d, r in texts.items():
        full = f"# {r.source}\n\n## {r.lang}\n{r.text}"
        assert "\n".join(s.text for s in sections[d]) == full and sections[d][0].text.startswith(f"# {r.source}")
        assert sections[d][0].title in (r.lang, r.source)


def test_chunks_of_whole_documents_and_of_segments_agree(spark):
    from lectern.operators import chunking

    r = random.Random(3)
    one = spark.createDataFrame([(i, 0, "x" * r.randint(0, 4000)) for i in range(40)], "document_id long, segment_no int, text string")
    assert {tuple(x) for x in chunking.chunks(one).collect()} == {tuple(x) for x in chunking.chunks(one, whole=True).collect()}
    rows = [(i, k, "y" * r.randint(0, 2500)) for i in range(12) for k in range(4)]
    out = chunking.chunks(spark.createDataFrame(rows, "document_id long, segment_no int, text string"), 700, 100)
    for d in range(12):
        at, want = 0, []
        for _, _, text in sorted(x for x in rows if x[0] == d and x[2]):
            want += [(at + s, at + min(len(text), s + 700)) for s in range(0, max(0, -(-(len(text) - 700) // 600)) * 600 + 1, 600)]
            at += len(text) + 1
        assert [(x.char_start, x.char_end) for x in out.filter(F.col("document_id") == d).orderBy("chunk_index").collect()] == want
        assert [x.chunk_index for x in out.filter(F.col("document_id") == d).orderBy("chunk_index").collect()] == list(range(len(want)))


def test_circuit_with_calls_under_way(spark):
    from lectern.operators import circuit

    rows = [
        # key, call, start, end, outcome
        ("a", 1, 0, 10, "FAILURE"), ("a", 2, 5, 90, "SUCCESS"), ("a", 3, 6, 20, "FAILURE"),  # two failures: open at 20 until 120
        ("a", 4, 50, 60, "SUCCESS"),  # refused
        ("a", 5, 120, 300, "FAILURE"),  # the probe; call 2's late success changed nothing
        ("a", 6, 130, 140, "SUCCESS"),  # refused while it probes
        ("a", 7, 300, 310, "SUCCESS"),  # refused: the probe's end comes first and opens until 400
        ("a", 8, 400, 410, "RELEASED"), ("a", 9, 410, 420, "OTHER_FAILURE"),  # a probe without result, then one whose failure isn't the provider's
        ("a", 10, 421, 430, "FAILURE"), ("a", 11, 431, 432, "SUCCESS"), ("a", 12, 433, 434, "FAILURE"), ("a", 13, 436, 437, "SUCCESS"),
        ("b", 14, 50, 50, "FAILURE"), ("b", 15, 50, 50, "FAILURE"), ("b", 16, 50, 50, "FAILURE"), (None, 17, 1, 2, "SUCCESS"),
    ]
    out = {r.call_id: (r.admitted, r.state, r.wait_ms) for r in circuit.replayed(spark.createDataFrame(rows, "key string, call_id long, at_ms long, end_ms long, outcome string"), 2, 100).collect()}
    want = {k: (True, "CLOSED", 0) for k in (1, 2, 3, 10, 11, 12, 13, 14, 15, 17)}
    want |= {4: (False, "OPEN", 70), 5: (True, "HALF_OPEN", 0), 6: (False, "HALF_OPEN", 1000), 7: (False, "OPEN", 100), 8: (True, "HALF_OPEN", 0), 9: (True, "HALF_OPEN", 0), 16: (False, "OPEN", 100)}
    assert out == want


@pytest.mark.parametrize(
    ("line", "fence", "heading"),
    [("# A #", None, (1, "A")), ("   ## b ##c", None, (2, "b ##c")), ("    # code", None, None), ("#no", None, None), ("####### x", None, None), ("#", None, (1, "")), ("```py", ("```", "py"), None), (" ~~~~", ("~~~~", ""), None), ("``", None, None), ("# x##", None, (1, "x##")), ("#\tx ## ", None, (1, "x"))],
)
def test_lines_of_markdown(line, fence, heading):
    from lectern.operators import chunking

    assert (chunking.fence_of(line), chunking.heading_of(line)) == (fence, heading)
