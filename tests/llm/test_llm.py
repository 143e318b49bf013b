import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import of_spark, of_sql
from pyspark.sql import functions as F

from lectern.llm import exact_dedup, line_dedup, mixing, near_dedup, packing, quality, queries, substring_dedup, token_counts, url_filter, warc
from lectern.llm.common import vocabulary

SF = "/root/testdata/sf0.001"
SPACE = r"[\x20\x09-\x0D]+"


def words(t):
    return [w for w in re.split(SPACE, t or "") if w]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    assert of_spark(queries.QUERIES[name](spark, SF)) == of_sql(queries.SQL[name], SF)


def test_exact_dedup(spark, docs, rows, nothing):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    want = {(r[0], max(groups[r[1] or ""]), len(groups[r[1] or ""]), r[0] == max(groups[r[1] or ""])) for r in rows}
    for settings in ({}, {"max_filter_bytes": 0}, {"bits_a_row": 1}):
        out = exact_dedup.exact_duplicates(spark, docs, **settings).collect()
        assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in out} == want and len(out) == len(rows)
    assert exact_dedup.exact_duplicates(spark, nothing).count() == 0
    twice = spark.createDataFrame([(1, "x"), (1, "x"), (None, "x"), (None, None)], "doc_id long, text string")
    out = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(spark, twice).collect()}
    assert out == {(1, 1, 3, True), (None, 1, 3, False), (None, None, 1, True)}


def test_filter_lets_unique_rows_pass(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, F.col("id")).otherwise(F.col("id") % 10).cast("string").alias("k"))
    tested = exact_dedup.possibly_repeated(rows, "k", 5000)
    assert tested.filter("NOT maybe").groupBy("k").count().filter("count > 1").count() == 0
    assert tested.filter("maybe").count() < 1500


def brute_quality(t):
    w = words(t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs, rows, nothing):
    out = {r.row.doc_id: r for r in quality.quality(docs, "doc_id", "kept").collect()}
    for r in rows:
        q = out[r[0]]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == brute_quality(r[1]), r
        assert q.base_failed == (q.n_words < 10 or 100 * q.n_repeat_words > 20 * q.n_words) and not (q.base_failed and q.kept) and q.row.kept == "x"
    assert quality.quality(nothing, "doc_id").count() == 0


def test_divergent_text_is_rejected(spark):
    prose = "the river of the north and to the sea in a boat that is for on with at from are or this " * 1
    normal = [(i, " ".join([prose, f"place{i} name{i * 7} thing{i * 3} walk stone light green house"] * 1) + f" words{i} more{i} end{i} of the story and so on it goes to town", "en") for i in range(60)]
    odd = [(100, " ".join(f"ZX{i * i}QW!!" for i in range(60)), "en"), (101, "X1!! Y2!!", "en")]
    out = {r.row.doc_id: r.kept for r in quality.quality(spark.createDataFrame(normal + odd, "doc_id long, text string, lang string"), "doc_id").collect()}
    assert all(out[i] for i in range(60)) and not out[100]


def test_urls(spark):
    pages = [(1, "http://A.example.NET/en/x?q#f"), (2, "https://b.net"), (3, "https://b.net/"), (4, None), (5, "no scheme"), (6, "x://www.org/fr/"), (7, "x://org/fr"), (8, "http://example.com/de/a"), (9, "http://notexample.com/de/a"), (9, "http://net/"), (10, "http:///p")]
    frame = spark.createDataFrame(pages, "page_id long, url string").withColumn("rule", F.lit("clash"))
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    out = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in url_filter.judge_urls(spark, frame, rules).collect())
    assert out == [
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "b.net", "", "", "allow"), (3, "b.net", "/", "net/", "block"), (4, "", "", "", "allow"), (5, "", "", "", "allow"),
        (6, "www.org", "/fr/", "org/fr/", "allow"), (7, "org", "/fr", "", "allow"), (8, "example.com", "/de/a", "example.com/de/", "block"), (9, "net", "/", "net/", "block"), (9, "notexample.com", "/de/a", "", "allow"), (10, "", "/p", "", "allow"),
    ]
    assert {r.verdict for r in url_filter.judge_urls(spark, frame, rules.limit(0)).collect()} == {"allow"}
    assert url_filter.judge_urls(spark, frame.limit(0), rules).count() == 0


def test_mix(spark, docs, rows, nothing):
    plan = mixing.Mix(spark, docs, block_words=200, shard_blocks=4)
    out = plan.drawn(plan.placed).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(sizes)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        target |= {s: 3.0 * sizes[s] for s in over} if over else {s: weight[s] * level for s in free}
        free = free - over if over else set()
    by_id, taken = {r[0]: r for r in rows}, Counter()
    for r in out:
        source = by_id[r.doc_id][3]
        assert r.size == len(words(by_id[r.doc_id][1])) and len(r.draws) <= 3
        assert r.target == pytest.approx(target[source]) and r.source_size == sizes[source]
        taken[source] += r.size * len(r.draws)
    longest = {s: max(len(words(r[1])) for r in rows if r[3] == s) for s in sizes}
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in sizes)
    again = mixing.Mix(spark, docs.repartition(5), block_words=200, shard_blocks=4)
    key = lambda x: sorted((r.doc_id, tuple(r.draws)) for r in x)
    assert key(again.drawn(again.placed).collect()) == key(out)
    draws = plan.blocks.select(F.explode("draws").alias("d")).groupBy("d.shard").count().collect()
    quotas = {r.shard: r.n for r in plan.shards.groupBy("shard").agg(F.sum("quota").alias("n")).collect()}
    assert {r["shard"]: r["count"] for r in draws} == quotas and max(quotas.values()) - min(quotas.values()) <= 1 and len(quotas) > 2
    mixed = mixing.mix(spark, docs, block_words=200, shard_blocks=4)
    assert mixed.columns == docs.columns and mixed.count() == sum(len(r.draws) for r in out)
    assert mixing.mix(spark, nothing).count() == 0


def test_splitting_tree_keeps_quotas(spark):
    quotas = spark.createDataFrame([("a", 5000), ("b", 3000), ("c", 7), ("d", 0)], "source_key string, quota long")
    out = mixing.splitting_tree(quotas, 5)
    assert {tuple(r) for r in out.groupBy("source_key").agg(F.sum("quota")).collect()} == {("a", 5000), ("b", 3000), ("c", 7)}
    sizes = [r.n for r in out.groupBy("shard").agg(F.sum("quota").alias("n")).collect()]
    assert len(sizes) == 32 and max(sizes) - min(sizes) <= 1
    shares = [r.quota / 250.2 for r in out.filter("source_key = 'a'").collect()]
    assert 0.5 < min(shares) and max(shares) < 0.75 and len(set(shares)) > 5


def test_token_counts(docs, rows, nothing):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    counter = token_counts.Counter(vocabulary("byte_bpe_50k.json"))
    odd = ["<|endoftext|> a<|endoftext|>", "日本語 text", "a\u00a0b \u2028 c", "don't  we'LL\n\n\n x  ", "👍🏽 é e\u0301", "\x1c\x85 x", "  ", "x" * 300, "'s's"]
    for t in [*odd, *(r[1] or "" for r in rows)]:
        assert counter.count(t) == len(whole.encode(t, add_special_tokens=False)), t
    out = {r.doc_id: r for r in token_counts.token_counts(docs, "byte_bpe_50k.json").collect()}
    assert all(out[r[0]].n_bytes == len((r[1] or "").encode()) and out[r[0]].n_tokens == len(whole.encode(r[1] or "", add_special_tokens=False)) for r in rows)
    assert any(r.over_limit for r in out.values()) and token_counts.token_counts(nothing, "byte_bpe_50k.json").count() == 0


def test_character_classes_are_proven():
    """Every code point that the shortcuts take is classed alike by the pattern module and by the library."""
    import regex
    from tokenizers import Tokenizer, pre_tokenizers

    split, pattern, unproven = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True), regex.compile(token_counts.PATTERN), regex.compile(token_counts.UNPROVEN)
    for c in map(chr, [*range(0x530), *range(0x2000, 0x20D0)]):
        for t in (c, f"a{c}", f"{c}a", f"1{c}1", f" {c}{c} b", f"{c} "):
            assert unproven.search(c) or [x[1] for x in split.pre_tokenize_str(t)] == [m.span() for m in pattern.finditer(t)], hex(ord(c))
    coder, whole, unproven = packing.Encoder(vocabulary("word_bpe_49k.json")), Tokenizer.from_file(vocabulary("word_bpe_49k.json")), regex.compile(packing.UNPROVEN)
    for c in map(chr, [*range(0x250), *range(0x2010, 0x20C0)]):
        for t in (c, f"a{c}b", f"1{c}2", f"!{c}'s", f"'{c}ll x"):
            assert unproven.search(c) or np.frombuffer(coder.encode(t), coder.dtype).tolist() == whole.encode(t, add_special_tokens=False).ids, hex(ord(c))


def test_hilbert_curve_is_continuous():
    points = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    place = packing.hilbert(points, 3)
    assert sorted(place) == list(range(512))
    assert (np.abs(np.diff(points[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("settings", [{}, {"range_tokens": 500, "length": 64}])
def test_packing(spark, docs, rows, nothing, settings):
    from tokenizers import Tokenizer

    whole, length = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), settings.get("length", 2048)
    want = {r[0]: whole.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in rows}
    out = packing.pack(spark, docs, **settings).withColumn("crc", F.crc32("ids")).collect()
    parts = defaultdict(list)
    for r in out:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == want[r.doc_id][r.start : r.start + r.length] and r.crc == zlib.crc32(r.ids) and r.doc_tokens == len(want[r.doc_id])
        parts[r.doc_id].append((r.start, r.length))
    assert all(sum(n for _, n in p) == len(want[d]) and len({s for s, _ in p}) == len(p) for d, p in parts.items()) and set(parts) == set(want)
    at = 0
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * length + r.offset == at and r.offset + r.length <= length
        at += r.length
    assert packing.pack(spark, nothing).count() == 0


def classes(texts, n, percent):
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                if a < b and root[a] != root[b] and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    low = min(root[a], root[b])
                    old = {root[a], root[b]}
                    root = {d: low if r in old else r for d, r in root.items()}
                    changed = True
    return {d: (len(sets[d]), root[d]) for d in texts}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (2, 30), (1, 100)])
def test_jaccard_classes(spark, docs, rows, n, percent):
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.jaccard_classes(spark, docs, n, percent).collect()}
    assert out == classes({r[0]: r[1] for r in rows}, n, percent)


def test_jaccard_edge_cases(spark, nothing):
    assert near_dedup.jaccard_classes(spark, nothing).count() == 0
    few = spark.createDataFrame([(1, "A b"), (2, "a B"), (None, "a b"), (3, None), (4, None), (2, "a b")], "doc_id long, text string")
    out = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in near_dedup.jaccard_classes(spark, few).collect())
    assert out == [(-1, 1, 1), (1, 1, 1), (2, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4)]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    assert {(r.doc, r.root) for r in near_dedup.components(spark, links).collect()} == {(i, 0) for i in range(1, 41)} | {(101, 100)}


def test_line_dedup(spark, docs, rows, nothing):
    run, seen, want = 3, set(), {}
    for r in rows:
        lines = (r[1] or "").split("\n")
        solid = [k for k, x in enumerate(lines) if words(x)]
        gone = set()
        for i in range(len(solid) - run + 1):
            window = tuple(lines[k] for k in solid[i : i + run])
            if window in seen:
                gone |= set(solid[i : i + run])
            seen.add(window)
        want[r[0]] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(solid), len(gone))
    out = line_dedup.dedup_lines(spark, docs, run).collect()
    assert {r.doc_id: (r.text, r.n_lines, sum(x["count"] for x in r.removed)) for r in out} == want
    assert any(n for _, _, n in want.values()) and line_dedup.dedup_lines(spark, nothing).count() == 0


def test_long_lines_are_runs_of_their_own(spark):
    long_, half, other = " ".join(f"w{i}" for i in range(50)), " ".join(f"h{i}" for i in range(25)), " ".join(f"o{i}" for i in range(25))
    texts = [long_, f"{half}\n{other}", long_, f"start\n\n{half}\n\n{other}\nend", f"x\n{long_}\n{long_}", f"{half}\nshort", f"{half}\nshort"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: (r.text, r.n_lines, [tuple(x) for x in r.removed]) for r in line_dedup.dedup_lines(spark, frame, words=50).collect()}
    assert out == {
        0: (long_, 1, []), 1: (texts[1], 2, []), 2: ("", 1, [(0, 1)]), 3: ("start\n\n\nend", 4, [(1, 2)]), 4: ("x", 3, [(1, 2)]), 5: (texts[5], 2, []), 6: (texts[6], 2, []),
    }


@pytest.mark.parametrize(("length", "gram"), [(100, 40), (40, 16), (20, 9)])
def test_substring_dedup(spark, docs, rows, length, gram):
    seen, want = set(), {}
    for r in rows:
        data = (r[1] or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        want[r[0]] = (len(data), bytes(c for c, g in zip(data, gone, strict=True) if not g), sum(gone))
    out = substring_dedup.dedup_substrings(spark, docs, length, gram).collect()
    assert {r.doc_id: (r.n_bytes, bytes(r.data), sum(x["n"] for x in r.removed)) for r in out} == want
    assert any(n for _, _, n in want.values())


def test_substring_edge_cases(spark, nothing):
    assert substring_dedup.dedup_substrings(spark, nothing).count() == 0
    t = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(150))
    out = sorted((r.doc_id or -1, len(r.data)) for r in substring_dedup.dedup_substrings(spark, spark.createDataFrame([(5, t), (None, t), (2, "x" + t + t), (9, None), (7, "aaa" * 100)], "doc_id long, text string")).collect())
    assert out == [(-1, 0), (2, 151), (5, 0), (7, 1), (9, 0)]


def cut_by_hand(texts, length=100):
    """Bytes that stay of each text, by a look at every window."""
    seen, left = set(), []
    for data in texts:
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        left.append(bytes(c for c, g in zip(data, gone, strict=True) if not g))
    return left


@pytest.mark.parametrize("hot", [1, 3, 32])
def test_substring_dedup_of_a_sample_in_many_segments(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    r = random.Random(5)
    say = lambda k: "".join(r.choice("abcdefgh ") for _ in range(k))
    passage, ends = say(70), [say(60) for _ in range(6)]
    texts = [f"{say(r.randint(0, 90))}{passage}{r.choice(ends)[: r.randint(0, 60)]}" for _ in range(150)] + [f"{passage}{e}" for e in ends] * 2 + ["", passage, say(3000) + passage + ends[0]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartitionByRange(3, F.when(F.col("doc_id") < 140, 0).otherwise(F.col("doc_id")))
    out = {r.doc_id: bytes(r.data) for r in substring_dedup.dedup_substrings(spark, frame).collect()}
    want = cut_by_hand([t.encode() for t in texts])
    assert out == dict(enumerate(want)) and sum(map(len, want)) < sum(map(len, texts))


def test_substring_dedup_deals_out_little_where_nothing_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "bounded", lambda df, *_: df, raising=False)  # as for tables beyond its bound
    r = random.Random(6)
    say = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(k))
    passages = [say(150) for _ in range(200)]
    texts = ["".join([say(300), r.choice(passages), say(500), r.choice(passages), say(200)]) for _ in range(1500)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).cache()
    frame.count()
    dealt = lambda: spark._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = dealt()
        out = {r.doc_id: bytes(r.data) for r in substring_dedup.dedup_substrings(spark, frame).collect()}
        assert dealt() - before < 5 * sum(map(len, texts))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert out == dict(enumerate(cut_by_hand([t.encode() for t in texts])))


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", '<html lang="en"><head><title>T &amp; x</title></head><body><p>Hi <b>you</b></p><script>no()</script><a href="b">c</a></body></html>'), (2, None, None), (2, None, None), (3, "http://é/", "plain <")], "page_id long, url string, html string")
    out = warc.derive(warc.responses(pages)).orderBy("page_id", "record_type").collect()
    assert len(out) == 8
    text, meta = out[0], out[1]
    assert text.block.decode() == "Hi you\nc" and (text.record_type, meta.record_type) == ("conversion", "metadata") and text.refers_to == meta.refers_to == warc.record_id("1|http://a/")
    fields = dict(x.split(": ", 1) for x in meta.block.decode().strip().split("\r\n"))
    assert (fields["title"], fields["language"], fields["links"], fields["http-status"]) == ("T & x", "en", "1", "HTTP/1.1 200 OK") and fields["source-payload-digest"] == meta.payload_digest == text.payload_digest
    assert all(r.block_digest == warc.digest(bytes(r.block)) for r in out) and len({r.record_id for r in out}) == 6
    import gzip

    (tmp_path / "x.warc.gz").write_bytes(b"".join(gzip.compress(warc.serialised(r.asDict())) for r in out))
    back = warc.read_warc(spark, str(tmp_path / "x.warc.gz")).collect()
    assert sorted((r.record_id, bytes(r.block), r.refers_to, r.target_uri or "") for r in back) == sorted((r.record_id, bytes(r.block), r.refers_to, r.target_uri or "") for r in out)
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def test_pipeline(spark, docs, rows):
    import corpus_pipeline as pipeline

    docs = docs.select("doc_id", "text", "lang", "source", "n_chars", "block")
    good = pipeline.good_quality(spark, docs, "")
    kept = {r.row.doc_id for r in quality.quality(docs, "doc_id").filter("kept").collect()}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == kept
    texts = {r.doc_id: r.text for r in good.collect()}
    distinct = pipeline.distinct_texts(spark, good, "")
    last = {t: d for d, t in sorted(texts.items())}
    assert {r.doc_id for r in distinct.collect()} == set(last.values())
    single = pipeline.distinct_contents(spark, distinct, "")
    found = classes({d: t for t, d in last.items()}, 5, 80)
    assert {r.doc_id for r in single.collect()} == {d for d, (_, root) in found.items() if d == root}
    mixed = pipeline.mixed_sources(spark, single, "")
    assert mixed.columns == docs.columns and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 3
    pieces = pipeline.packed(spark, mixed, "")
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in mixed.collect()}
    assert [len(s) for s in pipeline.STAGES] == [2] * 5


def test_pipeline_judges_rows_not_ids(spark):
    import corpus_pipeline as pipeline

    long_ = " ".join(f"w{i}" for i in range(60))
    rows = [(5, "A"), (5, "B"), (7, "A"), (None, "A"), (None, "C"), (None, "D"), (3, "E"), (3, "E"), (None, long_), (9, long_ + " x"), (None, long_)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda d: sorted((r.doc_id or -1, r.text) for r in d.collect())
    distinct = pipeline.distinct_texts(spark, frame, "")
    assert distinct.columns == frame.columns
    assert key(distinct) == sorted([(5, "B"), (7, "A"), (-1, "C"), (-1, "D"), (3, "E"), (-1, long_), (9, long_ + " x")])
    single = pipeline.distinct_contents(spark, frame, "")
    assert key(single) == sorted([(5, "A"), (5, "B"), (-1, "C"), (-1, "D"), (3, "E"), (9, long_ + " x")])
    one_null = spark.createDataFrame([(1, long_), (None, long_ + " x")], "doc_id long, text string")
    assert key(pipeline.distinct_contents(spark, one_null, "")) == [(1, long_)]


def test_rows_of_one_id_keep_their_own_bytes_and_lines(spark):
    t, u = ("".join(chr(97 + (i * i * k + i // 7) % 26) for i in range(150)) for k in (1, 3))
    rows = [(2, t), (None, u + t), (None, "short"), (5, t), (5, u[:90] * 2), (None, None)]
    out = sorted((r.doc_id or -1, bytes(r.data).decode()) for r in substring_dedup.dedup_substrings(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == sorted([(2, t), (-1, u), (-1, "short"), (5, ""), (5, u[:90] * 2), (-1, "")])
    rows = [(2, "a\nb\nc"), (None, "x\na\nb\nc"), (None, "p\nq\nr\ns"), (5, "a\nb\nc"), (5, "k\nl\nm")]
    out = sorted((r.doc_id or -1, r.text) for r in line_dedup.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == sorted([(2, "a\nb\nc"), (-1, "x"), (-1, "p\nq\nr\ns"), (5, ""), (5, "k\nl\nm")])


def read_records(data):
    """An own reader: cuts records at their lengths, without the operator's code."""
    out, at = [], 0
    while at < len(data):
        head, _, rest = data[at:].partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")[1:]
        n = int(next(x for x in lines if x.lower().startswith("content-length:")).split(":")[1])
        out.append(([tuple(y.strip() for y in x.split(":", 1)) for x in lines], rest[:n]))
        at += len(head) + 4 + n + 4
    return out


def test_warc_keeps_all_headers_and_decodes_bodies(spark, tmp_path):
    import gzip

    def record(kind, http, extra=""):
        return (f"WARC/1.0\r\nWARC-Type: {kind}\r\nwarc-record-id: <urn:a:{len(http)}>\r\nWARC-Target-URI: http://x/\r\nWARC-IP-Address: 1.2.3.4\r\n{extra}Content-Length: {len(http)}\r\n\r\n").encode() + http + b"\r\n\r\n"

    zipped = gzip.compress(b"<p>zip</p>")
    pages = [
        b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nX: one\r\n two\r\nSet-Cookie: b=2\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n2;x=y\r\nde\r\n0\r\n\r\n",
        b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + zipped,
        b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\nnot zipped",
        b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nno chunks here",
        b"no http at all",
        b"HTTP/1.1 200 OK\r\n\r\n<head><title>t</title></head>" + b"<p>long text</p>" * 200_000,
    ]
    bad = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:bad>\r\nContent-Length: many\r\n\r\nlost\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(bad + b"".join(record("response", p) for p in pages) + record("request", b"GET /"))
    read = warc.read_warc(spark, str(tmp_path / "a.warc"))
    assert read.count() == 8 and {r.extra for r in read.filter("record_id <> '<urn:bad>'").collect()} == {"WARC-IP-Address: 1.2.3.4"}
    out = warc.derive(read).collect()
    text = {r.refers_to: bytes(r.block).decode() for r in out if r.record_type == "conversion"}
    want = ["abcde", "zip", "not zipped", "no chunks here", "no http at all", "\n".join(["long text"] * 200_000)]
    assert [text[f"<urn:a:{len(p)}>"] for p in pages] == want and text["<urn:bad>"] == ""
    meta = next(bytes(r.block).decode() for r in out if r.record_type == "metadata" and r.refers_to == f"<urn:a:{len(pages[0])}>")
    lines = meta.split("\r\n")
    assert [x for x in lines if "cookie" in x] == ["http-header-set-cookie: a=1", "http-header-set-cookie: b=2"] and "http-header-x: one two" in lines and "source-header-warc-ip-address: 1.2.3.4" in lines
    wire = b"".join(warc.serialised(r.asDict() | {"block": bytes(r.block)}) for r in read.collect())
    again = read_records(wire)
    assert [b for _, b in again][1:7] == pages and all(("WARC-IP-Address", "1.2.3.4") in h for h, _ in again[1:])


def test_large_filters_go_slice_by_slice(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") < 29_000, F.col("id")).otherwise(F.col("id") % 500).cast("string").alias("k"), F.col("id").alias("doc_id"))
    tested = exact_dedup.possibly_repeated(rows, "k", 30_000, max_filter_bytes=3 * 4200)
    assert tested.count() == 30_000 and tested.filter("NOT maybe").groupBy("k").count().filter("count > 1").count() == 0
    assert tested.filter("maybe").count() < 6000 and "Exchange hashpartitioning(k" not in tested._jdf.queryExecution().toString()
    known = spark.range(100).select(F.col("id").cast("string").alias("k"))
    kept = exact_dedup.possibly_in(rows, "k", known, 100)
    assert kept.filter("cast(k AS long) < 100").count() == rows.filter("cast(k AS long) < 100").count() and kept.count() < 2000


def test_shards_follow_the_tree(spark, docs):
    plan = mixing.Mix(spark, docs, block_words=200, shard_blocks=4)
    out = mixing.mixed_shards(spark, docs, block_words=200, shard_blocks=4).collect()
    want = Counter((r.doc_id, d["copy"], d["shard"]) for r in plan.drawn(plan.placed).collect() for d in r.draws)
    assert Counter((r.doc_id, r.copy, r.shard) for r in out) == want
    # by hand: each source's blocks in the order of their hashes, pass after pass, dealt to shards by the leaves' quotas
    leaves, blocks = defaultdict(list), defaultdict(list)
    for r in plan.shards.orderBy("shard").collect():
        leaves[r.source_key] += [r.shard] * r.quota
    turn = lambda s, b: int(hashlib.md5(f"mix turn|{s}|{b}".encode()).hexdigest()[:15], 16)
    draws = {(r.source_key, r.block): [tuple(d) for d in r.draws] for r in plan.blocks.collect()}
    for s, b in {(r.source_key, r.block) for r in plan.placed.select("source_key", "block").collect()}:
        blocks[s].append((turn(s, b), b))
    for s, order in blocks.items():
        dealt = [(copy, b) for copy in (1, 2, 3, 4) for _, b in sorted(order) if any(c == copy for c, _ in draws.get((s, b), []))]
        assert {(c, b): leaves[s][i] for i, (c, b) in enumerate(dealt)} == {(c, b): shard for (s2, b), d in draws.items() if s2 == s for c, shard in d}
    places = defaultdict(list)
    for r in out:
        places[r.shard].append(r.place)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_long_hosts(spark):
    host = ".".join(["a"] * 20_001)
    pages = spark.createDataFrame([(1, f"http://{host}.example.com/de/x"), (2, f"http://{host}.net/"), (None, "http://org/fr/")], "page_id long, url string")
    out = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(spark, pages, url_filter.contract_rules(spark)).collect()}
    assert out == {1: ("example.com/de/", "block"), 2: ("net/", "block"), None: ("org/fr/", "allow")}


def test_near_copies_make_few_pairs(spark, monkeypatch):
    r = np.random.default_rng(1)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(1000):
        words_ = list(base)
        for k in r.choice(120, 3, replace=False):
            words_[k] = f"x{i}_{k}"
        texts.append(" ".join(words_))
    seen, verify = [], near_dedup.verified
    monkeypatch.setattr(near_dedup, "verified", lambda spark, pairs, *rest: (seen.append(pairs.count()), verify(spark, pairs, *rest))[1])
    frame = spark.createDataFrame(list(enumerate([*texts, " ".join(base), "something else entirely"])), "doc_id long, text string")
    out = {x.doc_id: x.component_id for x in near_dedup.jaccard_classes(spark, frame, 3, 80).collect()}
    sets = [{tuple(t.split()[i : i + 3]) for i in range(118)} for t in [*texts, " ".join(base)]]
    linked = [i for i in range(1000) if 100 * len(sets[i] & sets[1000]) >= 80 * len(sets[i] | sets[1000])]
    assert len(linked) > 900 and len({out[i] for i in linked}) == 1 and out[1001] == 1001
    assert sum(seen) < 12 * len(texts)


def test_links_of_rows_without_ids(spark):
    long_ = " ".join(f"w{i}" for i in range(80))
    rows = [(5, long_), (None, long_ + " x"), (None, "a b c d e f"), (7, "q r s t u"), (7, long_ + " y"), (3, None)]
    out = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in near_dedup.jaccard_classes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == [(-1, 2, -1), (-1, 77, 5), (3, 0, 3), (5, 76, 5), (7, 1, 7), (7, 77, 5)]


def test_pipeline_of_nothing_and_of_odd_rows(spark, nothing, tmp_path):
    import corpus_pipeline as pipeline

    docs = nothing.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() == 0
    assert pipeline.packed(spark, docs, "").count() == 0
    odd = [(None, "one text of some words " * 3, "en", None), (None, None, None, "a"), (4, "other", "de", "a"), (4, "other", "de", "a")]
    spark.createDataFrame(odd, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).withColumn("gone", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_pipeline_run_equals_its_stages(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.row.doc_id for r in quality.quality(docs, "doc_id").filter("kept").collect()}
    last = {t: d for d, t in sorted(texts.items()) if d in kept}
    single = {d for d, (_, root) in classes({d: t for t, d in last.items()}, 5, 80).items() if d == root}
    size = {d: len(words(texts[d])) for d in single}
    out = pipeline.run(spark, SF).collect()
    times = Counter(r.doc_id for r in out if r.start == 0)
    assert set(times) <= single and max(times.values()) <= 3
    source = {r.doc_id: r.source for r in docs.collect()}
    total = sum(size.values())
    assert abs(sum(size[d] * n for d, n in times.items()) - total) <= len(set(source.values())) * max(size.values())
