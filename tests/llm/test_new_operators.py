"""Importance resampling, periodic runs and token files against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import periodic_runs, resampling, token_files
from lectern.llm.common import vocabulary

TARGET = [("of the and to in", 1), ("abcde edcba of", 2), (None, 3), ("", 4), ("The THE é", 5)]


def brute_resampling(rows, target, max_n, buckets, min_words, percent):
    def runs(text):
        words = re.findall("[0-9a-z\u0080-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        return len(words), [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]

    of = lambda texts: Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in runs(t)[1])
    s, t = of(r[1] for r in rows), of(x[0] for x in target)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = {}
    for r in rows:
        n, found = runs(r[1])
        weight = sum(gain(zlib.crc32(f.encode()) % buckets) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{r[0]}".encode()).hexdigest()[:8], 16)
        out[r[0]] = [n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))]
    order = sorted((d for d, x in out.items() if x[0] >= min_words), key=lambda d: (-out[d][3], d))
    rank = {d: k + 1 for k, d in enumerate(order[: percent * len(order) // 100])}
    return {(d, *x, rank.get(d)) for d, x in out.items()}


@pytest.mark.parametrize("settings", [{}, {"max_n": 2, "buckets": 50, "percent": 60, "min_words": 3}, {"limit": 0}, {"limit": 4000, "percent": 100}, {"percent": 0}])
def test_importance_resampling(spark, docs, rows, settings):
    target = spark.createDataFrame(TARGET, "text string, s int")
    want = brute_resampling(rows, TARGET, *(settings.get(k, v) for k, v in {"max_n": 1, "buckets": 10_000, "min_words": 20, "percent": 10}.items()))
    out = resampling.importance_resample(spark, docs, target, **settings).collect()
    assert {tuple(r) for r in out} == want and len(out) == len(rows)
    assert settings.get("percent") == 0 or any(r.rank for r in out)


def test_importance_resampling_of_odd_rows(spark, nothing):
    target = spark.createDataFrame(TARGET, "text string, s int")
    assert resampling.importance_resample(spark, nothing, target).count() == 0
    text = " ".join(f"w{i}" for i in range(30))
    odd = [(5, text), (5, text), (None, text), (None, None), (7, text.upper()), (8, "-- !"), (9, "x " * 100_000)]
    frame = spark.createDataFrame([(*r, 1.0, "rank") for r in odd], "doc_id long, text string, weight double, score string")
    out = resampling.importance_resample(spark, frame, target.limit(0), percent=100).collect()
    assert Counter((r.doc_id, r.n_words) for r in out) == Counter([(5, 30), (5, 30), (None, 30), (None, 0), (7, 30), (8, 0), (9, 100_000)])
    assert sorted(r["rank"] for r in out if r["rank"]) == [1, 2, 3, 4, 5] and {r.weight for r in out if r.doc_id in (5, 7)} == {next(r.weight for r in out if r.doc_id == 7)}
    ranked = sorted((r for r in out if r["rank"]), key=lambda r: r["rank"])
    assert [r.score for r in ranked] == sorted((r.score for r in ranked), reverse=True)


def test_many_ties_are_ranked_over_ranges(spark):
    frame = spark.range(3000).select(F.lit(4).cast("long").alias("doc_id"), F.lit("a b c").alias("text"))
    out = resampling.importance_resample(spark, frame, frame.limit(1), min_words=1, percent=50)
    assert sorted(r["rank"] for r in out.filter("rank IS NOT NULL").collect()) == list(range(1, 1501)) and out.count() == 3000


def brute_runs(words, min_length=12, min_exp=2):
    """Each lag place by place; of one stretch the smallest period."""
    found = {}
    for q in range(1, len(words) // min_exp + 1):
        i = q
        while i < len(words):
            j = i
            while j < len(words) and words[j] == words[j - q]:
                j += 1
            if j - i + q >= max(min_length, min_exp * q):
                found.setdefault((i - q, j - i + q), q)
            i = max(j, i) + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def made_texts(seed):
    r = random.Random(seed)
    texts = []
    for i in range(60):
        words = [r.choice("abcdefgh") if i % 3 else r.choice("ab") for _ in range(r.randint(0, 150))]
        if i % 2 and words:
            a, p = r.randrange(len(words)), r.randint(1, 40)
            words[a:] = [words[a + k % min(p, len(words) - a)] for k in range(len(words) - a)]
        texts.append(r.choice([" ", "\n", " \t "]).join(words) + r.choice(["", " "]))
    return [*texts, "x " * 400, "x y " * 300 + "z", " ".join(map(str, range(500))) + " " + " ".join(map(str, range(500))), "é é " * 13, None, "", " \n"]


@pytest.mark.parametrize("settings", [{}, {"min_length": 6, "min_exp": 3}, {"long_words": 20, "range_work": 3000}, {"min_length": 1, "long_words": 1, "range_work": 500}])
def test_periodic_runs(spark, settings):
    texts = made_texts(len(settings))
    frame = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, runs int").repartition(3)
    out = {r.doc_id: r for r in periodic_runs.periodic_runs(spark, frame, **settings).collect()}
    assert set(out) == set(range(len(texts)))
    for k, t in enumerate(texts):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
        runs = brute_runs(words, settings.get("min_length", 12), settings.get("min_exp", 2))
        assert [(r.start, r.length, r.period) for r in out[k].runs] == runs, (k, t)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert out[k].text == " ".join(w for i, w in enumerate(words) if i not in gone) and out[k].n_words == len(words)
    assert any(len(r.runs) > 1 for r in out.values())


def test_periodic_runs_of_odd_rows(spark, nothing):
    assert periodic_runs.periodic_runs(spark, nothing).count() == 0
    rows = [(1, "a b " * 9), (1, "c " * 20), (None, "a b " * 9), (None, None)]
    for settings in ({}, {"long_words": 1, "range_work": 300}):
        out = periodic_runs.periodic_runs(spark, spark.createDataFrame(rows, "doc_id long, text string"), **settings).collect()
        assert sorted((r.doc_id or -1, r.text, len(r.runs)) for r in out) == [(-1, "", 0), (-1, "a b", 1), (1, "a b", 1), (1, "c", 1)]


def test_long_texts_are_dealt_out_by_lags(spark):
    r = random.Random(5)
    words = [f"w{r.randrange(3000)}" for _ in range(40_000)]
    words[20_000:38_000] = [words[20_000 + k % 7001] for k in range(18_000)]
    words[100:200] = ["x"] * 100
    ranges = periodic_runs.lag_ranges(len(words), 2, periodic_runs.RANGE_WORK)
    assert len(ranges) > 2 and ranges[0][0] == 1 and ranges[-1][1] == 20_001 and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    out = periodic_runs.periodic_runs(spark, spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    found = [(x.start, x.length, x.period) for x in out.runs]
    assert (100, 100, 1) in found and any(q == 7001 and s <= 20_000 and n >= 18_000 for s, n, q in found) and len(found) == 2
    one = periodic_runs.batch_runs(pa.array([" ".join(["y"] * 200_000)]), None, 12, 2)[3].to_pylist()
    assert one == [[{"start": 0, "length": 200_000, "period": 1}]]


def test_planted_runs(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i % 7 * 9)) + " ") for i in range(200)] + [(None, "a"), (201, None)], "doc_id long, text string")
    for r in periodic_runs.with_planted_runs(docs).collect():
        words = [f"w{k}" for k in range(r.doc_id % 7 * 9)] if r.doc_id is not None and r.doc_id < 200 else []
        h = zlib.crc32(str(r.doc_id).encode())
        if words and h % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert r.doc_id in (None, 201) or r.text.split() == words


def test_pieces_encode_like_the_library():
    whole = token_files.PieceEncoder(vocabulary("byte_bpe_50k.json"))
    white = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]))
    odd = ["<|endoftext|> a  <|endoftext|>", "don't  we'LL  x  ", "  ", "x" * 300, "'s's", *(f"a{x}b{x} {x}{x}c {x}" for x in white)]
    r = random.Random(1)
    letters = white + "'saA_." + "".join(map(chr, [0xE9, 0x65E5, 0x0661, 0x2177, 0xB2, 0x1F44D, 0x1F3FD, 0x301]))
    odd += ["".join(r.choice(letters) for _ in range(30)) for _ in range(2000)]
    for t in odd:
        assert whole.encode(t) == whole.ids(t), repr(t)


def test_words_before_marks_and_line_ends_are_merged_once():
    coder = token_files.PieceEncoder(vocabulary("byte_bpe_50k.json"))
    calls = {"merge": 0, "split": 0}

    def counted(name, f):
        def call(x):
            calls[name] += 1
            return f(x)

        return call

    coder.merge, coder.split = (counted(name, getattr(coder, name)) for name in calls)
    words = [f"q{a}{b}zu" for a in "abcdefghij" for b in "klmnoprstu"]
    text = "start " + " ".join(f"{w}, {w} {w}.\nNext {w}!?" for w in words)
    assert coder.encode(text) == coder.ids(text)
    assert calls["merge"] < len(words) + 10 and not calls["split"], calls
    lines = "\n".join(["one", "Two,", "été", "3", "--"] * 4000)
    for t in (lines, f"a {lines}\n b", f"a {lines}\t c", f"a {lines}\n\nb"):
        assert coder.encode(t) == coder.ids(t)


@pytest.mark.parametrize("settings", [{}, {"shard_tokens": 700, "frame_bytes": 100}, {"shard_tokens": 3000, "max_shards": 2, "frame_bytes": 1}])
def test_token_files(spark, docs, rows, settings):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    manifest = token_files.write_tokens(spark, docs, "byte_bpe_50k.json", 0, **settings)
    out = {r.doc_id: r for r in token_files.read_tokens(spark, manifest).collect()}
    start = 0
    for r in rows:
        ids = whole.encode(r[1] or "", add_special_tokens=False).ids + [0]
        assert np.frombuffer(out[r[0]].ids, "<u4").tolist() == ids and (out[r[0]].start, out[r[0]].n_tokens) == (start, len(ids))
        start += len(ids)
    assert len(out) == len(rows) and sum(m.n_tokens for m in manifest.collect()) == start
    assert not settings or manifest.count() > 1


def test_readers_unpack_only_the_frames_they_need(spark, docs, rows, tmp_path):
    import zstandard

    manifest = token_files.write_tokens(spark, docs, "byte_bpe_50k.json", 0, frame_bytes=2000, to=str(tmp_path / "set"))
    (row,) = manifest.collect()
    data = open(row.path, "rb").read()
    flat = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert len(flat) == 2 * row.n_tokens  # any zstandard tool reads the ids; index and seek table are skipped
    reader = token_files.opened(row.path, row.n_bytes, row.width)
    assert len(reader.lengths) > 10 and max(x[1] for x in reader.lengths) <= 2000
    wanted = spark.createDataFrame([(7,), (40,), (40,), (999_999,), (None,)], "doc_id long")
    out = {r.doc_id: r for r in token_files.fetch_tokens(spark, manifest, wanted).collect()}
    full = {r.doc_id: r for r in token_files.read_tokens(spark, manifest).collect()}
    assert set(out) == {7, 40} and all(out[d].ids == full[d].ids and out[d].start == full[d].start for d in out)
    assert max(r.frames for r in out.values()) < len(reader.lengths) / 2


def test_damaged_shards_are_refused(spark, docs, tmp_path):
    manifest = token_files.write_tokens(spark, docs, "byte_bpe_50k.json", 0, frame_bytes=2000, to=str(tmp_path / "set"))
    (row,) = manifest.collect()
    good = open(row.path, "rb").read()
    place = token_files.opened(row.path, row.n_bytes, row.width)
    for at, data in ((0, good[:-1]), (1, good[:100]), (2, good[: int(place.places[3]) + 30] + b"?" + good[int(place.places[3]) + 31 :]), (3, good[: place.tables[0][0] + 20] + b"?" + good[place.tables[0][0] + 21 :])):
        path = tmp_path / f"bad{at}"
        path.write_bytes(data)
        with pytest.raises(Exception):  # noqa: B017 - zstandard's own error where its checksum finds the damage first
            list(token_files.opened(str(path), len(data), row.width).documents())


def test_token_files_of_odd_rows(spark, nothing):
    empty = token_files.write_tokens(spark, nothing, "byte_bpe_50k.json", 0)
    assert empty.count() == 0 and token_files.read_tokens(spark, empty).count() == 0
    rows = [(5, "b"), (5, "b"), (None, None), (None, "x y"), (3, "long " * 300_000), (2, "")]
    frame = spark.createDataFrame([(*r, b"", 1) for r in rows], "doc_id long, text string, ids binary, n_tokens int").coalesce(1)
    manifest = token_files.write_tokens(spark, frame, "byte_bpe_50k.json", 0, shard_tokens=2)
    out = sorted(((r.start, r.doc_id, r.n_tokens) for r in token_files.read_tokens(spark, manifest).collect()))
    assert [r[1:] for r in out] == [(None, 1), (None, 3), (2, 1), (3, 300_002), (5, 2), (5, 2)] and manifest.count() > 2
    hot = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    made = token_files.write_tokens(spark, hot, "byte_bpe_50k.json", 0, shard_tokens=100)
    assert made.count() > 10 and max(r.n_docs for r in made.collect()) < 1000 and token_files.read_tokens(spark, made).count() == 2000


def test_packing_ranges_hold_equal_shares(spark):
    from lectern.llm import packing

    r = np.random.default_rng(2)
    places = [*(int(x) for x in r.integers(0, 1 << 63, 3000)), *((5 << 40) + int(x) for x in r.integers(0, 1 << 15, 3000)), *[7 << 50] * 50]
    frame = spark.createDataFrame([(p, 10) for p in places], "place long, n_tokens long")
    for cells in (1 << 20, 64):
        bounds = packing._bounds(frame, 10 * len(places), 20, cells)
        sizes = np.bincount(np.searchsorted(bounds, np.array(places), side="left"), minlength=len(bounds) + 1)
        assert len(bounds) >= 15 and sorted(set(bounds)) == list(bounds) and sizes.max() <= 2.1 * len(places) / 20
    assert len(packing._bounds(frame, 10 * len(places), 1)) == 0 and len(packing._bounds(frame.limit(0), 0, 5)) == 0


def test_slices_are_few_files_and_are_released(spark):
    from pathlib import Path

    from lectern.llm import common, exact_dedup

    rows = spark.range(20_000).select(F.when(F.col("id") < 19_000, F.col("id")).otherwise(F.col("id") % 500).cast("string").alias("k")).repartition(40)
    with common.scratch(spark, "slices"):
        tested = exact_dedup.possibly_repeated(rows, "k", 20_000, max_filter_bytes=3 * 4200)
        assert tested.count() == 20_000
        folders = [Path(p.removeprefix("file:").replace("//", "/")) for p in common._tables["slices"]]
    sliced = [f for f in folders if any(f.glob("slice=*"))]
    assert sliced and all(len(list(s.glob("*.parquet"))) <= exact_dedup.SLICE_FILES for f in sliced for s in f.glob("slice=*"))
    common.release(spark, "slices")
    assert not any(f.exists() for f in folders)
