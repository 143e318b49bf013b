"""Rows without ids, of one id, copies, ties and very long texts, operator by operator; what the quality rules reject of labelled rows."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import line_dedup, mixing, near_dedup, packing, quality, token_counts
from lectern.llm.common import vocabulary

LONG = " ".join(f"word{i % 977} and" for i in range(60_000))
ODD = [(5, "one two three"), (5, "one two three"), (5, "four"), (None, "one two three"), (None, None), (None, ""), (7, LONG), (8, LONG)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "en", "s", "x", 1) for r in ODD], "doc_id long, text string, lang string, source string, size string, kept int").repartition(3)


def test_token_counts(odd):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    out = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(odd, "byte_bpe_50k.json").collect())
    assert out == Counter((d, len((t or "").encode()), len(whole.encode(t or "", add_special_tokens=False))) for d, t in ODD)


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    out = packing.pack(spark, odd, range_tokens=20_000).collect()
    want = Counter((d, len(whole.encode(t or "", add_special_tokens=False)) + 1) for d, t in ODD)
    starts = Counter((r.doc_id, r.doc_tokens) for r in out if r.start == 0)
    assert starts == want and sum(r.length for r in out) == sum(n * k for (_, n), k in want.items())
    ties = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text"))
    tied = packing.pack(spark, ties, range_tokens=500)
    assert tied.select("doc_id").distinct().count() == 3000 and tied.agg(F.max(F.col("sequence_id") * 2048 + F.col("offset") + F.col("length"))).first()[0] == tied.agg(F.sum("length")).first()[0]


def test_quality(odd):
    out = Counter((r.row.doc_id, r.n_words, r.base_failed) for r in quality.quality(odd, "doc_id").collect())
    assert out == Counter([(5, 3, True), (5, 3, True), (5, 1, True), (None, 3, True), (None, 0, True), (None, 0, True), (7, 120_000, True), (8, 120_000, True)])


def test_quality_of_labelled_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = quality.quality(docs, "doc_id").select("row.doc_id", "base_failed", "kept").join(labels, "doc_id").filter("NOT base_failed")
    n = found.agg(F.count_if(F.expr("quality = 0")).alias("bad"), F.count_if(F.expr("quality = 0 AND NOT kept")).alias("caught"), F.count_if(F.expr("quality = 1")).alias("good"), F.count_if(F.expr("quality = 1 AND NOT kept")).alias("lost")).first()
    assert n.good > 100 and n.lost == 0 and n.bad > 0 and n.caught >= 0.8 * n.bad


def test_mix(spark, odd):
    out = mixing.Mix(spark, odd, block_words=200, shard_blocks=4)
    rows = out.drawn(out.placed).collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter([(5, 3), (5, 3), (5, 1), (None, 3), (None, 0), (None, 0), (7, 120_000), (8, 120_000)])
    assert {r.source_size for r in rows} == {240_010} and all(len(r.draws) <= 3 for r in rows)
    assert len({len(r.draws) for r in rows if r.doc_id == 5 and r.size == 3}) == 1  # equal rows are taken alike


def test_line_dedup_of_long_texts(spark):
    text = "\n".join(f"line {i}" for i in range(30_000))
    out = {r.doc_id: r for r in line_dedup.dedup_lines(spark, spark.createDataFrame([(1, text), (2, "x\n" + text), (None, "y")], "doc_id long, text string")).collect()}
    assert (out[1].text, out[2].text, out[None].text) == (text, "x", "y")


def test_near_duplicates_with_a_hot_shingle_and_long_texts(spark):
    r = np.random.default_rng(4)
    hot = [f"the same five words here {' '.join(f'u{i}_{k}' for k in range(r.integers(3, 60)))}" for i in range(1500)]
    texts = [*hot, LONG, LONG.replace("word5 ", "other "), hot[7], hot[7] + " tail" if len(hot[7].split()) > 40 else hot[7]]
    out = {x.doc_id: x.component_id for x in near_dedup.jaccard_classes(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, 80).collect()}
    sets = defaultdict(set)
    for i, t in enumerate(texts):
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    near = [(i, j) for i in range(1500) for j in range(i) if len(sets[i] & sets[j]) * 100 >= 80 * len(sets[i] | sets[j])]
    assert not near and len({out[i] for i in range(1500)}) == 1500 and out[1501] == out[1500] and out[1502] == out[1503] == out[7]
