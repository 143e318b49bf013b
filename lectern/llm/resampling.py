"""Importance resampling towards a target distribution, with a dictionary of distinct features.

1. Features (runs of 1 to `max_n` words) of documents and target texts are counted by their strings: in each task first,
   in bounded counters, then by one shuffle of distinct strings. Each distinct string is hashed once.
2. Buckets are summed over the dictionary; a bucket's gain compares its share in the target with that in the documents.
3. Gains come back to the documents' own feature counts. The most frequent strings, as many as a checked number of bytes
   holds, go to all tasks, where a document's counts of them are added up on the spot; its counts of rarer strings are
   joined with the dictionary by a shuffle. No string of that shuffle is frequent, so it has no hot key.
4. A document's score is its weight plus Gumbel noise drawn from its doc_id, so that the highest scores are a sample
   without replacement. Scores are whole thousandths within a bounded range: a count of each gives the lowest score drawn, and
   only drawn rows are sorted, by ranges; a rank is the number of rows in earlier ranges plus the place in its own.

What reaches the driver: sums, a count for each score, the broadcast strings, and a number a range. No task sees more
than its share of rows.

Defined results: null text, or text without words, has no features and weight 0. Rows of the same doc_id, or of none, are
documents of their own; they share their noise, and ties in score between them go by their place in the input. A null
doc_id counts as the largest, its noise is that of the word `null`. An empty table gives an empty result, an empty target
counts as one without features; further columns are ignored. A long text is held whole by one task, with its words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import BROADCAST_BYTES, bounded, documents, table, with_row_keys, written

#: Different features that a task counts before it hands them on, and bytes that a worker needs for one besides its string.
COUNTED, PYTHON_ENTRY = 400_000, 150
#: Bits of monotonically_increasing_id() that number the rows of a partition.
PLACE_BITS = 33


def _table() -> bytes:
    """For bytes.translate: A-Z become a-z, all other ASCII but letters and digits becomes a blank."""
    return bytes(c if c > 127 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())


TABLE = _table()


def features(text: str, max_n: int) -> tuple[int, list[bytes]]:
    """Number of words, and all runs of 1 to max_n words, in UTF-8."""
    words = text.encode().translate(TABLE).split()
    runs = [b" ".join(words[i : i + n]) for n in range(2, max_n + 1) for i in range(len(words) - n + 1)]
    return len(words), words + runs


def feature_counts(texts: DataFrame, max_n: int) -> DataFrame:
    """feature, n of the column text; a feature has one row a task or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["feature", "n"])
            total.clear()
            return made

        for batch in batches:
            for text in batch.column(0):
                total.update(features(text.as_py(), max_n)[1])
                if len(total) >= COUNTED:
                    yield out()
        yield out()

    return documents(texts, "text").mapInArrow(run, "feature binary, n long")


def dictionary(spark: SparkSession, docs: DataFrame, target: DataFrame, max_n: int, buckets: int) -> DataFrame:
    """feature, s and t (how often it occurs in docs and in target), bucket, gain of the bucket; distinct features."""
    zero = F.lit(0).cast("long")
    both = feature_counts(docs, max_n).select("feature", F.col("n").alias("s"), zero.alias("t"))
    both = both.union(feature_counts(target, max_n).select("feature", zero.alias("s"), F.col("n").alias("t")))
    found = both.groupBy("feature").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    found = written(spark, found.withColumn("bucket", F.pmod(F.crc32("feature"), F.lit(buckets)).cast("int")))
    sums = found.agg(F.coalesce(F.sum("s"), zero).alias("s"), F.coalesce(F.sum("t"), zero).alias("t")).first()
    of = lambda column: F.sum(column).cast("double")
    ratio = (of("t") + 1) * F.lit(float(sums.s + buckets)) / ((of("s") + 1) * F.lit(float(sums.t + buckets)))
    gains = found.groupBy("bucket").agg(F.floor(F.log(ratio) * 1000).alias("gain"))
    return found.join(bounded(gains, buckets, 16), "bucket")


def frequent(known: DataFrame, limit: int) -> Column:
    """Whether a feature is one of the most frequent, of which as many are taken as so many bytes hold in a worker."""
    level = F.length(F.bin("s"))
    sizes = known.groupBy(level.alias("level")).agg(F.sum(F.octet_length("feature") + PYTHON_ENTRY).alias("bytes")).collect()
    least, held = 64, 0
    for r in sorted(sizes, reverse=True):
        if (held := held + r.bytes) > limit:
            break
        least = r.level
    return level >= least


def weighed(spark: SparkSession, docs: DataFrame, target: DataFrame, max_n: int, buckets: int, limit: int) -> DataFrame:
    """Per row of docs: doc (a key in the order of doc_id), doc_id, n_words, n_features, weight."""
    known = written(spark, dictionary(spark, docs, target, max_n, buckets).filter("s > 0").select("feature", "s", "gain"))
    hot = frequent(known, limit)
    common = known.filter(hot).select("feature", "gain").toArrow()
    gains = spark.sparkContext.broadcast(dict(zip(common.column(0).to_pylist(), common.column(1).to_pylist(), strict=True)))
    rest_type = pa.struct([("feature", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = gains.value.get
        for batch in batches:
            sizes, totals, sums, ends, rest = [], [], [], [0], []
            for text in batch.column(2):
                n, found = features(text.as_py(), max_n)
                counts, total = Counter(found), 0
                for feature, k in counts.items():
                    if (g := gain(feature)) is None:
                        rest.append((feature, k))
                    else:
                        total += g * k
                sizes.append(n)
                totals.append(len(found))
                sums.append(total)
                ends.append(len(rest))
            names, counts = zip(*rest, strict=True) if rest else ((), ())
            pairs = pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(counts, pa.int64())], fields=list(rest_type))
            columns = [*(pa.array(x, pa.int64()) for x in (sizes, totals, sums)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc", "doc_id", "n_words", "n_features", "sum", "rest"])

    keyed = with_row_keys(documents(docs, "doc_id", "text")).select("doc", "doc_id", "text")
    found = written(spark, keyed.mapInArrow(run, "doc long, doc_id long, n_words long, n_features long, sum long, rest array<struct<feature: binary, n: long>>"))
    rare = found.select("doc", F.inline("rest")).join(known.filter(~hot).select("feature", "gain"), "feature")
    rare = rare.groupBy("doc").agg(F.sum(F.col("gain") * F.col("n")).alias("more"))
    full = found.drop("rest").join(rare, "doc", "left").withColumn("sum", F.col("sum") + F.coalesce("more", F.lit(0)))
    mean = F.when(F.col("n_features") == 0, 0).otherwise(F.expr("(sum - pmod(sum, n_features)) DIV n_features"))
    return full.select("doc", "doc_id", "n_words", "n_features", mean.cast("long").alias("weight"))


def noise(seed: str) -> Column:
    """Gumbel noise in thousandths, drawn from the doc_id by its hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000)


def drawn(spark: SparkSession, scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """scored with rank: 1, 2, 3... by falling score, ties by doc, for so many of a hundred eligible rows; else null."""
    counts = sorted(((r.score, r["count"]) for r in scored.filter(eligible).groupBy("score").count().collect()), reverse=True)
    quota = percent * sum(n for _, n in counts) // 100
    reached = list(accumulate(n for _, n in counts))
    none = F.lit(None).cast("long")
    if not quota:
        return scored.withColumn("rank", none)
    least = next(score for (score, _), so_far in zip(counts, reached, strict=True) if so_far >= quota)
    high = eligible & (F.col("score") >= least)
    order = [F.desc("score"), F.asc("doc")]
    top = scored.filter(high).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    top = written(spark, top.withColumn("part", F.shiftrightunsigned("at", PLACE_BITS)))
    parts = sorted((r.part, r["count"]) for r in top.groupBy("part").count().collect())
    before = accumulate((n for _, n in parts), initial=0)
    offsets = spark.createDataFrame([(p, b) for (p, _), b in zip(parts, before)], "part long, before long")
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + 1
    top = top.join(bounded(offsets, len(parts), 16), "part").withColumn("rank", F.when(place <= quota, place))
    return top.select(*scored.columns, "rank").union(scored.filter(~high).withColumn("rank", none))


def importance_resample(
    spark: SparkSession, docs: DataFrame, target: DataFrame, max_n: int = 1, buckets: int = 10_000, min_words: int = 20, percent: int = 10, seed: str = "2024", limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_features, weight, score, rank (null where it isn't drawn). limit: bytes of broadcast features."""
    scored = written(spark, weighed(spark, docs, target, max_n, buckets, limit).withColumn("score", F.col("weight") + noise(seed)))
    return drawn(spark, scored, F.col("n_words") >= min_words, percent).drop("doc")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance_resample(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: DuckDB has no crc32: it is folded over the bytes of each distinct word, by a table of 256 entries made from the polynomial.
OP11_SQL = r"""
WITH crc AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS entry
  FROM range(256) r(i)),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
occurring AS (
  SELECT unnest(words) AS word, 1 AS s, 0 AS t FROM docs
  UNION ALL
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')), 0, 1 FROM benchmark),
counted AS (SELECT word, sum(s) AS s, sum(t) AS t, hex(encode(word)) AS h FROM occurring GROUP BY word),
hashed AS (
  SELECT word, s, t, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(0, length(h) // 2),
           lambda i: 16 * (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1)),
           lambda c, b: xor(c >> 8, entry[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
  FROM counted, crc),
totals AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM counted),
gains AS (
  SELECT bucket, floor(1000 * ln((sum(t) + 1)::DOUBLE * (any_value(all_s) + 10000)::DOUBLE / ((sum(s) + 1)::DOUBLE * (any_value(all_t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM hashed, totals GROUP BY bucket),
each AS (SELECT doc_id, unnest(words) AS word FROM docs),
means AS (SELECT doc_id, floor(sum(gain)::DOUBLE / count(*)::DOUBLE)::BIGINT AS weight FROM each JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, len(words) AS n, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((list_reduce(list_concat([0::BIGINT], list_transform(range(8), lambda i: strpos('0123456789abcdef', substr(sha256('2024:' || d.doc_id), i + 1, 1)) - 1)), lambda a, b: 16 * a + b) + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM docs d LEFT JOIN means m ON m.doc_id = d.doc_id),
ordered AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS many FROM scored WHERE n >= 20)
SELECT s.doc_id, s.n::BIGINT AS n_features, s.weight, s.score, CASE WHEN place <= 10 * many // 100 THEN place END AS rank
FROM scored s LEFT JOIN ordered o ON o.doc_id = s.doc_id
"""
