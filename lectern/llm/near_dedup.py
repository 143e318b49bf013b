"""Similarity join of documents on word n-grams (Jaccard) by grouped prefixes, and the classes that its links form.

1. Shingles are 64-bit hashes. Documents of one and the same set are represented by their first row.
2. A fixed-size sketch counts, over all documents, how often shingles of each hash range occur; shingles of rare ranges
   come first in the order of shingles. A set's prefix are its first n - ceil(t n) + 1 shingles: similar sets share one.
3. Sets of the same prefix and size form a group. Groups meet on prefix shingles within bands of size, filtered by size,
   by place, by class and by parity bits: each bit is the parity of the set's shingles in one hash range, so two sets
   differ in at least as many shingles as bits. A group's bound is its head's bits less the distance of its farthest
   member.
4. Rounds: in each, the members of a group that are of one class send one representative; of those that share a prefix
   shingle all but the best meet the best one, which is the set with the most shared shingles. Verified links contract
   the classes. Rounds go on while they find many links. So a group of n near copies costs about n pairs a round.
5. Last pass: all pairs of groups that hold different classes and pass the filters are expanded to their members, and
   the pairs that are still of different classes are verified. So every link between different classes is found.

Filters stand in the conditions of the joins, so pairs that can't link are never rows. Frequent shingles are dealt out
by salts. Verification counts the common shingles of both whole texts. Classes are found by alternating star steps on
tables; no links reach the driver.

Defined results: null text, or text without words, has no shingles and is linked with nothing. With fewer words than
`n` the whole sequence is one shingle. Rows of the same doc_id, or of none, are documents of their own; a null doc_id
counts as the largest. Repeated rows are one class. An empty table gives an empty result; further columns are ignored. A very long text is held whole,
with some 20 bytes for each of its words, by the tasks that read or verify it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import bounded, documents, interim, small_batches, table, with_hot_keys, with_row_keys, written
from lectern.llm.exact_dedup import possibly_in
from lectern.llm.packing import mixed

#: The sketch has 2**CELL_BITS counters, sent in pieces of 2**PIECE_BITS.
CELL_BITS, PIECE_BITS = 20, 16
#: Pairs of one document that may meet its text in one task, and groups with one shingle that may meet in one.
SALT_ROWS = 500
KEY_ROWS = 2000
#: Most parity bits that a group carries through the join.
PARITY_BITS = 1024
#: Rounds of representatives; they end earlier once a round finds few links for the sets in play.
ROUNDS, FEW_LINKS = 4, 0.01
#: Words that a worker remembers, and documents that it holds the shingles of at a time.
MEMO, SLICE = 150_000, 500


class Shingler:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self, n: int) -> None:
        from xxhash import xxh3_64_intdigest

        self.n, self.digest, self.memo = n, xxh3_64_intdigest, {}
        self.factors = [np.uint64(int(x) | 1) for x in np.random.default_rng(5).integers(1, 1 << 63, n)]

    def words(self, text: str) -> np.ndarray:
        parts, memo = text.encode().lower().split(), self.memo  # of bytes: A-Z only, and ASCII white space
        found = list(map(memo.get, parts))
        if None in found:
            if len(memo) > MEMO:
                memo.clear()
            digest = self.digest
            for i, (p, f) in enumerate(zip(parts, found, strict=True)):
                if f is None:
                    found[i] = memo[p] = digest(p)
        return np.array(found, np.uint64)

    def shingles(self, text: str) -> np.ndarray:
        w, n = self.words(text), self.n
        if len(w) < n:
            return w[:0] if not len(w) else np.array([self.digest(len(w).to_bytes(8, "big") + w.tobytes())], np.uint64)
        h = w[: len(w) - n + 1] * self.factors[0]
        for k in range(1, n):
            h += w[k : len(w) - n + 1 + k] * self.factors[k]
        return np.unique(mixed(h))


def sketch(docs: DataFrame, n: int) -> np.ndarray:
    """How often, over all documents, shingles of each of the 2**CELL_BITS hash ranges occur. 8 MB at any size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, total = Shingler(n), np.zeros(1 << CELL_BITS, np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                cells = [shingler.shingles(t.as_py()) >> np.uint64(64 - CELL_BITS) for t in batch.column(0).slice(at, 256)]
                total += np.bincount(np.concatenate(cells).astype(np.int64), minlength=len(total)).astype(np.uint32)
        if total.any():
            pieces = total.reshape(-1, 1 << PIECE_BITS)
            narrow = [p.astype(np.min_scalar_type(p.max())).tobytes() for p in pieces]  # one to four bytes a counter
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array(narrow, pa.binary())], ["piece", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = counts.as_py()
                sums[piece] = sums.get(piece, 0) + np.frombuffer(raw, f"u{len(raw) >> PIECE_BITS}").astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["piece", "counts"])

    total = np.zeros((1 << (CELL_BITS - PIECE_BITS), 1 << PIECE_BITS), np.uint64)
    parts = documents(docs, "text").mapInArrow(count, "piece int, counts binary").repartition(len(total), "piece")
    with small_batches(docs.sparkSession):
        for row in parts.mapInArrow(add, "piece int, counts binary").collect():
            total[row.piece] += np.frombuffer(row.counts, np.uint64)
    return total.ravel()


def frequency_classes(counts: np.ndarray) -> np.ndarray:
    """0 to 255 for each cell, by rank of its count: rare ones first."""
    classes = np.empty(len(counts), np.uint8)
    classes[np.argsort(counts, kind="stable")] = np.arange(len(counts)) * 256 // len(counts)
    return classes


def band(n: int, percent: int) -> int:
    """Number of the band of size n. Sets of sizes that may link lie in one band or in neighbouring ones."""
    return n if percent == 100 else math.floor(math.log(n) / math.log(100 / percent) + 1e-9)


def band_bits(k: int, percent: int) -> int:
    """Parity bits of band k: four a shingle or more, at most PARITY_BITS."""
    low = k if percent == 100 else (100 / percent) ** min(k, 200)
    return min(PARITY_BITS, 64 << max(0, int(4 * max(low, 1) - 1).bit_length() - 6))


SETS = "doc long, doc_id long, n_shingles long, signature binary, shape binary, band int, prefix array<long>, bits array<long>, low array<long>, fine array<long>"


def prefixes(docs: DataFrame, n: int, percent: int, classes: np.ndarray) -> DataFrame:
    """Per row of docs (doc, doc_id, text) see SETS: signature of the whole set (null for an empty one), shape (of the group), prefix in order,
    parity bits by the set's own band, by the band below, and four or more a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        shingler = Shingler(n)
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            sizes, signatures, shapes, bands, firsts, bits, low, fines = [], [], [], [], [], [], [], []
            for text in batch.column(2):
                s = shingler.shingles(text.as_py())
                order = (classes[(s >> np.uint64(64 - CELL_BITS)).astype(np.intp)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                take = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                first = s[np.argsort(order, kind="stable")[:take]]
                k = band(max(len(s), 1), percent)
                sizes.append(len(s))
                signatures.append(xxh3_128_digest(s.tobytes()) if len(s) else None)
                shapes.append(xxh3_128_digest(len(s).to_bytes(8, "big") + first.tobytes()))
                bands.append(k)
                firsts.append(first.view(np.int64))
                fines.append(fine := parity_bits(s, 64 << max(0, int(4 * len(s) - 1).bit_length() - 6)))
                bits.append(folded(fine, band_bits(k, percent)))
                low.append(folded(fine, band_bits(k - 1, percent)))
            columns = [pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary()), pa.array(shapes, pa.binary()), pa.array(bands, pa.int32()), *map(_lists, (firsts, bits, low, fines))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], [x.split()[0] for x in SETS.split(", ")])

    return docs.select("doc", "doc_id", "text").mapInArrow(run, SETS)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts) if parts else [], pa.int64()))


def parity_bits(s: np.ndarray, bits: int) -> np.ndarray:
    """For each of so many (a power of two) hash ranges whether an odd number of the hashes lies in it."""
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.intp), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded(parity: np.ndarray, bits: int) -> np.ndarray:
    """parity_bits() of fewer hash ranges, made from those of more."""
    return np.bitwise_xor.reduce(parity.reshape(-1, bits // 64), axis=0)


def _fits(differ: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    """Whether sets that differ in so many shingles at least may be similar enough."""
    return differ * (100 + percent) <= (n_a + n_b) * (100 - percent)


def _differ(x: Column | str, y: Column | str) -> Column:
    """In how many bits two arrays of one length, of up to PARITY_BITS, differ."""
    return reduce(lambda p, q: p + q, [F.coalesce(F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))), F.lit(0)) for i in range(PARITY_BITS // 64)])


def likely(spark: SparkSession, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that four parity bits or more a shingle don't rule out. Of two lengths of bits the longer one is folded."""
    rows = written(spark, pairs)
    used = rows.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    known = written(spark, sets.select("doc", "n_shingles", "fine").join(bounded(used, 2 * rows.count(), 40), "doc", "left_semi"))
    side = lambda s: known.select(F.col("doc").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("fine").alias(f"bits_{s}"))
    rows = rows.join(side("a"), "a").join(side("b"), "b")

    def half(x: str) -> Column:
        size = (F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, F.lit(1), size), F.slice(x, size + 1, size), lambda p, q: p.bitwiseXOR(q))

    fold = lambda x, y: F.when(F.size(x) > F.size(y), half(x)).otherwise(F.col(x))
    rows = rows.select("a", "b", "n_a", "n_b", fold("bits_a", "bits_b").alias("x"), fold("bits_b", "bits_a").alias("y"))
    differ = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0).cast("long"), lambda n, d: n + d)
    return rows.filter((F.size("x") != F.size("y")) | _fits(differ, F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def _with_text(pairs: DataFrame, key: str, other: str, texts: DataFrame, rows: int) -> DataFrame:
    """pairs with text_<key>. A document of many pairs gets its text in several tasks, one for each SALT_ROWS pairs."""
    hot = pairs.groupBy(F.col(key).alias("doc")).count().filter(F.col("count") > SALT_ROWS).select("doc", F.ceil(F.col("count") / SALT_ROWS).cast("int").alias("salts"))
    hot = bounded(hot, rows // SALT_ROWS, 40)
    salted = pairs.join(hot, F.col(key) == F.col("doc"), "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(other), F.col("salts")).cast("int"), F.lit(0))).drop("doc", "salts")
    copies = texts.join(hot, "doc", "left").select(F.col("doc").alias(key), F.col("text").alias(f"text_{key}"), F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    return salted.join(copies, [key, "salt"]).drop("salt")


def verified(spark: SparkSession, pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose whole texts are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, kept = Shingler(n), {}
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = []
            for i in range(batch.num_rows):
                sets = []
                for doc, column in ((a[i], 2), (b[i], 3)):
                    if (s := kept.get(doc)) is None:
                        if len(kept) > 200:
                            kept.clear()
                        s = kept[doc] = shingler.shingles(batch.column(column)[i].as_py())
                    sets.append(s)
                both = np.sort(np.concatenate(sets), kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                good.append(100 * common >= percent * (len(both) - common))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    pairs = written(spark, pairs)
    rows = pairs.count()
    used = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    texts = texts.join(bounded(used, 2 * rows, 40), "doc", "left_semi")
    full = _with_text(_with_text(pairs, "b", "a", texts, rows), "a", "b", texts, rows)
    return written(spark, full.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long"))


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """doc, root (the smallest document that links reach) for every document in links (a, b) but the roots themselves."""
    edges = written(spark, links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u < v").distinct())
    state = None
    while True:
        rows = edges.count()
        both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).union(edges.select(F.col("u").alias("x"), F.col("v").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("low"), F.count("*").alias("n"))
        large = with_hot_keys(both, low, "x", "n", 2 * rows).filter("y > x AND y > low").select(F.col("y").alias("v"), F.col("low").alias("u")).distinct()
        large = written(spark, large)
        low = large.groupBy("v").agg(F.min("u").alias("low"), F.count("*").alias("n"))
        down = with_hot_keys(large, low, "v", "n", rows)
        small = down.select(F.col("u").alias("v"), F.col("low").alias("u")).union(low.select("v", F.col("low").alias("u"))).filter("u < v").distinct()
        edges = written(spark, small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("v").alias("doc"), F.col("u").alias("root"))
        state = now


def _labelled(rows: DataFrame, label: DataFrame, doc: str = "doc", root: str = "root") -> DataFrame:
    """rows with the root of the column doc; label (doc, root) lacks those that are their own."""
    return rows.join(label.select(F.col("doc").alias(doc), F.col("root").alias(root)), doc, "left").withColumn(root, F.coalesce(root, doc))


class Classes:
    """The classes so far: label has doc and root of all sets that aren't their own root."""

    def __init__(self, spark: SparkSession, sets: DataFrame, texts: DataFrame, n: int, percent: int) -> None:
        self.spark, self.sets, self.texts, self.n, self.percent = spark, sets, texts, n, percent
        self.label = spark.createDataFrame([], "doc long, root long")

    def add(self, pairs: DataFrame) -> int:
        """Verifies pairs (a, b) of unlike classes and contracts the links among them; how many there were."""
        with interim(self.spark) as keep:
            pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            links = verified(self.spark, likely(self.spark, pairs, self.sets, self.percent), self.texts, self.n, self.percent)
            found = links.count()
            if found:
                edges = _labelled(_labelled(links, self.label, "a", "x"), self.label, "b", "y").select(F.col("x").alias("a"), F.col("y").alias("b"))
                merged = components(self.spark, edges)
                moved = self.label.join(merged.select(F.col("doc").alias("root"), F.col("root").alias("to")), "root", "left").select("doc", F.coalesce("to", "root").alias("root"))
                self.label = written(self.spark, moved.union(merged))
                keep.append(self.label)
        return found


def _postings(spark: SparkSession, heads: DataFrame, groups: DataFrame) -> DataFrame:
    """key, head, place, up: prefix shingles of groups that meet another group there; heads: doc, band, prefix of each group's head.

    A key is a shingle and a band; each group stands under its own band and, marked up, under the band below, so that
    groups of neighbouring bands meet. First shingles and then keys are counted; a Bloom filter of those that occur
    in two groups or more lets the rest go where it is read. Groups of several sets have one more row, without a place, under a key of their own.
    """
    each = heads.select(F.col("doc").alias("head"), "band", F.posexplode("prefix").alias("place", "token"))
    shared = written(spark, each.groupBy("token").count().filter("count > 1").select("token"))
    each = written(spark, possibly_in(each, "token", shared, shared.count()))
    key = lambda band: F.xxhash64("token", band)
    both = F.array(F.struct(key(F.col("band")).alias("key"), F.lit(False).alias("up")), F.struct(key(F.col("band") - 1).alias("key"), F.lit(True).alias("up")))
    rows = each.select("head", "place", F.inline(both)).select("key", "head", "place", "up")
    live = written(spark, rows.groupBy("key").agg(F.count_if(~F.col("up")).alias("own"), F.count("*").alias("n")).filter("own > 0 AND n > 1").select("key"))
    own = groups.filter("n > 1").select(F.xxhash64("head", F.lit("group")).alias("key"), "head", F.lit(None).cast("int").alias("place"), F.lit(False).alias("up"))
    return possibly_in(rows, "key", live, live.count()).union(own)


def _round(members: DataFrame, met: DataFrame, percent: int, turn: int, total: int) -> DataFrame:
    """Pairs (a, b): under each key the best representative with all that are of another class and may be similar.

    members: doc, root, head, n_shingles, bits, score. In the first round the best has the highest score, later the
    classes take turns by hash.
    """
    rank = F.struct(F.col("score") if turn == 0 else F.xxhash64("root", F.lit(turn)), F.xxhash64("doc", F.lit(turn)))
    reps = members.groupBy("head", "root").agg(F.max(F.struct(rank.alias("rank"), "doc")).alias("r")).select("head", "root", "r.*")
    posted = met.filter(~F.col("up")).select("head", "key").join(reps, "head").drop("head")
    best = posted.groupBy("key").agg(F.max(F.struct("rank", F.col("doc").alias("best"), F.col("root").alias("best_root"))).alias("b"), F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    best = best.filter("lo <> hi").select("key", "n", "b.best", "b.best_root")
    pairs = with_hot_keys(posted, best, "key", "n", total).filter(F.col("root") != F.col("best_root")).select(F.col("doc").alias("a"), F.col("best").alias("b")).distinct()
    side = lambda s: members.select(F.col("doc").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}"))
    near = _fits(_differ("bits_a", "bits_b"), F.col("n_a"), F.col("n_b"), percent)
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(near).select("a", "b")


def _salted(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of met under their own band, and all rows, both with the column salt: of a key with many rows the left ones are dealt out, the right ones copied to all salts."""
    hot = met.groupBy("key").count().filter(F.col("count") > KEY_ROWS).select("key", F.ceil(F.col("count") / KEY_ROWS).cast("int").alias("salts"))
    both = met.join(bounded(hot, hot.count(), 16), "key", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    left = both.filter(~F.col("up")).withColumn("salt", F.pmod(F.xxhash64("head"), F.col("salts")).cast("int"))
    return left.drop("salts"), both.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")


def _open_groups(spark: SparkSession, members: DataFrame, met: DataFrame, percent: int) -> DataFrame:
    """head_a, head_b of all groups that may hold similar sets of different classes; a group of several classes is paired with itself."""
    groups = members.groupBy("head").agg(F.min_by(F.struct("n_shingles", "bits", "low"), "doc").alias("h"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"))
    groups = written(spark, groups.select("head", "h.*", "lo", "hi", "n"))
    wide = members.join(groups.filter("n > 1").select("head", F.col("bits").alias("head_bits")), "head").groupBy("head").agg(F.max(_differ("bits", "head_bits")).alias("radius"))
    groups = groups.join(wide, "head", "left").withColumn("radius", F.coalesce("radius", F.lit(0))).drop("n")
    left, right = _salted(met.filter("place IS NOT NULL"))
    named = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("head", "n_shingles", "place", "radius", "lo", "hi")]
    a = left.join(groups, "head").select("key", "salt", *named("a"), F.col("bits").alias("bits_a"))
    b = right.join(groups, "head").select("key", "salt", *named("b"), F.when(F.col("up"), F.col("low")).otherwise(F.col("bits")).alias("bits_b"))
    x, y = F.col("n_shingles_a"), F.col("n_shingles_b")
    fits = ((x < y) | ((x == y) & (F.col("head_a") < F.col("head_b")))) & (x * 100 >= y * percent)
    fits = fits & (F.least(x - F.col("place_a"), y - F.col("place_b")) >= F.ceil((x + y) * percent / (100 + percent)))
    fits = fits & ~((F.col("lo_a") == F.col("hi_a")) & (F.col("lo_a") == F.col("lo_b")) & (F.col("lo_a") == F.col("hi_b")))
    fits = fits & _fits(_differ("bits_a", "bits_b") - F.col("radius_a") - F.col("radius_b"), x, y, percent)
    close = a.join(b, ["key", "salt"]).filter(fits).select("head_a", "head_b").distinct()
    return close.union(groups.filter("lo <> hi").select(F.col("head").alias("head_a"), F.col("head").alias("head_b")))


def jaccard_classes(spark: SparkSession, docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id that links of percent or more reach)."""
    keyed = with_row_keys(documents(docs, "doc_id", "text"))
    sets = written(spark, prefixes(keyed, n, percent, frequency_classes(sketch(keyed, n))))
    same = sets.filter("signature IS NOT NULL").groupBy("signature").agg(F.min(F.struct("doc", "doc_id")).alias("x"), F.count("*").alias("copies"))
    same = written(spark, same.select("signature", "copies", "x.*"))
    total = same.count()
    only = lambda docs, n: sets.join(bounded(docs, n, 8), "doc", "left_semi")
    groups = written(spark, only(same.select("doc"), total).groupBy("shape").agg(F.min("doc").alias("head"), F.count("*").alias("n")))
    with interim(spark) as keep:
        met = written(spark, _postings(spark, only(groups.select(F.col("head").alias("doc")), groups.count()), groups))
        keep.append(met)
    with interim(spark) as keep:
        scores = met.filter(~F.col("up")).groupBy("head").agg(F.count("place").alias("score"))
        near = met.select("head").distinct().join(groups.select("shape", "head"), "head").join(scores, "head", "left").select("shape", "head", F.coalesce("score", F.lit(0)).alias("score"))
        near = written(spark, near)
        found = only(same.select("doc"), total).select("doc", "shape", "n_shingles", "band", "bits", "low").join(bounded(near, near.count(), 40), "shape")
        pool = written(spark, found.drop("shape"))
        classes, size = Classes(spark, sets, keyed.select("doc", "text"), n, percent), max(pool.count(), 1)
        for turn in range(ROUNDS):
            if classes.add(_round(_labelled(pool, classes.label), met, percent, turn, size)) <= FEW_LINKS * size:
                break
        members = written(spark, _labelled(pool, classes.label).drop("score"))
        keep += [members, classes.label]
    close = _open_groups(spark, members, met, percent)
    side = lambda s: members.select(*[F.col(c).alias(f"{c}_{s}") for c in ("head", "doc", "root", "n_shingles", "band", "bits", "low")])
    unlike = (F.col("root_a") != F.col("root_b")) & ((F.col("head_a") != F.col("head_b")) | (F.col("doc_a") < F.col("doc_b")))
    bits_b = F.when(F.col("band_a") < F.col("band_b"), F.col("low_b")).otherwise(F.col("bits_b"))
    fits = _fits(_differ("bits_a", bits_b), F.col("n_shingles_a"), F.col("n_shingles_b"), percent)
    classes.add(close.join(side("a"), "head_a").join(side("b"), "head_b").filter(unlike & fits).select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")))
    roots = same.select(F.col("doc").alias("root"), F.col("doc_id").alias("component_id"))
    found = _labelled(same.select("signature", "copies", "doc"), classes.label).join(roots, "root").select("signature", "copies", "component_id")
    full = with_hot_keys(sets.filter("signature IS NOT NULL").select("doc_id", "n_shingles", "signature"), found, "signature", "copies", total).select("doc_id", "n_shingles", "component_id")
    return full.union(sets.filter("signature IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark, table(spark, sf_dir, "documents"), n=3, percent=90)
