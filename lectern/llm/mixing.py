"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents fall by a hash of doc_id into blocks of about `block_words` words of one source. A source's target says how
many words the mix takes from it; whole passes over its blocks and then blocks in a permuted order fill the target,
and one last block is taken in part, document by document. That gives each source an exact quota of block draws. The
tree starts with all quotas at the root and gives half of the draws, chosen by a multivariate-hypergeometric draw, to
either child, until each leaf - an output shard - has its own quotas. Each source's permuted draws are then dealt out
to the shards in turn, so that shards hold disjoint draws, and a shard's documents are shuffled by a hash.

Each hypergeometric draw inverts its own distribution: a walk from the mode sums the ratios of neighbouring
probabilities, up and then down, as far as doubles can tell them from 0, and ends where a hashed uniform number lies.
Quotas add up exactly.

Sums over a source's blocks and shards run in two levels, within buckets and over them, so no task holds all of a
source. What stands in one row or window are the sources themselves, a few words each: their number is taken to be
in the thousands at most, as weights are given by their order.

Defined results: null text has size 0 and null is a source of its own, ordered last. Sources of size 0 have target 0.
Rows of the same doc_id and source lie in one block and are taken alike. An empty table gives an empty result; further
columns are ignored. Reruns agree, as all draws are hashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import bounded, documents, let, table, with_hot_keys, words, written

WEIGHTS, MAX_REPEATS = (5, 2, 1), 3
BLOCK_WORDS, SHARD_BLOCKS = 16_384, 64
#: Standard deviations that a walk covers: what lies beyond weighs less than a step of the uniform numbers, 2**-53.
REACH = 9
#: Blocks or shards of one source that a task sums up, and draws that it deals out.
BUCKET = 4096


def _hash(*parts) -> Column:
    """60 bits of the MD5 of the parts, which other SQL engines can compute as well."""
    joined = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def _source(source: Column) -> Column:
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def _block(seed: str) -> Column:
    return F.pmod(_hash(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.col("n_blocks"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row a source: source_key, docs, source_size, target, passes, rest, n_blocks.

    Weights repeat over the sources in code point order. With targets of weight x level, but never over
    repeats x size, level is the largest of the levels at which the sources of lower size by weight are all capped.
    """
    found = sizes.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    found = found.withColumn("weight", F.get(F.array(*map(F.lit, weights)), turn).cast("long")).withColumn("cap", F.lit(repeats) * F.col("source_size"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    heavy = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    found = found.withColumn("level", left / heavy)
    found = found.withColumn("target", F.least(F.col("weight") * F.max("level").over(every), F.col("cap").cast("double")))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return found.withColumn("passes", passes).select(
        "source_key", "docs", "source_size", "target", "passes", (F.col("target") - F.col("passes") * F.col("source_size")).alias("rest"),
        F.greatest(F.ceil(F.col("source_size") / block_words), F.lit(1)).alias("n_blocks"),
    )


def _walk(steps: Column, ratio, counted: float, left: Column) -> Column:
    """Sums weights from the mode on, which has the weight 1, itself counted (1.0) or not (0.0); step i multiplies by ratio(i).

    `sum` is all of it and `at` the number of the step at which the sum passes `left` (-1: none).
    """
    state = F.struct(F.lit(1.0).alias("w"), F.lit(counted).alias("sum"), F.when(F.lit(counted) > left, 0).otherwise(-1).cast("long").alias("at"))

    def step(s: Column, i: Column) -> Column:
        w = s["w"] * ratio(i)
        found = F.when((s["at"] < 0) & (s["sum"] + w > left), i).otherwise(s["at"])
        return F.struct(w.alias("w"), (s["sum"] + w).alias("sum"), found.alias("at"))

    one = F.lit(1).cast("long")
    return F.aggregate(F.filter(F.sequence(one, F.greatest(steps, one)), lambda i: i <= steps), state, step)


def _hypergeometric(good: Column, total: Column, draws: Column, uniform: Column) -> Column:
    """How many of `draws` balls, out of `total` of which `good` are marked, are marked, by inversion of uniform (0 to 1)."""
    zero = F.lit(0).cast("long")
    least, most = F.greatest(zero, draws + good - total), F.least(good, draws)
    mode = F.least(F.greatest(F.floor((draws + 1) * (good + 1).cast("double") / (total + 2)), least), most)
    share = good / F.greatest(total, F.lit(1))
    spread = F.sqrt(F.greatest(draws * share * (1 - share) * (total - draws) / F.greatest(total - 1, F.lit(1)), F.lit(0.0)))

    def drawn(mode: Column) -> Column:
        wide = F.ceil(spread * REACH) + 12
        up, down = F.least(most - mode, wide), F.least(mode - least, wide)
        over = lambda k: (good - k + 1).cast("double") * (draws - k + 1) / (k.cast("double") * (total - good - draws + k))  # noqa: E731  P(k) / P(k - 1)
        higher = lambda i: over(mode + i)
        lower = lambda i: 1 / over(mode - i + 1)
        none = F.lit(float("inf"))
        whole = _walk(up, higher, 1.0, none)["sum"] + _walk(down, lower, 0.0, none)["sum"]

        def placed(left: Column) -> Column:
            return let(_walk(up, higher, 1.0, left), lambda f: F.when(f["at"] >= 0, mode + f["at"]).otherwise(mode - F.greatest(_walk(down, lower, 0.0, left - f["sum"])["at"], zero)))

        return let(whole * uniform, placed)

    return F.when(most <= least, least).otherwise(let(mode, drawn))


def _draw(key: Column):  # noqa: ANN202
    """A step of the multivariate draw: how many of the next source's balls are among those left to draw."""

    def step(state: Column, x: Column) -> Column:
        uniform = (F.shiftrightunsigned(F.xxhash64(key, x["source_key"]), 11) + 0.5) / float(1 << 53)
        got = _hypergeometric(x["quota"], state["total"], state["draws"], uniform)
        return let(got, lambda n: F.struct((state["total"] - x["quota"]).alias("total"), (state["draws"] - n).alias("draws"), F.concat(state["left"], F.array(n)).alias("left")))

    return step


def splitting_tree(quotas: DataFrame, depth: int, seed: str = "tree") -> DataFrame:
    """shard, source_key, quota for the 2**depth leaves; quotas: source_key, quota. Zero quotas are left out."""
    node = quotas.filter("quota > 0").agg(F.sort_array(F.collect_list(F.struct("source_key", "quota"))).alias("bag")).select(F.lit(0).cast("long").alias("shard"), "bag")
    for level in range(depth):
        total = F.aggregate("bag", F.lit(0).cast("long"), lambda n, x: n + x["quota"])
        node = node.withColumn("total", total)
        key = F.concat_ws("|", F.lit(f"{seed}{level}"), F.col("shard").cast("string"))

        start = F.struct(F.col("total").alias("total"), F.ceil(F.col("total") / 2).alias("draws"), F.array().cast("array<bigint>").alias("left"))
        node = node.withColumn("left", F.aggregate("bag", start, _draw(key))["left"])
        part = lambda take: F.filter(F.transform("bag", lambda x, i: F.struct(x["source_key"].alias("source_key"), take(x, i).alias("quota"))), lambda x: x["quota"] > 0)
        halves = F.array(part(lambda x, i: F.get("left", i)), part(lambda x, i: x["quota"] - F.get("left", i)))
        node = node.select((F.col("shard") * 2).alias("shard"), F.posexplode(halves)).select((F.col("shard") + F.col("pos")).alias("shard"), F.col("col").alias("bag"))
        if level % 6 == 5:
            node = node.repartition("shard")
    return node.select("shard", F.inline("bag"))


def running(rows: DataFrame, bucket: Column, order: list[str], **values: Column) -> DataFrame:
    """rows with a column for each value: its sum over all rows of the same source_key before, by bucket and then by order.

    Two levels: within buckets, and over the sums of buckets. bucket must not fall where order rises.
    """
    rows = rows.withColumn("bucket", bucket).withColumns({f"{k}_": v for k, v in values.items()})
    sums = rows.groupBy("source_key", "bucket").agg(*[F.sum(f"{k}_").alias(f"{k}_") for k in values])
    over = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_key", "bucket", *[F.coalesce(F.sum(f"{k}_").over(over), F.lit(0)).alias(f"{k}_base") for k in values])
    inside = Window.partitionBy("source_key", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(sums, ["source_key", "bucket"]).withColumns({k: F.col(f"{k}_base") + F.coalesce(F.sum(f"{k}_").over(inside), F.lit(0)) for k in values})
    return out.drop("bucket", *[f"{k}{x}" for k in values for x in ("_", "_base")])


class Mix:
    """The plan of a mix of docs: sizes a document, targets a source, draws a block.

    sizes: doc_id, source_key, size. sources: see targets(). blocks: source_key, block, draws (array of copy and
    shard), left (null, or the words to take from the block in its last draw). shards: the leaves of the tree. part:
    the documents of cut blocks that are taken in their last draw.
    """

    def __init__(self, spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: str = "mix") -> None:
        self.seed = seed
        sized = documents(docs, "doc_id", "source", "text").select("doc_id", "source", _source(F.col("source")).alias("source_key"), F.size(words("text")).cast("long").alias("size"))
        self.sizes = written(spark, sized)
        self.total = self.sizes.count()
        self.sources = written(spark, targets(self.sizes, weights, repeats, block_words))
        self.n_sources = self.sources.count()
        self.placed = self.place(self.sizes.drop("source")).select("doc_id", "source_key", "size", "source_size", "target", "block")
        blocks = written(spark, self._blocks())
        quotas = blocks.groupBy("source_key").agg(F.sum("n").alias("quota"))
        n = blocks.agg(F.sum("n")).first()[0] or 0
        self.shards = written(spark, splitting_tree(quotas, max(0, math.ceil(math.log2(max(1, n / shard_blocks)))), seed))
        self.blocks = written(spark, self._dealt(blocks))
        self.n_blocks = blocks.count()
        inside = Window.partitionBy("source_key", "block").orderBy("turn", "doc_id", "size")
        cut = self.placed.join(bounded(blocks.filter("left IS NOT NULL").select("source_key", "block", "left"), self.n_sources, 200), ["source_key", "block"])
        cut = cut.withColumn("turn", _hash(f"{seed} part", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("upto", F.sum("size").over(inside) - F.col("size") / 2)
        self.part = written(spark, cut.filter("upto <= left").select("source_key", "doc_id").distinct())

    def place(self, docs: DataFrame) -> DataFrame:
        """docs (doc_id, source_key, ...) with the columns of their source and their block."""
        return with_hot_keys(docs, self.sources, "source_key", "docs", self.total).withColumn("block", _block(self.seed))

    def _blocks(self) -> DataFrame:
        """source_key, block, at (place in the source's permutation, from 0), n (draws), left (see blocks)."""
        blocks = self.placed.groupBy("source_key", "block").agg(F.sum("size").alias("words"))
        blocks = blocks.withColumn("turn", _hash(f"{self.seed} turn", F.col("source_key"), F.col("block").cast("string")))
        blocks = blocks.join(bounded(self.sources.select("source_key", "passes", "rest", "n_blocks"), self.n_sources, 200), "source_key")
        bucket = F.floor(F.col("turn") / float(1 << 60) * F.ceil(F.col("n_blocks") / BUCKET))
        blocks = running(blocks, bucket, ["turn", "block"], before=F.col("words"), at=F.lit(1).cast("long"))
        started = F.col("before") < F.col("rest")
        left = F.when(started & (F.col("before") + F.col("words") > F.col("rest")), F.col("rest") - F.col("before"))
        return blocks.select("source_key", "block", "at", (F.col("passes") + started.cast("long")).alias("n"), left.alias("left"))

    def _dealt(self, blocks: DataFrame) -> DataFrame:
        """Deals each source's draws, in permuted order pass after pass, to the shards by their quotas.

        A draw's place follows from its pass and its block's place. Draws and shards' shares of places meet by cells of BUCKET places.
        """
        counts = blocks.groupBy("source_key").agg(F.count("*").alias("all_blocks"))
        draws = blocks.filter("n > 0").select("source_key", "block", "at", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
        draws = draws.join(bounded(counts, self.n_sources, 200), "source_key").withColumn("place", (F.col("copy") - 1) * F.col("all_blocks") + F.col("at"))
        cell = lambda x: F.floor(x / BUCKET)
        shares = running(self.shards, cell(F.col("shard")), ["shard"], start=F.col("quota")).withColumn("stop", F.col("start") + F.col("quota"))
        shares = shares.select("source_key", "shard", "start", "stop", F.explode(F.sequence(cell(F.col("start")), cell(F.col("stop") - 1))).alias("cell"))
        dealt = draws.withColumn("cell", cell(F.col("place"))).join(shares, ["source_key", "cell"]).filter("start <= place AND place < stop")
        dealt = dealt.groupBy("source_key", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("draws"))
        return blocks.select("source_key", "block", "left").join(dealt, ["source_key", "block"])

    def drawn(self, placed: DataFrame) -> DataFrame:
        """Adds `draws` to rows of placed documents: copy and shard of each time the mix takes the document."""
        part = bounded(self.part.withColumn("in_part", F.lit(True)), self.part.count(), 200)
        out = placed.join(bounded(self.blocks, self.n_blocks, 120), ["source_key", "block"], "left").join(part, ["source_key", "doc_id"], "left")
        whole = F.col("left").isNull() | F.coalesce("in_part", F.lit(False))
        draws = F.when(whole, F.col("draws")).otherwise(F.slice("draws", F.lit(1), F.greatest(F.size("draws") - 1, F.lit(0))))
        return out.withColumn("draws", F.coalesce(draws, F.array().cast("array<struct<copy:bigint,shard:bigint>>"))).drop("left", "in_part")


def _drawn_rows(plan: Mix, docs: DataFrame) -> DataFrame:
    """row (the columns of docs) and draw (copy, shard), as often as the mix takes each row."""
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("doc_id"), _source(docs["source"]).alias("source_key"))
    return plan.drawn(plan.place(keyed)).select("row", F.explode("draws").alias("draw"))


def _turn(seed: str) -> Column:
    return _hash(seed, F.col("row.doc_id").cast("string"), F.col("draw.copy").cast("string"))


def mix(spark: SparkSession, docs: DataFrame, seed: str = "mix", **settings) -> DataFrame:
    """The mixed documents: the columns of docs, as often as the mix takes each.

    The rows of a shard lie together, in an order shuffled by a hash, one shard after the other.
    """
    taken = _drawn_rows(Mix(spark, docs, seed=seed, **settings), docs)
    taken = taken.repartition(F.col("draw.shard")).sortWithinPartitions("draw.shard", _turn(seed))
    return taken.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def mixed_shards(spark: SparkSession, docs: DataFrame, seed: str = "mix", **settings) -> DataFrame:
    """What mix() lays out: doc_id, source, copy, shard, place (in the shard's shuffled order, from 0) of every draw of a document."""
    docs = docs.select("doc_id", "source", "text")
    taken = _drawn_rows(Mix(spark, docs, seed=seed, **settings), docs)
    place = F.row_number().over(Window.partitionBy("draw.shard").orderBy(_turn(seed), "row.doc_id")) - 1
    return taken.select("row.doc_id", "row.source", "draw.copy", "draw.shard", place.cast("long").alias("place"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Mix(spark, table(spark, sf_dir, "documents"))
    return plan.drawn(plan.placed).select("doc_id", "size", "source_size", "target", (F.size("draws") * F.col("size")).cast("long").alias("taken"))


def op5_mix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards that the splitting tree deals the same draws to."""
    return mixed_shards(spark, table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH z AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM z GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 3 * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER low, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER low, 0))::DOUBLE AS level
      FROM w WINDOW low AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(weight * max(level) OVER (), cap::DOUBLE) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes, greatest(ceil(source_size::DOUBLE / 16384)::BIGINT, 1) AS n_blocks FROM t),
d AS (SELECT z.doc_id, z.size, p.*, coalesce('=' || p.source, 'null') AS source_key, target - passes * source_size AS rest,
             ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % n_blocks AS block FROM z JOIN p ON z.source IS NOT DISTINCT FROM p.source),
b AS (SELECT source_key, block, rest, sum(size)::BIGINT AS words, ('0x' || substr(md5('mix turn|' || source_key || '|' || block::VARCHAR), 1, 15))::BIGINT AS turn FROM d GROUP BY ALL),
c AS (SELECT *, sum(words) OVER (PARTITION BY source_key ORDER BY turn, block) - words AS before FROM b),
e AS (SELECT d.*, c.before, c.words, sum(size) OVER (PARTITION BY source_key, block ORDER BY ('0x' || substr(md5('mix part|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT, doc_id, size) - size / 2 AS upto
      FROM d JOIN c USING (source_key, block, rest))
SELECT doc_id, size, source_size, target,
       (size * (passes + CASE WHEN before >= rest OR words = 0 THEN 0 WHEN before + words <= rest THEN 1 WHEN upto <= rest - before THEN 1 ELSE 0 END))::BIGINT AS taken
FROM e
"""
