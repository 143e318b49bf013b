"""Exact dedup by two passes over a blocked Bloom filter.

Pass 1 counts, for two bits a text, how many rows set each bit; the bits that two rows or more set form the
filter. Pass 2 tests every row against it: a row with a bit that no other row set is unique and passes
straight through, and only the rest - possibly repeated hashes - shuffle by their digest. To count, pass 1 shuffles two
numbers of a bit for each row (about 30 bytes, whatever the text's length), but no digest and no text.

A filter of over `max_filter_bytes` is cut into slices by block number. The hashes are then laid out by slice, and each
slice's rows are tested against its own part of the filter, one slice after the other; so no executor holds more than
one slice, and unique rows pass straight through at any size.

Defined results: null text counts as empty. Rows of the same text and the same doc_id are one document: all carry
the same verdict. A null doc_id is smaller than any other. An empty table gives an empty result; further columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import BROADCAST_BYTES, ENTRY_BYTES, documents, new_folder, table, with_hot_keys, written

#: Bits of one block of the filter, an array of 64-bit words.
BLOCK_BITS, WORD_BITS = 32768, 64
#: Files that a slice's rows are written to.
SLICE_FILES = 16


def _with_bits(rows: DataFrame, key: str, blocks: int) -> DataFrame:
    """Adds the block of a row and its two bits there; all three come from disjoint bits of the key's hash."""
    h = F.xxhash64(key)
    return rows.withColumns(
        {"block": F.pmod(F.shiftrightunsigned(h, 30), F.lit(blocks)), "bit_a": h.bitwiseAND(F.lit(BLOCK_BITS - 1)), "bit_b": F.shiftright(h, 15).bitwiseAND(F.lit(BLOCK_BITS - 1))}
    )


def _set_bits(tested: str = "words") -> Column:
    """Whether both bits of a row are set in the words; null where there are none."""
    is_set = lambda bit: F.getbit(F.get(tested, F.shiftright(bit, 6).cast("int")), F.col(bit).bitwiseAND(F.lit(WORD_BITS - 1)).cast("int")) == 1
    return is_set("bit_a") & is_set("bit_b")


def _filter_of(bits: DataFrame) -> DataFrame:
    """One row a block of the filter: block, words; bits: block, bit."""
    one = F.expr(f"shiftleft(1L, cast(bit & {WORD_BITS - 1} AS int))")
    words = bits.groupBy("block", F.shiftright("bit", 6).cast("int").alias("word")).agg(F.bit_or(one).alias("bits"))
    blocks = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("known"))
    every = F.sequence(F.lit(0), F.lit(BLOCK_BITS // WORD_BITS - 1))
    return blocks.select("block", F.transform(every, lambda i: F.coalesce(F.try_element_at("known", i), F.lit(0).cast("long"))).alias("words"))


def _bits(rows: DataFrame, key: str, blocks: int) -> DataFrame:
    return _with_bits(rows, key, blocks).select("block", F.explode(F.array_distinct(F.array("bit_a", "bit_b"))).alias("bit"))


def repeated_filter(rows: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter of the bits that two rows or more have set."""
    return _filter_of(_bits(rows, key, blocks).groupBy("block", "bit").count().filter("count > 1"))


def possibly_in(rows: DataFrame, key: str, known: DataFrame, n: int, bits_a_row: int = 16, max_filter_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Those rows whose key is in known (distinct, n of them), and about one in a hundred others. rows don't shuffle, unless the filter exceeds its bound: then they are joined."""
    blocks = max(1, -(-n * bits_a_row // BLOCK_BITS))
    if blocks * (BLOCK_BITS // 8 + ENTRY_BYTES) > max_filter_bytes:
        return rows.join(known.select(key), key, "left_semi").select(*rows.columns)
    return _with_bits(rows, key, blocks).join(F.broadcast(_filter_of(_bits(known, key, blocks))), "block").filter(_set_bits()).select(*rows.columns)


def possibly_repeated(rows: DataFrame, key: str, total: int, bits_a_row: int = 16, max_filter_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """rows with `maybe`: false only where no other row has the key. rows is read twice; total is its count.

    The filter has bits_a_row bits for each row and is broadcast, a slice of at most max_filter_bytes (one block at least) at a time.
    """
    spark, block_bytes = rows.sparkSession, BLOCK_BITS // 8
    blocks = max(1, -(-total * bits_a_row // BLOCK_BITS))
    a_slice = max(1, max_filter_bytes // (block_bytes + ENTRY_BYTES))

    def tested(part: DataFrame) -> DataFrame:
        known = F.broadcast(repeated_filter(part, key, blocks))
        return _with_bits(part, key, blocks).join(known, "block", "left").withColumn("maybe", F.coalesce(_set_bits(), F.lit(False))).select(*rows.columns, "maybe")

    if blocks <= a_slice:
        return tested(rows)
    number = F.floor(F.col("block") / a_slice).cast("int")
    path = new_folder(spark)
    # Rows are dealt by slice and a part of the hash, so a slice is SLICE_FILES files, whatever the number of tasks.
    laid = _with_bits(rows, key, blocks).withColumn("slice", number).repartition("slice", F.pmod(F.col("bit_a"), F.lit(SLICE_FILES)))
    laid.select(*rows.columns, "slice").write.partitionBy("slice").parquet(path)
    laid = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("slice", T.IntegerType())])).parquet(path)
    return reduce(DataFrame.unionByName, [written(spark, tested(laid.filter(F.col("slice") == i).drop("slice"))) for i in range(-(-blocks // a_slice))])


def exact_duplicates(spark: SparkSession, docs: DataFrame, bits_a_row: int = 16, max_filter_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256. See possibly_repeated() for the filter."""
    hashed = written(spark, documents(docs, "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("text_sha256")))
    total = hashed.count()
    tested = possibly_repeated(hashed, "text_sha256", total, bits_a_row, max_filter_bytes)
    alone = tested.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    suspects = tested.filter("maybe").select("doc_id", "text_sha256")
    groups = suspects.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    found = with_hot_keys(suspects, groups, "text_sha256", "group_size", total)
    return alone.unionByName(found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark, table(spark, sf_dir, "documents"))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
