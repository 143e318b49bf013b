"""Packing along a space-filling curve.

Each document's tokens give a hashed vector, which a fixed random matrix projects to four dimensions; the Hilbert
index of that point orders the documents, so that neighbours on the curve are alike. Documents are laid end to end
in that order and cut every `length` tokens. Only the very last sequence can hold padding.

Steps: tokenise once into a table in the shared folder (Arrow); find ranges of the order key of about equal numbers of
tokens, from sums over its first bits; sum tokens by range, which gives each range its first token's place; sort each range on its own and cut.
The low bits of the order key are a hash of doc_id, so that documents with one and the same point - copies - are
dealt over ranges like any others, and each range gets a partition of its own. What reaches the driver are three numbers
a range, at most `max_ranges` of each, and 2**18 sums at a time. A long text is held whole by one task.

Defined results: null and empty text have the closing token alone. Repeated rows are packed as often as they occur.
A null doc_id is packed like any other. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import documents, table, vocabulary, written
from lectern.llm.token_counts import byte_alphabet

DIMS, BITS, BUCKETS = 4, 12, 256
TIE_BITS = 15
MEMO = 400_000
#: Documents that are cut at a time.
CUT_ROWS = 500
#: Characters for which Python's lower() and the pattern's classes were compared with the library's one by one.
UNPROVEN = r"[^\x00-\x1b\x20-ɏ‐-⁞₠-₿]"
# Fixed value: the pattern by which this kind of vocabulary splits text; white space is dropped.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    """Ids of texts as the tokenizer file at `path` gives them, without special tokens, as packed integers.

    No pre-token holds white space, so a text is cut there first, and both what lies between and its pre-tokens are
    kept in bounded memos; only a new pre-token is merged by the library. Text with characters outside the compared
    ranges or with one of the tokenizer's special strings, and any text of a tokenizer with another pattern, is
    encoded whole by the library.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        size = self.whole.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.packed = [i.to_bytes(self.dtype.itemsize, "little") for i in range(size)]
        self.split, self.unproven = regex.compile(PATTERN).findall, regex.compile(UNPROVEN).search
        special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, special)) or r"(?!)").search
        steps = (json.loads(self.whole.to_str())["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_word = any(x.get("pattern", {}).get("Regex") == PATTERN for x in steps)
        self.merge = self.whole.model.tokenize
        self.letters = {b: c for c, b in byte_alphabet().items()}
        self.chunks: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def forget(self) -> None:
        """At a task's end: a worker that waits for its next task holds no memos."""
        self.chunks.clear()
        self.parts.clear()

    def merged(self, part: str) -> bytes:
        """Ids of a pre-token."""
        spelt = part if part.isascii() and part.isprintable() else "".join(map(self.letters.get, part.encode()))
        return b"".join([self.packed[t.id] for t in self.merge(spelt)])

    def new(self, chunk: str) -> bytes:
        """Ids of a chunk that the memo lacks. A pre-token that is a chunk as well is kept there alone."""
        if chunk.isalpha():
            return self.parts.get(chunk) or self.merged(chunk)
        found = []
        for part in self.split(chunk):
            if (ids := self.chunks.get(part) or self.parts.get(part)) is None:
                if len(self.parts) >= MEMO:
                    self.parts.clear()
                ids = self.merged(part)
                if len(part) < 64:
                    self.parts[part] = ids
            found.append(ids)
        return b"".join(found)

    def encode(self, text: str) -> bytes:
        if not self.by_word or self.unproven(text) or self.special(text):
            return b"".join([self.packed[i] for i in self.whole.encode(text, add_special_tokens=False).ids])
        chunks, memo = text.lower().split(), self.chunks
        found = list(map(memo.get, chunks))
        if None in found:
            if len(memo) >= MEMO:
                memo.clear()
            new = self.new
            for k in [k for k, ids in enumerate(found) if ids is None]:
                chunk = chunks[k]
                if (ids := memo.get(chunk)) is None:
                    ids = new(chunk)
                    if len(chunk) < 64:
                        memo[chunk] = ids
                found[k] = ids
        return b"".join(found)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One a worker process, as the tokenizer takes time to load."""
    return Encoder(path)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective hash of 64-bit integers."""
    x = x.astype(np.uint64)  # a copy
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of whole coordinates below 2**bits."""
    x = points.astype(np.int64).T.copy()
    dims, q = len(x), 1 << (bits - 1)
    while q > 1:  # undo the turns of the curve, from the coarsest bit on
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(up, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            place = (place << 1) | ((x[i] >> b) & 1)
    return place


class Projection:
    """Points of documents: hashed token counts, damped and scaled to length 1, times a fixed random matrix."""

    def __init__(self) -> None:
        self.bucket = (mixed(np.arange(1 << 20)) % np.uint64(BUCKETS)).astype(np.intp)
        self.matrix = np.random.default_rng(11).standard_normal((BUCKETS, DIMS)) / np.sqrt(DIMS)

    def places(self, ids: list[np.ndarray]) -> np.ndarray:
        counts = np.stack([np.bincount(self.bucket[i], minlength=BUCKETS) for i in ids]) if ids else np.zeros((0, BUCKETS))
        v = np.sqrt(counts)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        return hilbert(np.clip((v @ self.matrix + 2) / 4 * (1 << BITS), 0, (1 << BITS) - 1))


def tokenised(docs: DataFrame, path: str, closing: int) -> DataFrame:
    """doc_id, n_tokens, place (order key), ids (packed, with the closing id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shape = encoder(path), Projection()
        for batch in batches:
            end = coder.packed[closing]
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [coder.encode(t.as_py()) + end for t in part.column(1)]
                ties = mixed(part.column(0).fill_null(-1).to_numpy(zero_copy_only=False)) & np.uint64((1 << TIE_BITS) - 1)
                place = shape.places([np.frombuffer(i, coder.dtype) for i in ids]) << TIE_BITS | ties.astype(np.int64)
                n = [len(i) // coder.dtype.itemsize for i in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(place), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "place", "ids"])
        coder.forget()

    return documents(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, place long, ids binary")


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str = "word_bpe_49k.json", length: int = 2048, closing: int = 1, range_tokens: int = 4_000_000, max_ranges: int = 20_000, folder: str | None = None) -> DataFrame:
    """Per piece: doc_id, start, length, doc_tokens, sequence_id, offset, sequence_length, ids.

    ids are the piece's tokens as little-endian unsigned 32-bit integers. sequence_length is the padded length of
    the sequence: `length`, but the number of tokens in it where that is a power of two.
    """
    path, size = vocabulary(tokenizer, folder), length
    coded = written(spark, tokenised(docs, path, closing))
    sums = coded.agg(F.sum("n_tokens").alias("n"), F.max(F.octet_length("ids") / F.col("n_tokens")).cast("int").alias("width")).first()
    total, width = sums.n or 0, sums.width or 2
    ranges = max(1, min(max_ranges, -(-total // range_tokens)))
    bounds = _bounds(coded, total, ranges)
    seats = _seats(spark, ranges)

    @F.pandas_udf("int")
    def ranged(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, place.to_numpy(), side="left"))

    coded = coded.withColumn("part", ranged("place"))
    sums = {r.part: r.n for r in coded.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    starts = dict(zip(range(ranges), accumulate((sums.get(i, 0) for i in range(ranges)), initial=0), strict=False))
    left = total % length
    last, last_length = total // length, left if left & (left - 1) == 0 else length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = None, 0
        for batch in (b.slice(k, CUT_ROWS) for b in batches for k in range(0, b.num_rows, CUT_ROWS)):
            rows: list[tuple] = []
            for p, doc, n, ids in zip(*(batch.column(i) for i in range(4)), strict=True):
                if part != p.as_py():
                    part = p.as_py()
                    at = starts[part]
                doc, n, ids, start = doc.as_py(), n.as_py(), np.frombuffer(ids.as_py(), f"<u{width}").astype("<u4"), 0
                while start < n:
                    sequence, offset = divmod(at, size)
                    take = min(n - start, size - offset)
                    rows.append((doc, start, take, n, sequence, offset, last_length if sequence == last else size, ids[start : start + take].tobytes()))
                    start, at = start + take, at + take
            columns = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:7]), pa.array(columns[7], pa.binary())], [*names[:7], "ids"])

    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "sequence_length"]
    seat = F.pandas_udf(lambda part: pd.Series(seats[part.to_numpy()]), "long")
    sorted_ = coded.withColumn("seat", seat("part")).repartition(ranges, "seat").sortWithinPartitions("part", "place", "doc_id")
    return sorted_.select("part", "doc_id", "n_tokens", "ids").mapInArrow(cut, ", ".join(f"{n} long" for n in names) + ", ids binary")


def _bounds(coded: DataFrame, total: int, ranges: int, cells: int = 1 << 18) -> np.ndarray:
    """Largest place of each range but the last, so that ranges hold about equal numbers of tokens.

    Tokens are summed by the first bits of the place, at most `cells` sums at a time, which come to the driver as two arrays; what
    holds more than a range's share is summed again by its next bits. A cell that can't be cut further is one place.
    """
    share, shift = max(1, total // ranges), DIMS * BITS + TIE_BITS
    lasts, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    wide: np.ndarray | None = None  # cells to be cut, of `shift` bits
    while ranges > 1 and shift > 0 and (wide is None or len(wide)):
        taken = min(shift, max(1, cells.bit_length() - 1 - (0 if wide is None else len(wide).bit_length())))
        rows = coded
        if wide is not None:
            held = coded.sparkSession.createDataFrame([(int(w),) for w in wide], "cell long")
            rows = coded.join(F.broadcast(held), F.shiftright("place", shift) == F.col("cell"), "left_semi")
        shift -= taken
        sums = rows.groupBy(F.shiftright("place", shift).alias("cell")).agg(F.sum("n_tokens").alias("n")).toArrow()
        cell, n = (sums.column(i).to_numpy() for i in range(2))
        large = (n > share) & (shift > 0)
        wide = cell[large]
        lasts.append((cell[~large] + 1 << shift) - 1)
        sizes.append(n[~large])
    last, n = np.concatenate(lasts), np.concatenate(sizes)
    order = np.argsort(last)
    full = np.cumsum(n[order]) // share
    ends = np.flatnonzero(full[:-1] > np.concatenate([[0], full[:-2]])) if len(full) > 1 else np.zeros(0, np.int64)
    return last[order][ends][: ranges - 1].astype(np.int64)


def _seats(spark: SparkSession, ranges: int) -> np.ndarray:
    """For each range a number of its own that repartition(ranges, number) hashes to a partition of its own, so that no two ranges share one."""
    numbers = spark.range(ranges * (20 + ranges.bit_length())).groupBy(F.pmod(F.hash("id"), F.lit(ranges)).alias("at")).agg(F.min("id").alias("id"))
    found = {r["at"]: r["id"] for r in numbers.collect()}
    return np.array([found.get(i, i) for i in range(ranges)], np.int64)


def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(spark, table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
