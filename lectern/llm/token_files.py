"""Files of token ids: independent zstandard frames, a trailing seek table and per-frame checksums.

A dataset is a folder of shards, in the order of doc_id, and a manifest. A shard is

    token frames    each one zstandard frame of at most `frame_bytes` of ids (little-endian, 2 or 4 bytes each)
    index frames    skippable frames; each a compressed table of up to INDEX_ROWS documents: doc_id, whether it has one, ids
    seek table      a skippable frame in the public seekable format: for each frame before it its compressed size, its
                    decompressed size (0 for index frames) and a checksum, then their number and a magic number

So any zstandard tool unpacks a shard to its ids, and a reader gets the end of a file, then the index, then the frames that
hold the documents it wants, and no others. Checksums are the low 32 bits of XXH64: of a token frame's ids, as the
format has it, and of an index frame's whole content. Frames don't heed the limits of documents: small ones share a frame, a large one takes several.

Writing: texts are encoded once into a table in the shared folder; rows are dealt out by ranges of (doc_id, row), so that
rows of one doc_id, or of none, can lie in several shards; each task writes one shard under a name of its own. The manifest - a Parquet
table - is written by the same job and lists the shards of the attempts that Spark committed. A file that a lost or repeated attempt has left is
in no manifest and is never read. Workers write and read by pyarrow's file systems (local and mounted folders, hdfs, s3, gs).

Defined results: null and empty texts have the closing id alone. A null doc_id comes before all others; rows of the same
doc_id keep their place in the input. Repeated rows are stored as often as they occur. An empty table gives no shards;
further columns are ignored. A long text is held whole by the task that encodes it; a reader holds one document and one frame.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import bounded, documents, new_folder, table, vocabulary, written
from lectern.llm.token_counts import PATTERN, UNPROVEN, byte_alphabet

# Fixed values of the zstandard seekable format, and the class of the tokenizer's white space (Unicode's White_Space).
SKIPPABLE, SEEK_MAGIC, SEEK_HEADER = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
CHECKSUMS = 1 << 7
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: ASCII marks: neither letters nor digits nor white space.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
ENTRY, HEAD, FOOT = struct.Struct("<III"), struct.Struct("<II"), struct.Struct("<IBI")

#: Documents of an index frame, and pieces of text that a worker remembers.
INDEX_ROWS, MEMO = 65_536, 700_000


class PieceEncoder:
    """Ids of texts as a byte-level tokenizer file has them, without added special tokens.

    Byte-level BPE merges inside pre-tokens alone. A blank that is followed by no white space begins a pre-token, so a text
    without other blanks is cut at each of them; any other text is cut by `pieces`, which needs no character class but white
    space. What a blank leads is encoded once and kept in a bounded memo: of characters whose classes were proven (see
    token_counts), pre-token by pre-token by the model's merges, else by the library. Most pieces need no pattern for that:
    a line's end between characters that are no white space is a pre-token, and so are letters, and ASCII marks behind
    them up to the end; a word alone and before marks share their place in the memo. Text that holds a special token's
    string, and any text of a tokenizer of another kind, is encoded whole by the library.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        size, made = self.whole.get_vocab_size(), json.loads(self.whole.to_str())
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.packed = [i.to_bytes(self.dtype.itemsize, "little") for i in range(size)]
        kind = made["pre_tokenizer"] or {}
        self.by_piece = (kind.get("type"), kind.get("add_prefix_space"), kind.get("use_regex"), made["normalizer"], made["model"]["type"], made["model"]["dropout"]) == ("ByteLevel", False, True, None, "BPE", None)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()) or r"(?!)").search
        self.pieces = re.compile(rf" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+").findall
        self.split, self.unproven = regex.compile(PATTERN).findall, regex.compile(UNPROVEN).search
        letters = {b: c for c, b in byte_alphabet().items()}
        self.letters, self.merge = {b: letters[b] for b in range(256)}, self.whole.model.tokenize
        self.lead = letters[ord(" ")]
        self.line_end = self.merged("\n") if self.by_piece else b""
        self.led: dict[str, bytes] = {}  # by what follows the blank
        self.others: dict[str, bytes] = {}  # by the piece or pre-token itself

    def ids(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def forget(self) -> None:
        """At a task's end: a worker that waits for its next task holds no memos."""
        self.led.clear()
        self.others.clear()

    def merged(self, part: str) -> bytes:
        """Ids of a pre-token."""
        return b"".join([self.packed[t.id] for t in self.merge(part.encode().decode("latin-1").translate(self.letters))])

    def stem(self, letters: str, led: bool) -> bytes:
        """Ids of letters, and of a blank before them if they are led by one, which are one pre-token."""
        if not letters.isascii():
            return self.merged(" " + letters if led else letters)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.merge(self.lead + letters if led else letters)])

    def part(self, part: str) -> bytes:
        """Ids of a pre-token, of which the memo may have some."""
        memo, key = (self.led, part[1:]) if part[0] == " " and len(part) > 1 and part[1] not in self.blanks else (self.others, part)
        if (ids := memo.get(key)) is None:
            ids = self.merged(part)
            self.keep(memo, key, ids)
        return ids

    def new(self, word: str, led: bool) -> bytes:
        """Ids of a word or white space, and of a blank before it if it is led by one, that no memo has."""
        letters = word.rstrip(MARKS)
        if letters.isalpha() and (letters.isascii() or not self.unproven(letters)):
            if len(letters) == len(word):
                return self.stem(letters, led)
            memo = self.led if led else self.others
            if (ids := memo.get(letters)) is None:
                ids = self.stem(letters, led)
                self.keep(memo, letters, ids)
            return ids + self.part(word[len(letters) :])
        piece = " " + word if led else word
        if self.unproven(piece):
            return self.ids(piece)
        parts = self.split(piece)
        return self.merged(piece) if len(parts) == 1 else b"".join([self.part(p) for p in parts])

    @staticmethod
    def keep(memo: dict[str, bytes], key: str, ids: bytes) -> None:
        if len(key) < 64:
            if len(memo) >= MEMO:
                memo.clear()
            memo[key] = ids

    def word(self, word: str, led: bool = True) -> bytes:
        """Ids of what begins with no white space, and of a blank before it if it is led by one."""
        memo = self.led if led else self.others
        if (ids := memo.get(word)) is None:
            if "\n" in word:
                first, *lines = word.split("\n")
                if not any(not x or x[0] in self.blanks or x[-1] in self.blanks for x in (first, *lines)):
                    return self.line_end.join([self.word(first, led), *[self.word(x, False) for x in lines]])
            ids = self.new(word, led)
            self.keep(memo, word, ids)
        return ids

    def loose(self, text: str) -> bytes:
        """Ids of any text without special strings."""
        found = []
        for piece in self.pieces(text):
            if piece[0] == " " and len(piece) > 1:
                found.append(self.word(piece[1:]) if piece[1] not in self.blanks else self.ids(piece))
            elif (ids := self.others.get(piece)) is None:
                ids = self.new(piece, False)
                self.keep(self.others, piece, ids)
                found.append(ids)
            else:
                found.append(ids)
        return b"".join(found)

    blanks = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{SPACES}]", c))

    def encode(self, text: str) -> bytes:
        if not self.by_piece or self.special(text):
            return self.ids(text)
        first, *words = text.split(" ")
        found = list(map(self.led.get, words))
        known, packed, merge, lead = self.led, self.packed, self.merge, self.lead
        for k in [k for k, ids in enumerate(found) if ids is None]:
            w = words[k]
            if w.isalpha() and w.isascii() and len(w) < 64:  # most of them: as word(), without its calls
                if (ids := known.get(w)) is None:
                    if len(known) >= MEMO:
                        known.clear()
                    ids = known[w] = b"".join([packed[t.id] for t in merge(lead + w)])
                found[k] = ids
            elif not w or w[0] in self.blanks:  # no memo has these
                return self.loose(text)
            else:
                found[k] = self.word(w)
        return self.loose(first) + b"".join(found)


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One a worker process, as the tokenizer takes time to load."""
    return PieceEncoder(path)


def encoded(docs: DataFrame, path: str, closing: int) -> DataFrame:
    """doc_id, n_tokens, ids (packed, with the closing id), in the order of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        end, width = np.array([closing], coder.dtype).tobytes(), coder.dtype.itemsize
        for batch in batches:
            ids = [coder.encode(t.as_py()) + end for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(i) // width for i in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])
        coder.forget()

    return documents(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def checksum(data: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(data) & 0xFFFFFFFF


class ShardWriter:
    """Writes one shard to a binary stream, frame by frame."""

    def __init__(self, out, width: int, frame_bytes: int, level: int = 3) -> None:  # noqa: ANN001
        import zstandard

        self.out, self.width, self.frame_bytes = out, width, max(width, frame_bytes // width * width)
        self.squeeze = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.held, self.table, self.rows, self.documents, self.tokens = bytearray(), [], [], 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.rows.append((doc_id, len(ids) // self.width))
        self.documents += 1
        self.tokens += len(ids) // self.width
        self.held += ids
        while len(self.held) >= self.frame_bytes:
            self._frame(bytes(self.held[: self.frame_bytes]))
            del self.held[: self.frame_bytes]
        if len(self.rows) >= INDEX_ROWS:
            self._index()

    def _frame(self, ids: bytes) -> None:
        data = self.squeeze(ids)
        self.out.write(data)
        self.table.append((len(data), len(ids), checksum(ids)))

    def _skippable(self, magic: int, content: bytes) -> int:
        self.out.write(HEAD.pack(magic, len(content)) + content)
        return HEAD.size + len(content)

    def _index(self) -> None:
        """An index frame of the rows so far: their number, doc_ids, numbers of ids, and a bit for each known doc_id."""
        ids = np.array([d or 0 for d, _ in self.rows], "<i8")
        known = np.packbits(np.array([d is not None for d, _ in self.rows], np.uint8))
        counts = np.array([n for _, n in self.rows], "<i8")
        content = self.squeeze(struct.pack("<q", len(self.rows)) + ids.tobytes() + counts.tobytes() + known.tobytes())
        self.table.append((self._skippable(SEEK_HEADER, content), 0, checksum(content)))
        self.rows = []

    def close(self) -> None:
        if self.held:
            self._frame(bytes(self.held))
        if self.rows:
            self._index()
        entries = b"".join(ENTRY.pack(*e) for e in self.table)
        self._skippable(SKIPPABLE, entries + FOOT.pack(len(self.table), CHECKSUMS, SEEK_MAGIC))


class Damaged(ValueError):
    """A shard that isn't what its seek table says."""


class ShardReader:
    """Reads a shard from a seekable binary file. `unpacked` counts the token frames that were decompressed."""

    def __init__(self, file, size: int, width: int) -> None:  # noqa: ANN001
        import zstandard

        self.file, self.width, self.unsqueeze, self.unpacked = file, width, zstandard.ZstdDecompressor().decompress, 0
        n, flags, magic = FOOT.unpack(self._read(size - FOOT.size, FOOT.size))
        at = size - FOOT.size - n * ENTRY.size
        if magic != SEEK_MAGIC or flags != CHECKSUMS or at < HEAD.size or HEAD.unpack(self._read(at - HEAD.size, HEAD.size)) != (SKIPPABLE, size - at):
            raise Damaged("no seek table")
        sizes = np.frombuffer(self._read(at, n * ENTRY.size), "<u4").reshape(-1, 3)
        places = np.concatenate([[0], np.cumsum(sizes[:, 0], dtype=np.int64)])
        if places[-1] != at - HEAD.size:
            raise Damaged("frames don't reach to the seek table")
        frames = sizes[:, 1] > 0
        self.places, self.lengths, self.checks = places[:-1][frames], sizes[frames], sizes[frames, 2]
        self.ends = np.cumsum(self.lengths[:, 1], dtype=np.int64)
        self.tables = [(int(p), int(s), int(c)) for p, (s, _, c) in zip(places[:-1][~frames], sizes[~frames], strict=True)]
        self.kept: tuple[int, bytes] = (-1, b"")

    def _read(self, at: int, n: int) -> bytes:
        if at < 0:
            raise Damaged("too short")
        self.file.seek(at)
        data = self.file.read(n)
        if len(data) != n:
            raise Damaged("cut off")
        return data

    def index(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """doc_ids, whether they are known, and numbers of ids of all documents in order, index frame by index frame."""
        for at, size, check in self.tables:
            content = self._read(at, size)[HEAD.size :]
            if checksum(content) != check:
                raise Damaged("index frame")
            raw = self.unsqueeze(content)
            (n,) = struct.unpack_from("<q", raw)
            ids, counts = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(2, n)
            yield ids, np.unpackbits(np.frombuffer(raw, np.uint8, offset=8 + 16 * n))[:n].astype(bool), counts

    def frame(self, k: int) -> bytes:
        if self.kept[0] != k:
            ids = self.unsqueeze(self._read(int(self.places[k]), int(self.lengths[k][0])), max_output_size=int(self.lengths[k][1]))
            if len(ids) != self.lengths[k][1] or checksum(ids) != self.checks[k]:
                raise Damaged(f"frame {k}")
            self.kept, self.unpacked = (k, ids), self.unpacked + 1
        return self.kept[1]

    def ids(self, start: int, n: int) -> bytes:
        """n ids from the start-th on."""
        low, high = start * self.width, (start + n) * self.width
        out, k = [], int(np.searchsorted(self.ends, low, side="right"))
        while low < high:
            begin = int(self.ends[k]) - int(self.lengths[k][1])
            out.append(self.frame(k)[low - begin : high - begin])
            low, k = int(self.ends[k]), k + 1
        return b"".join(out)

    def documents(self, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[int | None, int, int, bytes]]:
        """doc_id, start in the shard, number of ids and ids of the documents for whose (doc_ids, known) `wanted` is true, in order."""
        start = 0
        for doc_ids, known, counts in self.index():
            starts = start + np.cumsum(counts) - counts
            start = int(starts[-1] + counts[-1])
            for k in range(len(counts)) if wanted is None else np.flatnonzero(wanted(doc_ids, known)):
                yield (int(doc_ids[k]) if known[k] else None), int(starts[k]), int(counts[k]), self.ids(int(starts[k]), int(counts[k]))


MANIFEST = "shard long, path string, width int, n_docs long, n_tokens long, n_bytes long, first long, last long"


def write_tokens(spark: SparkSession, docs: DataFrame, tokenizer: str, closing: int, shard_tokens: int = 1 << 23, max_shards: int = 20_000, frame_bytes: int = 1 << 18, folder: str | None = None, to: str | None = None) -> DataFrame:
    """Writes the dataset and returns its manifest, a row a shard in the order of `shard`; `to`: a folder that all machines reach, else one in the shared folder."""
    source = vocabulary(tokenizer, folder)
    width = encoder(source).dtype.itemsize
    coded = written(spark, encoded(docs, source, closing).withColumn("row", F.monotonically_increasing_id()))
    total = coded.agg(F.sum("n_tokens")).first()[0] or 0
    if not total:
        return spark.createDataFrame([], MANIFEST)
    shards = max(1, min(max_shards, -(-total // shard_tokens)))
    place = to or new_folder(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, made, first, last = TaskContext.get().partitionId(), None, None, None
        files, at = pafs.FileSystem.from_uri(place)
        path = f"{at}/{shard:06d}-{uuid.uuid4().hex}.zst"
        try:
            for batch in batches:
                for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if made is None:
                        files.create_dir(at, recursive=True)
                        made, first = ShardWriter(files.open_output_stream(path, compression=None), width, frame_bytes), doc_id
                    made.add(doc_id, ids.as_py())
                    last = doc_id
            if made is not None:
                made.close()
        finally:
            if made is not None:
                made.out.close()
        if made is not None:
            row = {"shard": shard, "path": f"{place}/{path.rpartition('/')[2]}", "width": width, "n_docs": made.documents, "n_tokens": made.tokens, "n_bytes": files.get_file_info(path).size, "first": first, "last": last}
            yield pa.RecordBatch.from_pylist([row], MANIFEST_ARROW)

    order = [F.asc_nulls_first("doc_id"), F.asc("row")]
    dealt = coded.select("doc_id", "ids", "row").repartitionByRange(shards, *order).sortWithinPartitions(*order)
    return written(spark, dealt.select("doc_id", "ids").mapInArrow(run, MANIFEST))


MANIFEST_ARROW = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[t]) for n, t in (x.split() for x in MANIFEST.split(", "))])


def opened(path: str, n_bytes: int, width: int) -> ShardReader:
    files, at = pafs.FileSystem.from_uri(path)
    return ShardReader(files.open_input_file(at), n_bytes, width)


def _emit(rows: Iterable[tuple], names: list[str], most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of rows (three numbers, ids) of about so many bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= most or len(held) >= 10_000:
            yield _batch(held, names)
            held, size = [], 0
    if held:
        yield _batch(held, names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.binary())], names)


def _wide(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()


TOKENS = ["doc_id", "start", "n_tokens", "ids"]
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


def _with_offsets(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """manifest with before: ids of all earlier shards. There are at most max_shards rows, of which two numbers each reach the driver."""
    sizes = sorted((r.shard, r.n_tokens) for r in manifest.select("shard", "n_tokens").collect())
    before = spark.createDataFrame([(s, b) for (s, _), b in zip(sizes, accumulate((n for _, n in sizes), initial=0))], "shard long, before long")
    return manifest.join(bounded(before, len(sizes), 16), "shard")


def read_tokens(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per stored document: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian, 32 bits each), from the files; a task a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                shard = opened(r["path"], r["n_bytes"], r["width"])
                yield from _emit(((d, r["before"] + s, n, _wide(ids, r["width"])) for d, s, n, ids in shard.documents()), TOKENS)

    rows = _with_offsets(spark, manifest).select("path", "n_bytes", "width", "before", "shard")
    return rows.repartitionByRange(max(1, rows.count()), "shard").mapInArrow(run, SCHEMA)


def fetch_tokens(spark: SparkSession, manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """read_tokens() of the documents whose doc_id is in wanted, with the frames decompressed for it (`frames`, of its shard so far).

    The wanted ids are dealt to the shards whose ranges hold them and read in order there, so a shard's index is read once
    for each block of ids and only the frames that hold them are decompressed.
    """
    shards = sorted((r.shard, r.first, r.last, r.path, r.n_bytes, r.width, r.before) for r in _with_offsets(spark, manifest).collect())
    shards = [s for s in shards if s[2] is not None]
    lasts, firsts = np.array([s[2] for s in shards], np.int64), np.array([-(1 << 63) if s[1] is None else s[1] for s in shards], np.int64)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(lasts, ids, side="left"), np.searchsorted(firsts, ids, side="right")
            many = np.maximum(high - low, 0)
            k = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(np.repeat(ids, many), pa.int64())], ["k", "doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at = None, -1
        for batch in batches:
            ks, ids = (batch.column(i).to_numpy() for i in range(2))
            for k in np.unique(ks):
                asked = ids[ks == k]
                if k != at:
                    (_, _, _, path, n_bytes, width, before), at = shards[k], k
                    shard = opened(path, n_bytes, width)
                found = shard.documents(lambda d, known, asked=asked: known & np.isin(d, asked))
                for out in _emit(((d, before + s, n, _wide(i, width)) for d, s, n, i in found), TOKENS):
                    yield out.append_column("frames", pa.array([shard.unpacked] * out.num_rows, pa.int64()))

    asked = wanted.select(F.col("doc_id").cast("long")).filter("doc_id IS NOT NULL").distinct().mapInArrow(dealt, "k long, doc_id long")
    return asked.repartition("k").sortWithinPartitions("k", "doc_id").mapInArrow(run, f"{SCHEMA}, frames long")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_tokens(spark, table(spark, sf_dir, "documents"), "byte_bpe_50k.json", closing=0)
    return read_tokens(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
