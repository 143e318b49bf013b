"""Repeated byte strings: removes each byte of a string of `length` bytes that also starts earlier.

Cover samples and classes of equal hashes take the place of a blockwise suffix sort. The cover sample are the minima of hashes of `gram`
bytes in every window of `length` bytes, so two equal windows hold the same sample at the same place in them. Each
sample with the windows it stands for is one segment (under two window lengths), and is put in the bucket of its hash:

1. In place of ranks for long ties: samples of equal segments are one class. All members but the earliest
   are repeats with all their windows; no bytes are compared for them. A task keeps the earliest of its own and deals only those out.
2. Samples with one class are dropped: their windows occur once, or in repeats that are found already.
3. What is left are the earliest members of classes in buckets of two classes or more: segments that agree around the
   sample and differ further out. Only for these are the single windows hashed and compared, where the
   earliest stays. Equal windows hold the same sample, so they are dealt out by it, a segment's windows together.

Texts are hashed in one pass, and meet the segments of step 3 and the spans to cut in one shuffle each. Numbers are dealt
out packed, a row a bucket. A sample that has over HOT segments in a task is marked; its segments are told apart by
class and its windows by their own hash, each at most once a task. So a bucket's share of any sample is bounded by the number of tasks.
Windows and segments are identified by 64-bit hashes of all their bytes.

Defined results: null text is empty; texts under `length` bytes keep all. Earlier is a smaller doc_id, then an earlier
start; a null doc_id comes last. Rows of the same doc_id, or of none, are documents of their own in the order of the
input; each loses bytes only by its own spans.
An empty table gives an empty result; further columns are ignored. A very long text is held whole by one task, with about
25 bytes for each of its own while it is sampled (20 MB took 0.46 GB there, measured outside Spark).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import documents, table, with_row_keys, written
from lectern.llm.packing import mixed

LENGTH, GRAM = 100, 40
#: Bytes of documents that are hashed, and that are cut, at a time; a longer document alone.
CHUNK, CUT = 1 << 16, 1 << 19
#: Samples, and windows, that a task gathers before it sends them.
FLUSH = 1 << 20
#: Segments of one sample in a flush, beyond which all tasks tell the sample's segments apart by class.
HOT = 32
#: What is known of a span: it starts earlier; it is asked for among others of its sample, or of its class; its windows are to be compared.
GONE, ASKED, LATE, OPEN = range(4)
#: Rows that are dealt out: a bucket's packed numbers. For windows, `hash` has those of all spans, one after the other.
NUMBERS = {"hash": np.uint64, "segment": np.uint64, "doc": np.int64, "span": np.int64}
DEALT = "bucket int, kind byte, hash binary, segment binary, doc binary, span binary"
FOUND = "kind byte, doc long, span long, key long"
NONE = np.zeros(0, np.uint64)


class Hasher:
    """Hashes of the strings that start at each place of a buffer."""

    def __init__(self, data: np.ndarray) -> None:
        self.n = len(data)
        padded = np.concatenate([data, np.zeros(264, np.uint8)])
        eight = np.ndarray((self.n + 256,), np.uint64, padded, strides=(1,))
        self.eight = eight >> np.uint64(29)  # eight bytes from each place on, stirred once for all sums
        self.eight ^= eight

    def at(self, places: np.ndarray | slice, length: int) -> np.ndarray:
        """Of `length` (8 to 256) bytes from each place on, all of them counted."""
        factors = np.random.default_rng(length).integers(1, 1 << 63, length // 8 + 1).astype(np.uint64) | np.uint64(1)
        offsets = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
        total = None
        for offset, factor in zip(offsets, factors, strict=False):
            part = self.eight[places.start + offset : places.stop + offset] if isinstance(places, slice) else self.eight[places + offset]
            if total is None:
                total = part * factor
            else:
                total += part * factor
        return mixed(total)


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by minima of 2, 4, 8... neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def cover_samples(data: np.ndarray, places: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each sample of the texts that lie between the places in data: which text, sample hash, segment hash, first window, number of windows."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, NONE, NONE, none, none
    hasher = Hasher(data)
    grams = hasher.at(slice(0, len(data) - gram + 1), gram)
    bits = np.uint64(max(1, int(len(data)).bit_length()))
    low = sliding_minimum((grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64), length - gram + 1)
    low &= np.uint64((1 << int(bits)) - 1)
    edge, inside = np.ones(len(low), bool), np.ones(len(low), bool)
    edge[1:] = low[1:] != low[:-1]
    for end in places[1:-1].tolist():  # windows that reach into the next text are none
        inside[max(0, end - length + 1) : end] = False
        edge[end : end + 1] = True
    first, stops = np.flatnonzero(edge & inside), np.append(np.flatnonzero(edge | ~inside), len(low))
    count = stops[np.searchsorted(stops, first, side="right")] - first
    sample = low[first].astype(np.int64)
    shape = ((count << 16) | (sample - first)).astype(np.uint64)
    segment = mixed(hasher.at(first, length) * np.uint64(3) + hasher.at(first + count - 1, length) + mixed(shape))
    own = np.searchsorted(places, first, side="right") - 1
    return own, grams[sample], segment, first - places[own], count


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of binary values without nulls, and the places where values begin and the last ends."""
    places = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[places[0] : places[-1]]
    return data, places - places[0]


def _pieces(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of about so many bytes, with _flat() of their column data."""
    for batch in batches:
        at, places = 0, _flat(batch.column("data"))[1] if batch.num_rows else None
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(places, places[at] + size, side="right")) - 1)
            piece = batch.slice(at, to - at)
            yield piece, *_flat(piece.column("data"))
            at = to


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc", F.col("text").cast("binary").alias("data"))


def _buckets(docs: DataFrame) -> int:
    """So many that a bucket has the samples of about 1000 documents."""
    return max(1024, docs.count() // 1000)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Hashes of samples are minima; mixed anew, they fill all buckets alike."""
    return (mixed(hashes) // np.uint64(-(-(1 << 64) // buckets))).astype(np.int64)


def _span(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """First window and number of windows (under 2**16) as one integer."""
    return (first.astype(np.int64) << 16) | n


def _ramp(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _ranked(first: np.ndarray, second: np.ndarray | None, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of those whose first key occurs twice or more: which, in order of both keys, doc and place; where a first key begins; where both keys do; how many second keys the first has."""
    order = np.argsort(first)
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = first[order[1:]] == first[order[:-1]]
    at = order[same[1:] | same[:-1]]
    at = at[np.lexsort((place[at], doc[at], *([] if second is None else [second[at]]), first[at]))]
    if not len(at):
        return at, same[:0], same[:0], at
    opens = np.ones(len(at), bool)
    opens[1:] = first[at[1:]] != first[at[:-1]]
    begins = opens.copy()
    if second is not None:
        begins[1:] |= second[at[1:]] != second[at[:-1]]
    group = np.cumsum(opens) - 1
    return at, opens, begins, np.bincount(group[begins])[group]


def _packed(kind: int, bucket: np.ndarray, hashes: np.ndarray, segment: np.ndarray, doc: np.ndarray, span: np.ndarray, wide: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """A row a run of one bucket; wide: how many hashes a span has, if not one."""
    if not len(bucket):
        return
    edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    arrays = [pa.array(bucket[edges[:-1]].astype(np.int32)), pa.array(np.full(len(edges) - 1, kind, np.int8))]
    for name, column in zip(NUMBERS, (hashes, segment, doc, span), strict=True):
        places = np.append(0, np.cumsum(wide))[edges] if name == "hash" and wide is not None else edges
        places = np.minimum(places, len(column)) * 8
        arrays.append(pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(column))]))
    yield pa.RecordBatch.from_arrays(arrays, ["bucket", "kind", *NUMBERS])


def _gone(doc: np.ndarray, span: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Spans that start earlier, dealt out in any way. Neighbours become one, up to 256 of them."""
    if not len(doc):
        return
    order = np.lexsort((span, doc))
    doc, first, n = doc[order], span[order] >> 16, span[order] & 0xFFFF
    edge = np.ones(len(doc), bool)
    edge[1:] = (doc[1:] != doc[:-1]) | (first[1:] != first[:-1] + n[:-1])
    begin = np.flatnonzero(edge)
    edge |= (np.arange(len(doc)) - begin[np.cumsum(edge) - 1]) % 256 == 0
    begin = np.flatnonzero(edge)
    doc, span = doc[begin], _span(first[begin], np.add.reduceat(n, begin))
    yield from _packed(GONE, (np.arange(len(doc)) // 4096 + int(first[0])) % buckets, NONE, NONE, doc, span)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, list[np.ndarray]]]:
    """Of rows in order of bucket and kind: each bucket's numbers by kind."""
    held: dict[int, list[list[bytes]]] = {}
    last = None

    def whole() -> dict[int, list[np.ndarray]]:
        return {kind: [np.frombuffer(b"".join(parts), t) for parts, t in zip(columns, NUMBERS.values(), strict=True)] for kind, columns in held.items()}

    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, kind = (batch.column(k).to_numpy() for k in range(2))
        flat = [_flat(batch.column(name)) for name in NUMBERS]
        edges = [0, *(np.flatnonzero((np.diff(bucket) != 0) | (np.diff(kind) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and bucket[a] != last:
                yield whole()
                held = {}
            last = bucket[a]
            columns = held.setdefault(int(kind[a]), [[] for _ in NUMBERS])
            for parts, (data, places) in zip(columns, flat, strict=True):
                parts.append(data[places[a] : places[b]].tobytes())
    if held:
        yield whole()


def _found(kind: int, doc: np.ndarray, span: np.ndarray, key: np.ndarray | None = None) -> pa.RecordBatch:
    keys = pa.nulls(len(doc), pa.int64()) if key is None else pa.array(key.view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int8)), pa.array(doc), pa.array(span), keys], ["kind", "doc", "span", "key"])


def _in_buckets(dealt: DataFrame) -> DataFrame:
    return dealt.repartition(F.col("bucket")).sortWithinPartitions("bucket", "kind")


def segments(spark: SparkSession, docs: DataFrame, length: int, gram: int) -> DataFrame:
    """kind, doc, span, key of segments: GONE; OPEN, with their sample; LATE, of a sample in many segments, with their class."""
    buckets, hot = _buckets(docs), HOT

    def sent(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        sample, segment, doc, span = (np.concatenate(parts) for parts in zip(*held, strict=True))
        at, opens, begins, classes = _ranked(sample, segment, doc, span)
        yield from _gone(doc[at[~begins]], span[at[~begins]], buckets)
        late, marks = at[begins & (classes > hot)], at[opens & (classes > hot)]
        yield from _packed(LATE, np.sort(_bucket(sample[late], buckets)), mixed(sample[late]) + segment[late], NONE, doc[late], span[late])
        rest = np.ones(len(sample), bool)
        rest[at[~begins]] = rest[late] = False
        rest = np.append(np.flatnonzero(rest), marks)
        span[marks] = 0  # no windows: the mark of a sample in many segments
        bucket = _bucket(sample[rest], buckets)
        order = np.argsort(bucket)
        rest = rest[order]
        yield from _packed(ASKED, bucket[order], sample[rest], segment[rest], doc[rest], span[rest])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for piece, data, places in _pieces(batches):
            own, sample, segment, first, n = cover_samples(data, places, length, gram)
            held.append((sample, segment, piece.column("doc").to_numpy()[own], _span(first, n)))
            size += len(own)
            if size >= FLUSH:
                yield from sent(held)
                held, size = [], 0
        if size:
            yield from sent(held)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kinds in _by_bucket(batches):
            if GONE in kinds:
                yield _found(GONE, *kinds[GONE][2:])
            if LATE in kinds:
                yield _found(LATE, *kinds[LATE][2:], kinds[LATE][0])
            if ASKED in kinds:
                sample, segment, doc, span = kinds[ASKED]
                if (marks := span == 0).any():
                    hot = np.isin(sample, sample[marks])
                    late = hot & ~marks
                    yield _found(LATE, doc[late], span[late], mixed(sample[late]) + segment[late])
                    sample, segment, doc, span = (x[~hot] for x in (sample, segment, doc, span))
                at, _, begins, classes = _ranked(sample, segment, doc, span)
                yield _found(GONE, doc[at[~begins]], span[at[~begins]])
                heads = at[begins & (classes > 1)]
                yield _found(OPEN, doc[heads], span[heads], sample[heads])

    return written(spark, _in_buckets(_keyed(docs).mapInArrow(deal, DEALT)).mapInArrow(judge, FOUND))


def windows(spark: SparkSession, docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """doc, span of the windows that also start earlier in the wanted segments; wanted: doc, span, key (null: the windows are dealt out by their own hashes)."""
    buckets = _buckets(docs)

    def sent(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        hashes, doc, span, key, late = (np.concatenate(parts) for parts in zip(*held, strict=True))
        n = span & 0xFFFF
        begin = np.cumsum(n) - n
        bucket = _bucket(key, buckets)
        heads = np.flatnonzero(~late)
        heads = heads[np.argsort(bucket[heads])]
        at = np.repeat(begin[heads], n[heads]) + _ramp(n[heads])
        yield from _packed(OPEN, bucket[heads], hashes[at], NONE, doc[heads], span[heads], n[heads])
        heads = np.flatnonzero(late)
        at = np.repeat(begin[heads], n[heads]) + _ramp(n[heads])
        hashes, doc, span = hashes[at], np.repeat(doc[heads], n[heads]), _span(np.repeat(span[heads] >> 16, n[heads]) + _ramp(n[heads]), 1)
        at, _, begins, _ = _ranked(hashes, None, doc, span)
        yield from _gone(doc[at[~begins]], span[at[~begins]], buckets)
        rest = np.ones(len(hashes), bool)
        rest[at[~begins]] = False
        rest = np.flatnonzero(rest)
        bucket = _bucket(hashes[rest], buckets)
        order = np.argsort(bucket)
        rest = rest[order]
        yield from _packed(OPEN, bucket[order], hashes[rest], NONE, doc[rest], span[rest])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for piece, data, places in _pieces(batches):
            many, spans = piece.column("spans").value_lengths().to_numpy(), piece.column("spans").flatten()
            span, key = spans.field(0).to_numpy(), spans.field(1)
            own, n = np.repeat(np.arange(piece.num_rows), many), span & 0xFFFF
            hashes = Hasher(data).at(np.repeat(places[own] + (span >> 16), n) + _ramp(n), length)
            late = key.is_null().to_numpy(zero_copy_only=False)
            held.append((hashes, piece.column("doc").to_numpy()[own], span, key.fill_null(0).to_numpy().view(np.uint64), late))
            size += len(hashes)
            if size >= FLUSH:
                yield from sent(held)
                held, size = [], 0
        if size:
            yield from sent(held)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kinds in _by_bucket(batches):
            if GONE in kinds:
                yield _found(GONE, *kinds[GONE][2:])
            if OPEN in kinds:
                hashes, _, doc, span = kinds[OPEN]
                n = span & 0xFFFF
                own, place = np.repeat(np.arange(len(n)), n), np.repeat(span >> 16, n) + _ramp(n)
                at, _, begins, _ = _ranked(hashes, None, doc[own], place)
                gone = np.sort(at[~begins])
                edge = np.ones(len(gone), bool)
                edge[1:] = (np.diff(gone) != 1) | (np.diff(own[gone]) != 0)
                begin = np.flatnonzero(edge)
                yield _found(GONE, doc[own[gone[begin]]], _span(place[gone[begin]], np.diff(np.append(begin, len(gone)))))

    spans = wanted.groupBy("doc").agg(F.collect_list(F.struct("span", "key")).alias("spans"))
    dealt = _keyed(docs).join(spans, "doc").select("doc", "data", "spans").mapInArrow(deal, DEALT)
    return written(spark, _in_buckets(dealt).mapInArrow(judge, FOUND)).select("doc", "span")


def repeated_spans(spark: SparkSession, docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc, spans: the windows that also start earlier, as one integer each for a first window and their number, see _span(); docs: doc (key of a row), text."""
    found = segments(spark, docs, length, gram)
    earliest = F.row_number().over(Window.partitionBy("key").orderBy("doc", "span")) == 1
    late = written(spark, found.filter(found.kind == LATE).select("doc", "span", earliest.alias("earliest")))
    open_ = found.filter(found.kind == OPEN).select("doc", "span", "key").unionByName(late.filter("earliest").select("doc", "span", F.lit(None).cast("long").alias("key")))
    single = windows(spark, docs, open_, length)
    gone = found.filter(found.kind == GONE).select("doc", "span").unionByName(late.filter("NOT earliest").select("doc", "span")).unionByName(single)
    return gone.groupBy("doc").agg(F.collect_list("span").alias("spans"))


REMOVED = pa.struct([("first", pa.int64()), ("n", pa.int64())])


def dedup_substrings(spark: SparkSession, docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, data (the bytes that stay), removed (runs: first, n)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, data, places in _pieces(batches, CUT):
            many, span = piece.column("spans").value_lengths().fill_null(0).to_numpy(), piece.column("spans").flatten().to_numpy()
            first = np.repeat(places[:-1], many) + (span >> 16)
            step = np.zeros(len(data) + 1, np.int32)
            np.add.at(step, first, 1)
            np.add.at(step, first + (span & 0xFFFF) + length - 1, -1)
            gone = np.cumsum(step[:-1], dtype=np.int32) > 0
            turns = np.zeros(len(data) + 1, bool)
            turns[1:-1] = gone[1:] != gone[:-1]
            turns[places] = True  # runs end with their documents
            turns = np.flatnonzero(turns)
            runs = np.flatnonzero(gone[turns[:-1]])
            begin, n = turns[runs], turns[runs + 1] - turns[runs]
            own = np.searchsorted(places, begin, side="right") - 1
            stay = np.append(0, np.cumsum(~gone))[places].astype(np.int32)
            left = pa.Array.from_buffers(pa.binary(), piece.num_rows, [None, pa.py_buffer(stay), pa.py_buffer(data[~gone])])
            removed = pa.StructArray.from_arrays([pa.array(begin - places[own]), pa.array(n)], fields=list(REMOVED))
            edges = pa.array(np.searchsorted(own, np.arange(piece.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(np.diff(places)), left, pa.ListArray.from_arrays(edges, removed)], ["doc_id", "n_bytes", "data", "removed"])

    docs = with_row_keys(documents(docs, "doc_id", "text"))
    found = repeated_spans(spark, docs, length, gram)
    keyed = docs.select("doc", "doc_id", F.col("text").cast("binary").alias("data"))
    return keyed.join(found, "doc", "left").select("doc_id", "data", "spans").mapInArrow(cut, "doc_id long, n_bytes long, data binary, removed array<struct<first:long,n:long>>")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(spark, table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["n"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("data", 256).alias("kept_sha256"))
