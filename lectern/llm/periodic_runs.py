"""Periodic runs of words: stretches that repeat one and the same sequence of words, found by comparing a text with itself at every lag.

A run is a stretch of words of smallest period q, at least `min_exp` periods and `min_length` words long, that no
neighbouring word extends. Words become whole numbers, and the array of a text is compared with itself shifted by each
lag q up to n / min_exp; a run is a stretch of equal places that is long enough.

- The comparison is vectorised over texts and lags. Texts of a batch are laid end to end, longest first; equal words of
  different texts have different numbers, so nothing matches across texts. A block of neighbouring lags is one matrix.
- A stretch of m equal places holds four evenly spaced ones at a step of m // 4. So a lag that isn't short is compared at
  every (m // 4)-th place first, where m is the shortest stretch that counts; this loses none, and all lags together cost
  about 4 n log n comparisons. Where four in a row are equal, the stretch is measured in full at that lag.
- A stretch found at lag q may have a smaller period, which then divides q; the run is the same stretch, and it is
  recorded with its smallest period. Later lags that are multiples of it skip what it covers.
- Texts of over `long_words` words are dealt out by ranges of lags of about equal work, so that many machines scan one
  text; their runs are put together by text and row.

Defined results: null text, or text without words, has no runs. Rows of the same doc_id, or of none, are documents of
their own. An empty table gives an empty result; further columns are ignored. A long text is held whole by a task, with
16 bytes a word; a batch of texts takes a bounded number of bytes more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import documents, let, table, words, written

#: Lags below this are compared place by place. Lags of one matrix at most, and bytes of texts laid end to end (one text at least).
SHORT_LAG, LAGS, TEXT_BYTES = 16, 256, 8 << 20
#: Texts of more words are dealt out by ranges of lags, of so much work each: compared places, and LAG_WORK for a lag.
LONG_WORDS, RANGE_WORK, LAG_WORK = 16_384, 1_000_000, 100

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS = "array<struct<start: long, length: long, period: long>>"


def word_ids(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of all texts, a number for each of them (equal for equal words), and the place where each text's words begin."""
    parts = pc.ascii_split_whitespace(texts)
    flat, owner = parts.flatten(), pc.list_parent_indices(parts)
    solid = pc.greater(pc.binary_length(flat), 0)
    flat, owner = flat.filter(solid), owner.filter(solid).to_numpy()
    starts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return flat, flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), starts


def shortest(lag: int, min_length: int, min_exp: int) -> int:
    """Equal places at this lag that the shortest run has."""
    return max(min_length, min_exp * lag) - lag


class Scan:
    """Runs of texts laid end to end: a has the words' numbers, none of which occurs in two texts; sizes falls."""

    def __init__(self, a: np.ndarray, sizes: np.ndarray, min_length: int, min_exp: int) -> None:
        self.a, self.sizes, self.min_length, self.min_exp = a, sizes, min_length, min_exp
        self.ends = np.cumsum(sizes)
        self.runs: list[tuple[int, int, int]] = []

    def stretch(self, at: int, lag: int, end: int) -> tuple[int, int]:
        """First and last place of equality around `at`, where it holds; places end at `end`."""
        a, bounds = self.a, []
        for step in (-1, 1):
            here, size = at, 64
            while True:
                low, high = (max(0, here - size), here) if step < 0 else (here + 1, min(end - lag, here + 1 + size))
                unlike = np.flatnonzero(a[low:high] != a[low + lag : high + lag])
                if len(unlike):
                    bounds.append(low + unlike[-1] + 1 if step < 0 else low + unlike[0] - 1)
                    break
                if low >= high or (low == 0 if step < 0 else high == end - lag):
                    bounds.append(low if step < 0 else high - 1)
                    break
                here, size = (low, 2 * size) if step < 0 else (high - 1, 2 * size)
        return int(bounds[0]), int(bounds[1])

    def smallest(self, start: int, lag: int) -> int:
        """Smallest period of the stretch that begins at start and has the period lag at least twice over."""
        a = self.a
        for d in range(1, int(lag**0.5) + 1):
            if lag % d == 0 and np.array_equal(a[start : start + lag - d], a[start + d : start + lag]):
                return d
        for d in range(int(lag**0.5), 0, -1):
            if lag % d == 0 and np.array_equal(a[start : start + lag - lag // d], a[start + lag // d : start + lag]):
                return lag // d
        return lag

    def one(self, lag: int) -> None:
        """One short lag, place by place."""
        a, least = self.a[: self.reach(lag)], shortest(lag, self.min_length, self.min_exp)
        same = np.zeros(max(0, len(a) - lag) + 2, np.int8)
        same[1:-1] = a[lag:] == a[:-lag]
        edges = np.flatnonzero(np.diff(same))
        for first, after in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if after - first >= least:
                self.runs.append((first, after + lag, self.smallest(first, lag)))

    def reach(self, lag: int) -> int:
        """Words of the texts that are long enough for a run of this lag."""
        texts = int(np.searchsorted(-self.sizes, -max(self.min_length, self.min_exp * lag), side="right"))
        return int(self.ends[texts - 1]) if texts else 0

    def block(self, low: int, high: int) -> None:
        """Lags low to high - 1: a matrix of every step-th place with all lags, then in full where four places in a row are equal."""
        n = self.reach(low)
        if n <= low:
            return
        step = max(1, min(shortest(q, self.min_length, self.min_exp) for q in range(low, high)) // 4)
        a = self.a[:n]
        at = np.arange(0, n - low, step)
        padded = np.concatenate([a[low:], np.full(high - low, -1)])
        same = sliding_window_view(padded, high - low)[at] == a[at, None]
        row, lag = np.nonzero(same[:-3] & same[1:-2] & same[2:-1] & same[3:])
        place, lag = at[row], lag + low
        order = np.lexsort((place, lag))
        place, lag = place[order], lag[order]
        for start, end, period in self.runs if len(place) else ():
            if end - start >= self.min_exp * low:
                place, lag = self.uncovered(place, lag, start, end, period)
        k = 0
        while k < len(place):
            i, q = int(place[k]), int(lag[k])
            first, last = self.stretch(i, q, n)
            if last - first + 1 >= shortest(q, self.min_length, self.min_exp):
                self.runs.append((first, last + q + 1, self.smallest(first, q)))
                place, lag, k = *self.uncovered(place[k:], lag[k:], *self.runs[-1]), 0
            else:
                while k < len(place) and lag[k] == q and place[k] <= last:
                    k += 1

    @staticmethod
    def uncovered(place: np.ndarray, lag: np.ndarray, start: int, end: int, period: int) -> tuple[np.ndarray, np.ndarray]:
        left = ~((place >= start) & (place + lag < end) & (lag % period == 0))
        return place[left], lag[left]

    def lags(self, low: int, high: int) -> list[tuple[int, int, int]]:
        """Start, end and period of all runs of lags low to high - 1, in the order of their starts and periods."""
        high = min(high, int(self.sizes.max(initial=0)) // self.min_exp + 1)
        while low < high:
            top = min(high, low + (1 if low < SHORT_LAG else min(LAGS, low // 4)))
            if low < SHORT_LAG:
                self.one(low)
            else:
                self.block(low, top)
            low = top
        return sorted(set(self.runs), key=lambda r: (r[0], r[2]))


def batch_runs(texts: pa.Array, lags: tuple[int, int] | None, min_length: int, min_exp: int) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]:
    """Words of all texts, where each text's words begin, whether a word is repeated by a run, and each text's runs (RUN)."""
    flat, ids, starts = word_ids(texts)
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    owner = np.repeat(np.arange(len(texts)), sizes)
    ids += owner * (int(ids.max(initial=0)) + 1)
    places = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in order]) if len(order) else np.zeros(0, np.int64)
    scan = Scan(ids[places], sizes[order], min_length, min_exp)
    found = scan.lags(*(lags or (1, 1 << 62)))
    change, held = np.zeros(len(ids) + 1, np.int64), [[] for _ in range(len(texts))]
    for first, end, period in found:
        k = int(order[np.searchsorted(scan.ends, first, side="right")])
        at = int(places[first])  # a text's words keep their order
        change[at + period] += 1
        change[at + end - first] -= 1
        held[k].append({"start": at - int(starts[k]), "length": end - first, "period": period})
    return flat, starts, np.cumsum(change)[:-1] > 0, pa.array(held, pa.list_(RUN))


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """batch in pieces of TEXT_BYTES of the column, one row at least."""
    sizes, at, held = pc.binary_length(batch.column(column)).to_pylist(), 0, 0
    for k, size in enumerate(sizes):
        if k > at and held + size > TEXT_BYTES:
            yield batch.slice(at, k - at)
            at, held = k, 0
        held += size
    if at < batch.num_rows:
        yield batch.slice(at)


def _joined(flat: pa.Array, starts: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The words to keep of each text, joined by one space."""
    offsets = np.concatenate([[0], np.cumsum(keep)])[starts]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat.filter(pa.array(keep))), " ")


def lag_ranges(n: int, min_exp: int, work: int) -> list[tuple[int, int]]:
    """Ranges of the lags of n words, of about equal work."""
    lags = np.arange(1, n // min_exp + 1)
    reached = np.cumsum(n / np.maximum(1, lags * (min_exp - 1) // 4) + LAG_WORK)
    cuts = np.searchsorted(reached, np.arange(1, int(reached[-1] / work) + 1 if len(lags) else 0) * work) + 2
    edges = sorted({1, *(int(c) for c in cuts if c <= len(lags)), len(lags) + 1})
    return list(zip(edges, edges[1:], strict=False))


def periodic_runs(
    spark: SparkSession, docs: DataFrame, min_length: int = 12, min_exp: int = 2, long_words: int = LONG_WORDS, range_work: int = RANGE_WORK
) -> DataFrame:
    """Per row of docs: doc_id, n_words, runs (start, length and period in words, by start and period), text (words that no run repeats, joined by one space).

    A word is left out of text if a run contains it after that run's first `period` words.
    """

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (s for b in batches for s in _slices(b, 1)):
            flat, starts, repeated, runs = batch_runs(part.column(1), None, min_length, min_exp)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(starts)), runs, _joined(flat, starts, ~repeated)], names)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                for low, high in lag_ranges(len(text.as_py().encode().split()), min_exp, range_work):
                    yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (key.as_py(), low, high)), pa.array([text.as_py()])], ["key", "low", "high", "text"])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, low, high, text in zip(*(batch.column(i) for i in range(4)), strict=True):
                runs = batch_runs(pa.array([text.as_py()]), (low.as_py(), high.as_py()), min_length, min_exp)[3]
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], pa.int64()), runs], ["key", "runs"])

    def collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.slice(k, 1)
                flat, ids, starts = word_ids(part.column(1))
                keep = np.ones(len(ids), bool)
                for r in part.column(2)[0].as_py() or ():
                    keep[r["start"] + r["period"] : r["start"] + r["length"]] = False
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(ids)], pa.int64()), part.column(2), _joined(flat, starts, keep)], names)

    names, schema = ["doc_id", "n_words", "runs", "text"], f"doc_id long, n_words long, runs {RUNS}, text string"
    docs = documents(docs, "doc_id", "text")
    is_long = F.octet_length("text") >= 2 * long_words  # a word takes a byte and a blank at least
    rows = docs.filter(~is_long).mapInArrow(short, schema)
    long_ = written(spark, docs.filter(is_long).withColumn("key", F.monotonically_increasing_id()))
    parts = long_.select("key", "text").mapInArrow(ranges, "key long, low long, high long, text string").repartition("key", "low")
    found = parts.mapInArrow(scanned, f"key long, runs {RUNS}").select("key", F.inline("runs")).distinct()
    order = F.struct("start", "period", "length")
    found = found.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(order)), lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"))
    full = long_.join(found, "key", "left").select("doc_id", "text", F.coalesce("runs", F.array().cast(RUNS)).alias("runs"))
    return rows.union(full.mapInArrow(collapsed, schema))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text; of documents whose hash h of the doc_id ends in 0, words from the a-th on become repeats of p words (see the README)."""
    docs = documents(docs, "doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(w):
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = F.floor((n - a) / (F.pmod(g, F.lit(8)) + 3)) + 1
        return F.when(n > 0, F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + F.pmod(i - a, p)).cast("int")))), " "))

    chosen = h % 10 == 0
    return docs.select("doc_id", F.when(chosen, F.coalesce(let(words("text"), planted), F.lit(""))).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(spark, with_planted_runs(table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.element_at(F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("x"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), 1)
    found = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


#: Every pair of equal words of a document at a lag up to half its words; stretches of places that follow each other are runs.
OP12_SQL = r"""
WITH crc AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS entry
  FROM range(256) r(i)),
given AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, entry[(xor(c, b) & 255) + 1]))) AS h
  FROM documents, crc),
sized AS (SELECT doc_id, w, h, h // 10 AS g, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a FROM given),
planted AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) ELSE w END AS w
  FROM sized),
word AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS x FROM planted WHERE n >= 12),
same AS (SELECT p.doc_id, p.i AS i, q.i - p.i AS lag FROM word p JOIN word q ON p.doc_id = q.doc_id AND p.x = q.x AND q.i > p.i AND 2 * (q.i - p.i) <= p.n),
stretch AS (
  SELECT doc_id, lag, min(i) AS start, count(*) + lag AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS island FROM same) GROUP BY doc_id, lag, island
  HAVING count(*) + lag >= greatest(12, 2 * lag)),
run AS (SELECT doc_id, start, length, min(lag) AS period FROM stretch GROUP BY doc_id, start, length),
digest AS (
  SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256,
    arg_min(struct_pack(start := start, length := length, period := period), (-length, start, period)) AS best
  FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT w.doc_id, string_agg(x, ' ' ORDER BY w.i) AS text FROM (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS x FROM planted) w ANTI JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id)
SELECT p.doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM planted p LEFT JOIN digest d ON d.doc_id = p.doc_id LEFT JOIN kept k ON k.doc_id = p.doc_id
"""
