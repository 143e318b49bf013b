"""Line dedup by winnowing over line hashes.

A document is the sequence of its lines that have a word, each as a 64-bit hash. In every window of `run` lines the
line of least hash (of equals the last) is the window's fingerprint, so that a run of `run` lines or more that two
places share is sure to share a fingerprint with the same place in the run. Of the fingerprints only those that are
possibly repeated (by a Bloom filter) go on, with the lines on both sides that their windows reach. Positions are joined
by fingerprint and by their place in the window: for each number of lines before it, the match is extended both ways to
`run` lines. Places of one fingerprint whose extension is equal meet by a hash of it, not in pairs, so that a line in all
documents makes no square. A window that stands earlier too - in a smaller doc_id, or before in the same document - is a
later repeated run, and its lines are deleted; the first occurrence stays. Windows are told apart by two hashes of
64 bits, the fingerprint's and the extension's.

With `words`, one or two neighbouring lines of so many words or more in all are windows of their own, each its own
fingerprint, so that a long passage counts as a repeat however few lines it has.

Defined results: null text is empty. Lines without a word are never deleted and don't break a run; a line is what
lies between two newlines and is compared as it is. A null doc_id is the last. Rows of the same doc_id, or of none, are
documents of their own in the order of the input. Rows of an empty table: none; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import bounded, documents, table, with_hot_keys, with_row_keys, written
from lectern.llm.exact_dedup import possibly_repeated

SPACES = " \t\n\x0b\x0c\r"
#: Words from which one or two lines are a run of their own in op9_long_line_dedup.
LONG = 50
#: Tell the fingerprints of windows of one and two lines apart from those of runs.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def fingerprints(docs: DataFrame, run: int, words: int | None) -> DataFrame:
    """doc, fingerprint, first (number of the first window that it stands for), size (lines of a window), lines (hashes of all lines in these windows)."""

    def winnow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            doc, mark, first, size, lines = [], [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                solid = [x for x in text.as_py().split("\n") if x.strip(SPACES)]
                h = np.array([xxh3_64_intdigest(x) for x in solid], np.uint64)
                if words:
                    n = np.array([len(x.encode().split()) for x in solid], np.int64)  # of bytes: ASCII white space
                    for k in range(1, min(run, 3)):
                        if len(h) < k:
                            continue
                        short = np.lib.stride_tricks.sliding_window_view(h, k)
                        long_ = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(n, k).sum(axis=1) >= words)
                        doc += [i] * len(long_)
                        mark.append((short[long_] * FACTORS[:k]).sum(axis=1, dtype=np.uint64).view(np.int64))
                        first.append(long_)
                        size += [k] * len(long_)
                        lines += list(short[long_].view(np.int64))
                if len(h) < run:
                    continue
                windows = np.lib.stride_tricks.sliding_window_view(h, run)
                at = np.arange(len(windows)) + run - 1 - windows[:, ::-1].argmin(axis=1)
                starts = np.flatnonzero(np.diff(at, prepend=-1))
                ends = np.append(starts[1:], len(at)) + run - 1
                h = h.view(np.int64)
                doc += [i] * len(starts)
                size += [run] * len(starts)
                mark.append(h[at[starts]])
                first.append(starts)
                lines += [h[a:b] for a, b in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array(doc, pa.int64()), pa.array(np.concatenate(mark) if mark else [], pa.int64()), pa.array(np.concatenate(first) if first else [], pa.int64()), pa.array(size, pa.int32()),
                pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lines)]), pa.int32()), pa.array(np.concatenate(lines) if lines else [], pa.int64())),
            ], ["doc", "fingerprint", "first", "size", "lines"])

    return docs.select("doc", "text").mapInArrow(winnow, "doc long, fingerprint long, first long, size int, lines array<long>")


def repeated_windows(spark: SparkSession, docs: DataFrame, run: int, words: int | None) -> DataFrame:
    """doc, starts: for each document with later repeated runs, first line and size of the windows that repeat earlier ones."""
    marks = written(spark, fingerprints(docs, run, words))
    suspects = possibly_repeated(marks, "fingerprint", marks.count()).filter("maybe")
    windows = F.transform(F.sequence(F.lit(1), F.size("lines") - F.col("size") + 1), lambda i: F.xxhash64(F.slice("lines", i, F.col("size"))))
    each = suspects.select("doc", "first", "size", "fingerprint", F.posexplode(windows).alias("k", "extension"))
    each = written(spark, each.select("doc", "size", F.struct("fingerprint", "extension").alias("window"), (F.col("first") + F.col("k")).alias("at")))
    known = each.groupBy("window").agg(F.min(F.struct("doc", "at")).alias("earliest"), F.count("*").alias("n")).filter("n > 1")
    later = with_hot_keys(each, known, "window", "n", each.count()).filter(F.struct("doc", "at") > F.col("earliest"))
    return later.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("at", "size"))).alias("starts"))


def dedup_lines(spark: SparkSession, docs: DataFrame, run: int = 3, words: int | None = None) -> DataFrame:
    """Per row of docs: doc_id, text (what stays), n_lines, removed (runs of deleted lines: first, count).

    Both numbers in removed count lines with a word. A document's windows are at most as many as its lines,
    with words three times as many.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, runs = [], [], []
            for text, starts in zip(batch.column(1), batch.column(2), strict=True):
                lines = text.as_py().split("\n")
                solid = [k for k, x in enumerate(lines) if x.strip(SPACES)]
                gone = np.zeros(len(solid) + 1, bool)
                for s in starts.as_py():
                    gone[s["at"] : s["at"] + s["size"]] = True
                edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0)).reshape(-1, 2)
                out = {solid[k] for k in np.flatnonzero(gone)}
                texts.append("\n".join(x for k, x in enumerate(lines) if k not in out))
                counts.append(len(solid))
                runs.append([{"first": int(a), "count": int(b - a)} for a, b in edges])
            kind = pa.list_(pa.struct([("first", pa.int64()), ("count", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(runs, kind)], ["doc_id", "text", "n_lines", "removed"])

    keyed = with_row_keys(documents(docs, "doc_id", "text"))
    found = written(spark, repeated_windows(spark, keyed, run, words))
    size = found.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("starts")), F.lit(0)).alias("w")).first()
    found = bounded(found, size.n + size.w, 40)
    changed = keyed.join(found, "doc").select("doc_id", "text", "starts").mapInArrow(cut, "doc_id long, text string, n_lines long, removed array<struct<first:long,count:long>>")
    count = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long")
    same = keyed.join(found.select("doc"), "doc", "left_anti").select("doc_id", "text", count.alias("n_lines"), F.array().cast("array<struct<first:long,count:long>>").alias("removed"))
    return changed.unionByName(same)


def _summary(out: DataFrame) -> DataFrame:
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["count"])
    return out.select("doc_id", "n_lines", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_runs"), F.sha2("text", 256).alias("kept_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three lines or more, of any length."""
    return _summary(dedup_lines(spark, table(spark, sf_dir, "documents")))


def op9_long_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three lines or more, and one or two lines of LONG words or more."""
    return _summary(dedup_lines(spark, table(spark, sf_dir, "documents"), words=LONG))


OP9_SQL = """
WITH l AS (SELECT doc_id, k, line FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents)),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS p FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
w AS (SELECT doc_id, p, line AS a, lead(line) OVER d AS b, lead(line, 2) OVER d AS c FROM s WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS nth FROM w WHERE c IS NOT NULL),
g AS (SELECT DISTINCT doc_id, p + d AS p FROM r, (VALUES (0), (1), (2)) AS t(d) WHERE nth > 1),
j AS (SELECT l.doc_id, l.k, l.line, s.p, g.p IS NOT NULL AS gone FROM l LEFT JOIN s USING (doc_id, k) LEFT JOIN g ON g.doc_id = l.doc_id AND g.p = s.p),
e AS (SELECT doc_id, p, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS begins FROM j WHERE p IS NOT NULL),
n AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_runs FROM e GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '') AS kept FROM j GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs, sha256(kept) AS kept_sha256
FROM t LEFT JOIN n USING (doc_id)
"""

OP9_LONG_SQL = f"""
WITH l AS (SELECT doc_id, k, line FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents)),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS p, len(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS n FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
w AS (SELECT doc_id, p, n, line AS a, lead(line) OVER d AS b, lead(line, 2) OVER d AS c, lead(n) OVER d AS m FROM s WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
v AS (SELECT doc_id, p, 3 AS size, [a, b, c] AS x FROM w WHERE c IS NOT NULL UNION ALL SELECT doc_id, p, 2, [a, b] FROM w WHERE n + m >= {LONG} UNION ALL SELECT doc_id, p, 1, [a] FROM w WHERE n >= {LONG}),
r AS (SELECT doc_id, p, size, row_number() OVER (PARTITION BY x ORDER BY doc_id, p) AS nth FROM v),
g AS (SELECT DISTINCT doc_id, p + d AS p FROM r, (VALUES (0), (1), (2)) AS t(d) WHERE nth > 1 AND d < size),
j AS (SELECT l.doc_id, l.k, l.line, s.p, g.p IS NOT NULL AS gone FROM l LEFT JOIN s USING (doc_id, k) LEFT JOIN g ON g.doc_id = l.doc_id AND g.p = s.p),
e AS (SELECT doc_id, p, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS begins FROM j WHERE p IS NOT NULL),
n AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_runs FROM e GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '') AS kept FROM j GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs, sha256(kept) AS kept_sha256
FROM t LEFT JOIN n USING (doc_id)
"""
