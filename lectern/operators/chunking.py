"""Text to segments to overlapping chunks, back to text, and batches for a model."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import token_count

SIZE, OVERLAP = 1000, 200


def check_settings(size: int, overlap: int) -> None:
    """ING-03."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError(f"size must be positive and overlap within [0, size): {size}, {overlap}")


def chunks(segments: DataFrame, size: int = SIZE, overlap: int = OVERLAP, whole: bool = False) -> DataFrame:
    """ING-01, ING-02, ING-04: fixed windows over segments (document_id, segment_no, text), never across two of them.

    Offsets run over the whole document, with one place between segments. All in built-in expressions: the window
    starts are a sequence. Where a segment begins follows from the lengths of those before it, which are summed without
    their texts and joined back. whole: each document is one segment, so that nothing has to be summed and no text is shuffled.
    """
    check_settings(size, overlap)
    step = size - overlap
    n = F.length("text")
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)) * step
    rows = segments.filter(n > 0)
    if whole:
        rows = rows.withColumns({"base": F.lit(0).cast("long"), "first": F.lit(0).cast("long")})
    else:
        before = Window.partitionBy("document_id").orderBy("segment_no").rowsBetween(Window.unboundedPreceding, -1)
        summed = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long")
        places = rows.select("document_id", "segment_no", (n + 1).alias("places"), (last / step + 1).cast("long").alias("windows"))
        rows = rows.join(places.select("document_id", "segment_no", summed("places").alias("base"), summed("windows").alias("first")), ["document_id", "segment_no"])
    rows = rows.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(step).cast("long"))))
    text = F.substring(F.col("text"), (F.col("start") + 1).cast("int"), F.lit(size))
    index = (F.col("first") + F.expr(f"start DIV {step}")).cast("int")
    rows = rows.select("document_id", "segment_no", text.alias("chunk_text"), (F.col("base") + F.col("start")).alias("char_start"), index.alias("chunk_index"))
    rows = rows.withColumn("char_end", F.col("char_start") + F.length("chunk_text"))
    return rows.select("document_id", "segment_no", "chunk_text", "char_start", "char_end", "chunk_index", token_count(F.col("chunk_text")).alias("token_count"), F.sha2("chunk_text", 256).alias("content_hash"))


def restored(parts: DataFrame) -> DataFrame:
    """WIN-10: document_id, text put together from chunks: overlaps are cut, a gap of one place is a newline."""
    order = Window.partitionBy("document_id").orderBy("chunk_index")
    previous = F.lag("char_end").over(order)
    over = F.greatest(F.lit(0), F.coalesce(previous - F.col("char_start"), F.lit(0)))
    gap = F.when(F.col("char_start") - previous == 1, F.lit("\n")).otherwise(F.lit(""))
    rows = parts.withColumns({"over_": over, "gap_": gap}).withColumn("piece", F.concat("gap_", F.expr("substring(chunk_text, cast(over_ as int) + 1)")))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "piece"))), lambda x: x["piece"])
    return rows.groupBy("document_id").agg(F.array_join(texts, "").alias("text"))


def discontinuities(parts: DataFrame) -> DataFrame:
    """WIN-11: chunks that can't be put together, with the reason: INDEX or range wrong in itself (OFFSET), or a GAP to the one before.

    Indexes count from 0, the first chunk starts at 0, a range has the length of its text, chunks end later than the one
    before and leave one place between at most.
    """
    order = Window.partitionBy("document_id").orderBy("chunk_index")
    place, end = F.row_number().over(order) - 1, F.coalesce(F.lag("char_end").over(order), F.lit(0))
    rows = parts.select("document_id", "chunk_index", "char_start", "char_end", F.length("chunk_text").alias("size"), place.alias("place"), end.alias("before"))
    size = F.col("char_end") - F.col("char_start")
    wrong = (F.col("char_start") < 0) | (size <= 0) | (size != F.col("size")) | ((F.col("place") == 0) & (F.col("char_start") != 0))
    gap = (F.col("char_start") > F.col("before") + 1) | (F.col("char_end") <= F.col("before"))
    reason = F.when(F.col("chunk_index") != F.col("place"), "INDEX").when(wrong, "OFFSET").when(gap, "GAP")
    return rows.select("document_id", "chunk_index", reason.alias("reason")).filter("reason IS NOT NULL")


def plan_batches(parts: DataFrame, most: int = 4, most_chars: int = 4000, most_tokens: int = 900) -> DataFrame:
    """WIN-08, ING-05: batch_no of each chunk: batches fill in order until one of the limits would be passed.

    The sums start anew with each batch, so this is no window but a sorted scan; only the running sums are carried from batch to batch.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        document, number, n, chars, tokens = None, 0, 0, 0, 0
        for batch in batches:
            out = []
            for d, c, t in zip(batch.document_id, batch.chars, batch.tokens, strict=True):
                if d != document:
                    document, number, n, chars, tokens = d, 0, 0, 0, 0
                elif n + 1 > most or chars + c > most_chars or tokens + t > most_tokens:
                    number, n, chars, tokens = number + 1, 0, 0, 0
                n, chars, tokens = n + 1, chars + c, tokens + t
                out.append(number)
            yield pd.DataFrame({"document_id": batch.document_id, "chunk_index": batch.chunk_index, "batch_no": out})

    rows = parts.select("document_id", "chunk_index", F.length("chunk_text").alias("chars"), F.col("token_count").alias("tokens"))
    return rows.repartition("document_id").sortWithinPartitions("document_id", "chunk_index").mapInPandas(scan, "document_id long, chunk_index int, batch_no int")


def missing_embeddings(parts: DataFrame, vectors: DataFrame) -> DataFrame:
    """ING-12: chunks without a vector."""
    return parts.join(vectors, ["document_id", "chunk_index"], "left_anti")


def parse_text(files: DataFrame) -> DataFrame:
    """SRC-07: strict UTF-8 of `content` (binary): without a byte order mark, newlines as \\n; bad or blank files are dropped."""
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    text = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")
    return files.withColumn("text", text).filter(F.col("text").isNotNull() & F.col("text").rlike(r"\S"))


def garbled(text) -> object:
    """SRC-11: over one in twenty characters is the replacement character."""
    return (F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))) > F.length(text) * 0.05


def unindented(line: str) -> str | None:
    """The line behind at most three blanks, as block structure has it; None if it is indented further."""
    rest = line.lstrip(" ")
    return rest if len(line) - len(rest) <= 3 else None


def fence_of(line: str) -> tuple[str, str] | None:
    """The marks of a code fence - three or more back ticks or tildes - and what follows them."""
    rest = unindented(line) or ""
    if rest[:1] not in ("`", "~"):
        return None
    after = rest.lstrip(rest[0])
    size = len(rest) - len(after)
    return (rest[:size], after) if size >= 3 else None


def heading_of(line: str) -> tuple[int, str] | None:
    """Level and text of a heading that begins with one to six number signs and a blank; signs at its end, behind a blank, close it."""
    rest = unindented(line) or ""
    after = rest.lstrip("#")
    level = len(rest) - len(after)
    if not 1 <= level <= 6 or after and after[0] not in " \t":
        return None
    text = after.strip(" \t")
    open_ = text.rstrip("#")
    return level, open_.rstrip(" \t") if open_ != text and open_[-1:] in (" ", "\t") else text


def markdown_sections(text: str) -> Iterator[tuple[str | None, str, str]]:
    """SRC-08, SRC-09: title, heading path (JSON) and text of each section of a Markdown text.

    A section begins at a heading if the lines before hold more than headings and blanks; code fences hide headings.
    """
    trail: list[tuple[int, str]] = []
    lines: list[str] = []
    title, body, fence = None, False, None

    def done() -> Iterator[tuple[str | None, str, str]]:
        if "".join(lines).strip():
            yield title, json.dumps({"headingPath": [h for _, h in trail], "headingLevel": trail[-1][0] if trail else 0}, ensure_ascii=False), "\n".join(lines)

    for line in text.split("\n"):
        mark = fence_of(line)
        if fence:
            body = True
            if mark and mark[0].startswith(fence) and not mark[1].strip():
                fence = None
        elif mark:
            fence, body = mark[0], True
        elif (head := heading_of(line)) and (name := head[1]) and name.strip("#"):
            if body:
                yield from done()
                lines, body = [], False
            title, level = name, head[0]
            while trail and trail[-1][0] >= level:
                trail.pop()
            trail.append((level, name))
        elif line.strip():
            body = True
        lines.append(line)
    yield from done()


def parse_markdown(files: DataFrame) -> DataFrame:
    """document_id, segment_no, title, metadata, text of the sections of files (document_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, k, *s) for d, t in zip(batch.document_id, batch.text, strict=True) for k, s in enumerate(markdown_sections(t))]
            yield pd.DataFrame(rows, columns=["document_id", "segment_no", "title", "metadata", "text"])

    return files.select("document_id", "text").mapInPandas(run, "document_id long, segment_no int, title string, metadata string, text string")


def embedding_input(headings: Column, text: Column, most: int = 200) -> Column:
    """FN-27: the heading path, a newline and the text; of a path over `most` code points the first headings go, then its end. Without headings: the text."""
    paths = F.transform(F.sequence(F.lit(1), F.size(headings)), lambda i: F.array_join(F.slice(headings, i, F.size(headings)), " > "))
    fitting = F.filter(paths, lambda p: F.length(p) <= most)
    path = F.coalesce(F.get(fitting, F.lit(0)), F.substring(F.element_at(headings, -1), 1, most))
    return F.when(F.size(headings) > 0, F.concat(path, F.lit("\n"), text)).otherwise(text)


def embedded(parts: DataFrame, encode: Callable[[list[str]], list[list[float]]], model: str, dimension: int) -> DataFrame:
    """ING-06: document_id, chunk_index, model, vector of chunks, by any encoder of lists of texts, batch by batch.

    A wrong number of vectors, a wrong dimension or a number that isn't finite fails the task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = encode(batch.chunk_text.tolist())
            if len(vectors) != len(batch) or any(len(v) != dimension or not np.isfinite(v).all() for v in vectors):
                raise ValueError(f"{model}: expected {len(batch)} finite vectors of {dimension}")
            yield pd.DataFrame({"document_id": batch.document_id, "chunk_index": batch.chunk_index, "model": model, "vector": list(vectors)})

    return parts.select("document_id", "chunk_index", "chunk_text").mapInPandas(run, "document_id long, chunk_index int, model string, vector array<float>")


def index_stages(documents: DataFrame, parts: DataFrame, vectors: DataFrame) -> DataFrame:
    """ING-10, AGG-25: document_id, chunks, vectors, status: how far each document came: UPLOADED, CHUNKED, EMBEDDING, INDEXED."""
    count = lambda d, name: d.groupBy("document_id").agg(F.count("*").alias(name))
    rows = documents.select("document_id").join(count(parts, "chunks"), "document_id", "left").join(count(vectors, "vectors"), "document_id", "left").fillna(0, ["chunks", "vectors"])
    status = F.when(F.col("chunks") == 0, "UPLOADED").when(F.col("vectors") == 0, "CHUNKED").when(F.col("vectors") < F.col("chunks"), "EMBEDDING").otherwise("INDEXED")
    return rows.withColumn("status", status)
