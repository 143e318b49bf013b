"""Queries that go through files: documents as files of several kinds and back, tables saved together, keyed merges; with their SQL."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.lineage import shared_folder, written
from lectern.plans.catalog import query
from lectern.plans.derived import Tables
from lectern.sources import containers, tableset

WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def word_file(text: str) -> bytes:
    """A Word file with a paragraph for each line."""
    body = "".join(f"<w:p><w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for line in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f"<?xml version='1.0' encoding='UTF-8'?><w:document {WORD}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def as_files(docs: DataFrame) -> DataFrame:
    """path, content of documents (doc_id, text): Word files of odd ids, text files of even ones, and a text file in another encoding of each seventh."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            paths = [f"d{i}.{'docx' if i % 2 else 'txt'}" for i in ids]
            contents = [word_file(t or "") if i % 2 else (t or "").encode() if i % 7 else b"\xff" + (t or "").encode() for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(contents, pa.binary())], ["path", "content"])

    return docs.select("doc_id", "text").mapInArrow(run, "path string, content binary")


@query(r"""WITH d AS (SELECT doc_id, concat('d', doc_id, CASE WHEN doc_id % 2 = 1 THEN '.docx' ELSE '.txt' END) AS path, coalesce(text, '') AS text FROM documents),
t AS (SELECT *, CASE WHEN doc_id % 2 = 1 THEN array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)) ELSE replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) END AS shown FROM d)
SELECT path, CASE WHEN doc_id % 14 = 0 THEN 'NOT_UTF8' WHEN text = '' AND doc_id % 2 = 0 THEN 'EMPTY_FILE' WHEN NOT regexp_matches(shown, '\S') THEN 'NO_TEXT' END AS reason,
  CASE WHEN doc_id % 14 > 0 AND regexp_matches(shown, '\S') THEN sha256(shown) END AS text_hash FROM t""")
def parsed_files(t: Tables) -> DataFrame:
    """SRC-07, SRC-12, SRC-15: all documents as files, parsed by their kind; those that can't be read with the reason."""
    return containers.parse_files(as_files(t.documents)).select("path", "reason", F.sha2("text", 256).alias("text_hash"))


def _folder(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/lectern-tables/{uuid.uuid4().hex}"


@query("SELECT doc_id AS id, lang, CASE WHEN vec_id IS NOT NULL THEN label END AS label FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def saved_tables(t: Tables) -> DataFrame:
    """SRC-23: documents and their vectors saved by one commit, read back and joined."""
    path = _folder(t)
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.struct("vec_id", "label").alias("vectors"))
    tableset.save(t.documents.select("doc_id", F.struct(F.col("doc_id").alias("id"), "lang").alias("documents")).join(vectors, "doc_id", "left").select("documents", "vectors"), path)
    docs, found = tableset.read(t.spark, path, "documents", "id long, lang string"), tableset.read(t.spark, path, "vectors", "vec_id long, label int")
    return docs.join(found, F.col("id") == F.col("vec_id"), "left").select("id", "lang", "label")


@query("SELECT doc_id AS id, CASE WHEN lang = 'fr' THEN 'moved' ELSE source END AS source FROM documents UNION ALL SELECT -1 - c_custkey, c_name FROM customer")
def merged_table(t: Tables) -> DataFrame:
    """STR-12, SRC-20: a table of documents, then one merge with changed, unchanged and new rows; only buckets with a change are written again."""
    path, rows = _folder(t), t.documents.select(F.col("doc_id").alias("id"), "source")
    tableset.merge(rows, path, "t", "id", buckets=16)
    moved = t.documents.select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "fr", "moved").otherwise(F.col("source")).alias("source"))
    tableset.merge(written(moved.union(t.customer.select((-1 - F.col("c_custkey")).alias("id"), F.col("c_name").alias("source")))), path, "t", "id", buckets=16, update=True)
    return tableset.read(t.spark, path, "t", rows.schema)
