"""Sources and sinks: tables, objects in any store that Spark reaches, ledgers, and keyed writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.lineage import written
from lectern.operators.queues import insert_absent

# Media types and first bytes of the accepted kinds of files.
KINDS = {"txt": ("text/plain", ""), "md": ("text/markdown", ""), "pdf": ("application/pdf", "25504446"), "docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "504B0304")}
LEDGER = "request_id string, outcome string, http_status int, sent_at timestamp_ntz, completed_at timestamp_ntz"


def objects(spark: SparkSession, path: str) -> DataFrame:
    """SRC-03..06: files of a folder or bucket (file:, s3a:, gs:, ...) as path, length, content. Spark's reader leaves out files without bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """SRC-18: a CSV request ledger (also gzipped); a row that doesn't fit the columns fails the read."""
    return spark.read.csv(path, schema=LEDGER, header=True, mode="FAILFAST", enforceSchema=False)


def lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-18: JSON lines with a fixed schema; broken lines are dropped."""
    return spark.read.json(path, schema=schema, mode="DROPMALFORMED")


def _divided(rows: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows that fit the schema, and the lines that don't with their file: path, line, reason. Blank lines are no rows."""
    bad = rows.filter("__line IS NOT NULL").select(F.col("__path").alias("path"), F.col("__line").alias("line"), F.lit("MALFORMED").alias("reason"))
    return rows.filter("__line IS NULL").drop("__line", "__path"), bad


def _kept(reader, path: str, schema: str, **options) -> DataFrame:  # noqa: ANN001, ANN003
    """A permissive read that keeps broken lines, as a table: Spark doesn't parse a line for its broken rest alone."""
    rows = reader(path, schema=f"{schema}, __line string", mode="PERMISSIVE", columnNameOfCorruptRecord="__line", **options)
    return written(rows.withColumn("__path", F.col("_metadata.file_path")))


def lines_with_rejects(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """SRC-18, AGG-28: JSON lines that fit the schema, and the quarantine: path, line, reason."""
    return _divided(_kept(spark.read.json, path, schema), schema)


def ledger_with_rejects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-18: a CSV request ledger's rows that fit its columns, and the quarantine: path, line, reason."""
    return _divided(_kept(spark.read.csv, path, LEDGER, header=True, enforceSchema=False), LEDGER)


def content_hash(files: DataFrame) -> DataFrame:
    """SRC-17, ING-13: SHA-256 of the content; equal (hash, length) are one object."""
    return files.withColumn("file_hash", F.sha2("content", 256))


def accepted(files: DataFrame, most_bytes: int = 50 << 20) -> Column:
    """SRC-16: known extension, right first bytes, not empty and not too large."""
    ext = F.lower(F.element_at(F.split("path", r"\."), -1))
    fits = F.lit(False)
    for kind, (_, magic) in KINDS.items():
        fits = fits | ((ext == kind) & F.startswith(F.hex("content"), F.lit(magic)))
    return fits & F.col("length").between(1, most_bytes)


def append_absent(spark: SparkSession, rows: DataFrame, path: str, *keys: str) -> int:
    """SRC-19, SRC-23: appends rows whose key the Parquet table at path lacks; how many there were."""
    stored = spark.read.schema(rows.schema).option("ignoreMissingFiles", "true").parquet(path)
    new = insert_absent(stored, rows, *keys).select(*rows.columns)
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def as_json(rows: DataFrame) -> DataFrame:
    """SRC-24: one JSON object a row, without null fields."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))
