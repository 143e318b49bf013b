"""Shared helpers: documents with safe names, tables in the shared folder, joins that stand hot keys."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it; what lies between is a word.
SPACE = r"[\x20\x09-\x0D]+"

#: Keys of a null doc_id, before or after all others.
FIRST, LAST = -(1 << 63), (1 << 63) - 1

#: Broadcast sides must be proven smaller than this: rows times the bytes of their columns and of a hash table's entry.
BROADCAST_BYTES, ENTRY_BYTES = 64 << 20, 48

#: Rows of a batch that goes to a Python worker. Texts cross over in batches, which both sides hold whole, once a task.
BATCH_ROWS = 1000

#: Tables that written() has made, by the owner that scratch() named.
_tables: dict[str, list[str]] = {}
_owners: list[str] = [""]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Only a session on this machine alone gets one of its own where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if (known := spark.sparkContext.getCheckpointDir()) is not None:
        return known
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lectern-"))
    return spark.sparkContext.getCheckpointDir()


def written(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared folder and reads it back.

    Unlike checkpoint() the copy is columnar, so later passes read only the columns they need.
    The files live as long as the folder does; release() removes those of an owner earlier.
    """
    path = f"{shared_folder(spark).rstrip('/')}/lectern/{uuid.uuid4().hex}"
    _tables.setdefault(_owners[-1], []).append(path)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession) -> str:
    """Path of a folder yet to be made in the shared folder; release() removes it like a table of written()."""
    path = f"{shared_folder(spark).rstrip('/')}/lectern/{uuid.uuid4().hex}"
    _tables.setdefault(_owners[-1], []).append(path)
    return path


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside send at most BATCH_ROWS rows at a time to Python workers; the session's own setting returns afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= BATCH_ROWS:
        yield
        return
    spark.conf.set(name, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release(spark: SparkSession, owner: str = "", *sources: DataFrame) -> None:
    """Removes the tables that written() has made for the owner, but for those that the sources still read."""
    paths = _tables.pop(owner, [])
    if still := _removed(spark, paths, sources):
        _tables[owner] = still


def _removed(spark: SparkSession, paths: list[str], sources: Iterable[DataFrame]) -> list[str]:
    """Removes the tables at paths but for those that the sources read; which those are."""
    read = {f.rpartition("/lectern/")[2].partition("/")[0] for s in sources for f in s.inputFiles()} if paths else set()
    still = [path for path in paths if path.rpartition("/")[2] in read]
    for path in set(paths) - set(still):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return still


@contextmanager
def interim(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """At the end of the block, removes what written() made inside but for the tables that the frames in the given list read.

    All that the block leaves to later plans must be written and stand in that list. After an error all tables stay
    until their owner's release.
    """
    owner, keep = _owners[-1], []
    before = len(_tables.setdefault(owner, []))
    yield keep
    made = _tables[owner]
    made[before:] = _removed(spark, made[before:], keep)


@contextmanager
def scratch(spark: SparkSession, owner: str, *sources: DataFrame) -> Iterator[None]:
    """Files what written() makes inside under the owner, and first removes the owner's earlier tables that the sources don't read."""
    release(spark, owner, *sources)
    _owners.append(owner)
    try:
        yield
    finally:
        _owners.pop()


def documents(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that further columns of the input can't clash with ours. Null text: empty."""
    return df.select(*(F.coalesce(df[c], F.lit("")).alias(c) if c == "text" else df[c] for c in columns))


def with_row_keys(docs: DataFrame, name: str = "doc", null: int = LAST) -> DataFrame:
    """docs with a long key for each row in the column `name`, ordered by doc_id; a null doc_id counts as `null` (FIRST or LAST).

    Where no two rows share a doc_id, it is the key, and nothing is written. Else the rows are written once, sorted by
    doc_id and their place in the input, and numbered in that order.
    """
    key = F.coalesce(docs["doc_id"], F.lit(null).cast("long"))
    if docs.select(key.alias("key")).groupBy("key").count().filter("count > 1").isEmpty():
        return docs.withColumn(name, key)
    dealt = docs.withColumn(name, F.monotonically_increasing_id()).repartitionByRange(key, F.col(name)).sortWithinPartitions(key, F.col(name))
    return written(docs.sparkSession, dealt.withColumn(name, F.monotonically_increasing_id()))


def with_hot_keys(left: DataFrame, right: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """left join-inner right on key, where right has one row a key and `rows` counts left's rows of that key.

    A key that holds over total/1000 of left's rows is hot; there can't be more than 1000 of them, so these few
    rows of right are broadcast and left's hot rows stay where they are. All other keys are joined by a shuffle
    in which no key holds over a thousandth of the rows.
    """
    limit = max(1000, total // 1000)
    hot = F.broadcast(right.filter(F.col(rows) > limit))
    cold = right.filter(F.col(rows) <= limit)
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(cold, key))


def bounded(df: DataFrame, rows: int, width: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, of so many rows of columns of `width` bytes, marked for broadcast if the hash table stays within the limit, else for a shuffled join."""
    return F.broadcast(df) if rows * (width + ENTRY_BYTES) <= limit else df


def words(text: Column | str) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, even where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def vocabulary(name: str, folder: str | None = None) -> str:
    """Path of a tokenizer file: in folder, in $LECTERN_TOKENIZERS, or as the installed package has it."""
    if folder := folder or os.environ.get("LECTERN_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
