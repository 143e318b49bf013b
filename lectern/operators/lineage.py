"""Cutting lineage: results that are read several times, as tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables that written() has made, by owner, and tables that kept() has made, by session and key.
_tables: dict[str, list[str]] = {}
_kept: dict[Hashable, DataFrame] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a session on this machine alone gets one of its own where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    context = spark.sparkContext
    if (known := context.getCheckpointDir()) is not None:
        return known.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lectern-"))
    return context.getCheckpointDir().rstrip("/")


def written(df: DataFrame, owner: str = "") -> DataFrame:
    """df as a Parquet table of its own: a lost executor costs a task of the readers, not the work before. release() removes an owner's tables."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lectern-tables/{uuid.uuid4().hex}"
    _tables.setdefault(owner, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """written(), for results that live as long as the session's folder."""
    return written(df)


def replaced(df: DataFrame, owner: str) -> DataFrame:
    """written(), and the owner's tables before, which df may have read, are removed."""
    before = list(_tables.get(owner, []))
    out = written(df, owner)
    _remove(df.sparkSession, before)
    _tables[owner] = [path for path in _tables[owner] if path not in before]
    return out


def release(spark: SparkSession, owner: str) -> None:
    """Removes the owner's tables; nothing may read them any more."""
    _remove(spark, _tables.pop(owner, []))


def _remove(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside leave no shuffle files once they are done, for rounds that write their tables; the session's own setting returns afterwards."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def kept(spark: SparkSession, key: Hashable, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that build() gives, written once a session for each key: for what a database keeps as a maintained table."""
    full = (spark.sparkContext.applicationId, key)
    if full not in _kept:
        _kept[full] = written(build())
    return _kept[full]
