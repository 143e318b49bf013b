"""Sets of tables that change together: atomic writes, keyed merges, quarantine beside results.

A set is a folder. Data files lie in folders of their own for each transaction; `log/<n>.json` lists, from version 0 on, the files
that each version adds to and takes from the tables. A version exists once its file does, so what a failed or repeated
task or job has left is in no version and is never read; `vacuum` removes it. Files are written and listed by pyarrow's
file systems (local and mounted folders, hdfs, s3, gs).

`save` writes several tables in one job: the frame has a struct column for each table, null in rows that add nothing to it. It goes through a data
source of its own, whose tasks write one file a table and whose commit - on the driver, once all tasks are done - adds the version.

`merge` keeps one row a key. Its tables are dealt into buckets by the key's hash; only buckets that hold a changed key are
read and written again, so a replay of rows that are there changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from lectern.operators.lineage import written

FORMAT = "lectern_tables"


class Conflict(ValueError):
    """Another writer was first, or stored rows differ from those that came."""


def _files(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path.rstrip("/"))


def versions(path: str) -> list[dict]:
    """The log's entries in order."""
    files, at = _files(path)
    found = files.get_file_info(pafs.FileSelector(f"{at}/log", allow_not_found=True))
    numbered = sorted((int(f.base_name.removesuffix(".json")), f.path) for f in found if f.base_name.removesuffix(".json").isdigit())
    entries = []
    for k, (n, name) in enumerate(numbered):
        if n != k:
            raise Conflict(f"version {k} is missing")
        with files.open_input_stream(name) as file:
            entries.append(json.loads(file.read()))
    return entries


def current(path: str, version: int | None = None) -> dict[str, list[dict]]:
    """Files (path, rows, bucket) of each table, as of a version or the last."""
    tables: dict[str, dict[str, dict]] = {}
    for entry in versions(path)[: None if version is None else version + 1]:
        for name, change in entry.items():
            held = tables.setdefault(name, {})
            for gone in change.get("gone", ()):
                held.pop(gone)
            held |= {f["path"]: f for f in change.get("added", ())}
    return {name: list(held.values()) for name, held in tables.items()}


def commit(path: str, entry: dict, expected: int | None = None) -> int:
    """Adds a version and returns its number. expected: the number of versions that the writer has seen; Conflict if there are more.

    The entry is written under a name of its own first and then linked to the version's number, which only one writer can do
    on a local file system. Stores without that operation need one writer at a time.
    """
    files, at = _files(path)
    number = len(versions(path))
    if expected is not None and number != expected:
        raise Conflict(f"{number - expected} versions came in between")
    files.create_dir(f"{at}/log", recursive=True)
    draft, name = f"{at}/log/{uuid.uuid4().hex}.draft", f"{at}/log/{number}.json"
    with files.open_output_stream(draft, compression=None) as out:
        out.write(json.dumps(entry).encode())
    if isinstance(files, pafs.LocalFileSystem):
        import os

        try:
            os.link(draft, name)
        except FileExistsError as taken:
            raise Conflict(f"version {number} was taken") from taken
        finally:
            files.delete_file(draft)
    else:
        files.move(draft, name)
    return number


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: (table, path, rows)."""

    files: list[tuple[str, str, int]]


class TablesWriter(DataSourceArrowWriter):
    """One Parquet file a table and task; all of them become a version in commit(), or are removed in abort()."""

    def __init__(self, path: str, names: list[str]) -> None:
        self.path, self.names, self.folder = path.rstrip("/"), names, f"data/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, at = _files(self.path)
        open_: dict[str, pq.ParquetWriter] = {}
        made: dict[str, list] = {}
        try:
            for batch in iterator:
                for name in self.names:
                    column = batch.column(batch.schema.get_field_index(name))
                    column = column.filter(column.is_valid())
                    if not len(column):
                        continue
                    if name not in open_:
                        files.create_dir(f"{at}/{self.folder}", recursive=True)
                        made[name] = [f"{self.folder}/{name}-{uuid.uuid4().hex}.parquet", 0]
                        open_[name] = pq.ParquetWriter(f"{at}/{made[name][0]}", pa.schema(list(column.type)), filesystem=files)
                    rows = pa.RecordBatch.from_struct_array(column)
                    open_[name].write_batch(rows)
                    made[name][1] += rows.num_rows
        finally:
            for writer in open_.values():
                writer.close()
        return Written([(name, *x) for name, x in made.items()])

    def commit(self, messages: list[Written | None]) -> None:
        entry: dict[str, dict] = {}
        for name, path, rows in (f for m in messages if m for f in m.files):
            entry.setdefault(name, {"added": []})["added"].append({"path": path, "rows": rows, "bucket": None})
        if entry:
            commit(self.path, entry)

    def abort(self, messages: list[Written | None]) -> None:
        files, at = _files(self.path)
        if files.get_file_info(f"{at}/{self.folder}").type != pafs.FileType.NotFound:
            files.delete_dir(f"{at}/{self.folder}")


class TablesSource(DataSource):
    """The data source behind save()."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> TablesWriter:
        return TablesWriter(self.options["path"], schema.fieldNames())


def save(rows: DataFrame, path: str) -> None:
    """SRC-23: appends to all tables of the set at once; rows has a struct column a table. If the job fails, nothing is added."""
    rows.sparkSession.dataSource.register(TablesSource)
    rows.write.format(FORMAT).option("path", path).mode("append").save()


def read(spark: SparkSession, path: str, table: str, schema: str | StructType, version: int | None = None) -> DataFrame:
    """A table of the set, as of a version or the last."""
    found = [f"{path.rstrip('/')}/{f['path']}" for f in current(path, version).get(table, ())]
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def vacuum(path: str) -> int:
    """Removes data files that no version lists; how many. Only while nobody writes."""
    files, at = _files(path)
    known = {f["path"] for entry in versions(path) for change in entry.values() for f in change.get("added", ())}
    gone = [f.path for f in files.get_file_info(pafs.FileSelector(f"{at}/data", recursive=True, allow_not_found=True)) if f.is_file and f.path.removeprefix(f"{at}/") not in known]
    for name in gone:
        files.delete_file(name)
    return len(gone)


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def merge(rows: DataFrame, path: str, table: str, *keys: str, buckets: int = 64, update: bool = False) -> int:
    """STR-12, SRC-20, SRC-25: makes the rows (of distinct keys) the table's rows of their keys; how many were new or changed.

    A row that is stored alike is a replay and changes nothing. One that is stored otherwise raises Conflict, or takes its place with update.
    Only buckets with a change are written, by one version that puts their new files in the place of the old ones; if another version came in between, Conflict.
    """
    spark, path = rows.sparkSession, path.rstrip("/")
    before = len(versions(path))
    held = current(path).get(table, [])
    names = rows.columns
    came = written(rows.withColumn("__bucket", _bucket(list(keys), buckets)))
    if came.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise Conflict("a key comes twice")
    touched = {r[0] for r in came.select("__bucket").distinct().collect()}
    old = [f for f in held if f["bucket"] in touched]
    stored = spark.read.schema(rows.schema).parquet(*[f"{path}/{f['path']}" for f in old]) if old else spark.createDataFrame([], rows.schema)
    there = stored.select(*keys, F.struct(*names).alias("__old"))
    state = written(came.withColumn("__new", F.struct(*names)).join(there, list(keys), "left").select("__bucket", "__new", "__old"))
    differs = F.col("__old").isNotNull() & ~F.col("__new").eqNullSafe(F.col("__old"))
    if not update and not state.filter(differs).isEmpty():
        raise Conflict("stored otherwise")
    changed = state.filter(F.col("__old").isNull() | differs)
    dirty = {r[0]: r[1] for r in changed.groupBy("__bucket").count().collect()}
    if not dirty:
        return 0
    kept = stored.withColumn("__bucket", _bucket(list(keys), buckets)).filter(F.col("__bucket").isin(list(dirty)))
    kept = kept.join(changed.select("__new.*").select(*keys), list(keys), "left_anti").select("__bucket", *names)
    folder = f"data/{uuid.uuid4().hex}"
    full = kept.union(changed.select("__bucket", "__new.*")).repartition(min(buckets, len(dirty)), "__bucket")
    full.withColumn("bucket", F.col("__bucket")).drop("__bucket").write.partitionBy("bucket").parquet(f"{path}/{folder}")
    files, at = _files(path)
    found = files.get_file_info(pafs.FileSelector(f"{at}/{folder}", recursive=True))
    added = [{"path": f.path.removeprefix(f"{at}/"), "rows": None, "bucket": int(f.path.rpartition("/bucket=")[2].partition("/")[0])} for f in found if f.is_file and f.extension == "parquet"]
    gone = [f["path"] for f in held if f["bucket"] in dirty]
    commit(path, {table: {"added": added, "gone": gone}}, before)
    return sum(dirty.values())
