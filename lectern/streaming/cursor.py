"""A stream over a table by its key: the offset is the cursor of a keyset page.

Each micro-batch takes the rows whose key lies above the cursor, page by page; the cursor is kept in the query's checkpoint, so a restart goes on
behind the last page that was done. Keys are whole numbers that grow as rows are added, as ids of a database do. A page is
read by ranges of the key, in parallel, with the filter in the Parquet scan. pyarrow's file systems reach the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

FORMAT = "lectern_cursor"


@dataclass
class Page(InputPartition):
    """Keys above `after`, up to `last`."""

    after: int
    last: int


def opened(path: str) -> ds.Dataset:
    files, at = pafs.FileSystem.from_uri(path)
    return ds.dataset(at, filesystem=files, format="parquet")


def page_end(table: ds.Dataset, key: str, after: int, size: int) -> int:
    """The last key of the page of `size` rows after the cursor; `after` itself where there are none. Holds one page of keys at most, twice."""
    best = pa.array([], pa.int64())
    limit = None
    for batch in table.scanner(columns=[key], filter=pc.field(key) > after).to_batches():
        keys = batch.column(0).cast(pa.int64())
        if limit is not None:
            keys = keys.filter(pc.less(keys, limit))
        best = pa.concat_arrays([best, keys])
        if len(best) > size:
            best = best.take(pc.select_k_unstable(best, size, [("", "ascending")]))
            limit = pc.max(best)
    return pc.max(best).as_py() if len(best) else after


class CursorReader(DataSourceStreamReader):
    """Offsets are {"after": cursor}."""

    def __init__(self, path: str, key: str, size: int, start: int, parts: int) -> None:
        self.path, self.key, self.size, self.start, self.parts, self.at = path, key, size, start, parts, None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": self.start}

    def latestOffset(self) -> dict:  # noqa: N802
        """The end of the page behind the last one planned."""
        self.at = page_end(opened(self.path), self.key, self.start if self.at is None else self.at, self.size)
        return {"after": self.at}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        """Ranges of the key, of one length."""
        low, high = start["after"], end["after"]
        self.at = max(high, self.at if self.at is not None else high)
        step = max(1, -(-(high - low) // self.parts))
        return [Page(a, min(high, a + step)) for a in range(low, high, step)]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        within = (pc.field(self.key) > partition.after) & (pc.field(self.key) <= partition.last)
        yield from opened(self.path).scanner(filter=within).to_batches()

    def commit(self, end: dict) -> None:
        """Nothing is held for a page."""


class CursorSource(DataSource):
    """STR-11, TOP-05: options path, key, size (rows of a page), start (cursor to begin with), parts (ranges that a page is read in)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return from_arrow_schema(opened(self.options["path"]).schema)

    def streamReader(self, schema: StructType) -> CursorReader:  # noqa: N802
        o = self.options
        return CursorReader(o["path"], o["key"], int(o.get("size", 100_000)), int(o.get("start", -1)), int(o.get("parts", 4)))
