"""SQLite files as a Spark data source: read by ranges of row numbers in many tasks, written as one file a task.

    spark.dataSource.register(SqliteFiles)
    spark.read.format("sqlite_files").schema("id long, name string").option("table", "book").load("/shared/books.sqlite")

`path` is a file, or a folder of files with the same table, on a file system that driver and executors share (SQLite opens
no other). Only the columns of the schema are read; text that is no number becomes null in a column of numbers.

Options: table; rows_per_task (row numbers that a task reads, 50,000); key and after: only rows whose `key` is greater than
`after`, so that a migration goes on where it stopped.
"""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlparse

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROWS_PER_TASK = 50_000
FETCHED = 5000


def local_path(path: str) -> str:
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"SQLite reads no {parts.scheme} files: {path}")
    return parts.path


def opened(path: str) -> sqlite3.Connection:
    """Read only; text that is no UTF-8 is read with replacement characters."""
    db = sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)
    db.text_factory = lambda b: b.decode("utf-8", "replace")
    return db


def named(column: str) -> str:
    return '"' + column.replace('"', '""') + '"'


@dataclass
class RowRange(InputPartition):
    path: str
    low: int
    high: int


class SqliteFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_files"

    def schema(self) -> StructType:
        raise ValueError("sqlite_files needs a schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return RangeReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return FileWriter(schema, dict(self.options), overwrite)


class RangeReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.options, self.types = schema.names, options, to_arrow_schema(schema)

    def _where(self) -> tuple[str, list]:
        key, after = self.options.get("key"), self.options.get("after")
        if (key is None) != (after is None):
            raise ValueError("key and after go together")
        return ("", []) if key is None else (f" AND {named(key)} > CAST(? AS NUMERIC)", [after])

    def partitions(self) -> list[RowRange]:
        at, step = local_path(self.options["path"]), int(self.options.get("rows_per_task", ROWS_PER_TASK))
        files = [os.path.join(at, f) for f in sorted(os.listdir(at)) if not f.startswith((".", "_"))] if os.path.isdir(at) else [at]
        where, values = self._where()
        out = []
        for path in files:
            with opened(path) as db:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {named(self.options['table'])} WHERE 1{where}", values).fetchone()
            if low is not None:
                out += [RowRange(path, a, min(a + step - 1, high)) for a in range(low, high + 1, step)]
        return out

    def read(self, part: RowRange | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no rows at all
            return
        where, values = self._where()
        wanted = ", ".join(named(c) for c in self.columns)
        with opened(part.path) as db:
            cursor = db.execute(f"SELECT {wanted} FROM {named(self.options['table'])} WHERE rowid BETWEEN ? AND ?{where} ORDER BY rowid", [part.low, part.high, *values])
            while rows := cursor.fetchmany(FETCHED):
                yield pa.RecordBatch.from_arrays([typed(column, f.type) for column, f in zip(zip(*rows, strict=True), self.types, strict=True)], schema=self.types)


def typed(values: tuple, kind: pa.DataType) -> pa.Array:
    """A column whose cells SQLite may hold in any type."""
    if pa.types.is_string(kind):
        return pa.array([None if v is None else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v) for v in values], kind)
    if pa.types.is_binary(kind):
        return pa.array([v.encode() if isinstance(v, str) else v for v in values], kind)

    def number(v):
        try:
            return None if v is None else float(v) if pa.types.is_floating(kind) else int(v)
        except (TypeError, ValueError):
            return None

    return pc.cast(pa.array([number(v) for v in values]), kind) if any(v is not None for v in values) else pa.nulls(len(values), kind)


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int


class FileWriter(DataSourceArrowWriter):
    """Each task writes a hidden file of its own; the files of tasks that were used get their names at the end."""

    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.columns, self.options, self.overwrite = schema.names, options, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        at = local_path(self.options["path"])
        os.makedirs(at, exist_ok=True)
        path, rows = os.path.join(at, f".part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.sqlite"), 0
        table, names = named(self.options["table"]), ", ".join(named(c) for c in self.columns)
        with sqlite3.connect(path) as db:
            db.execute(f"CREATE TABLE {table} ({names})")
            for batch in iterator:
                db.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(self.columns))})", zip(*(c.to_pylist() for c in batch.columns), strict=True))
                rows += batch.num_rows
        db.close()
        return Written(path, rows)

    def commit(self, messages: list[Written | None]) -> None:
        at = local_path(self.options["path"])
        before = [os.path.join(at, f) for f in os.listdir(at) if not f.startswith(".")] if self.overwrite and os.path.isdir(at) else []
        for m in messages:
            if m is not None:
                os.rename(m.path, os.path.join(at, os.path.basename(m.path)[1:]))
        for old in before:
            os.remove(old)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)
