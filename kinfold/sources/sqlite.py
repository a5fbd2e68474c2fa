"""An existing library in an SQLite file as tables, and its import into a store.

The file is read in tasks, one for each range of row numbers, so it must be mounted alike on the driver and all executors and must not change
meanwhile: a task that finds another time or size than the plan did raises. Nothing is written to it. Vectors are stored as the bytes of 32-bit
numbers, lowest byte first. Values are cast to the types of ``store.TABLES``; columns that an older file lacks get the defaults named here, others are null.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator
from contextlib import closing
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kinfold import runtime
from kinfold.sources import store
from kinfold.sources.folders import local_path

#: Row numbers of a task, at least, and tasks of a table, at most; rows of a batch.
TASK_ROWS, MOST_TASKS, ROWS = 100_000, 10_000, 4096
#: What a column holds where the file has no such column.
DEFAULTS = {"pinned": "0", "confidence": "0.0"}

_CASTS = {"bigint": "INTEGER", "boolean": "INTEGER", "double": "REAL", "string": "TEXT", "array<float>": "BLOB"}
_ARROW = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string(), "array<float>": pa.list_(pa.float32())}


def _opened(file: str) -> closing:
    return closing(sqlite3.connect(f"file:{quote(file)}?mode=ro", uri=True))


def _state(file: str) -> tuple[int, int]:
    found = os.stat(file)
    return found.st_mtime_ns, found.st_size


def vectors(blobs: list[bytes | None]) -> pa.Array:
    """Lists of 32-bit numbers from their bytes; a null stays one, and bytes that end within a number are an error."""
    for blob in blobs:
        if blob is not None and len(blob) % 4:
            raise ValueError(f"a vector of {len(blob)} bytes, which is no whole count of 32-bit numbers")
    sizes = [len(b or b"") // 4 for b in blobs]
    numbers = np.frombuffer(b"".join(b or b"" for b in blobs), dtype="<f4")
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(numbers), mask=pa.array([b is None for b in blobs], pa.bool_()))


class Rows(InputPartition):
    """Row numbers from ``low`` to ``high``, and the file's time and size when they were planned."""

    def __init__(self, low: int, high: int, state: tuple[int, int]):
        self.low, self.high, self.state = low, high, state


class LibraryReader(DataSourceReader):
    def __init__(self, file: str, table: str):
        if table not in store.TABLES:
            raise ValueError(f"{table}: not one of {', '.join(store.TABLES)}")
        self.file, self.table = file, table
        self.columns = [c.strip().split(" ", 1) for c in store.TABLES[table].split(",")]

    def partitions(self) -> list[Rows]:
        state = _state(self.file)
        with _opened(self.file) as library:
            # Each end is one look at the table's tree.
            low = library.execute(f"SELECT min(rowid) FROM {self.table}").fetchone()[0]
            high = library.execute(f"SELECT max(rowid) FROM {self.table}").fetchone()[0]
        if low is None:
            return [Rows(0, 0, state)]
        width = max(TASK_ROWS, -(-(high - low + 1) // MOST_TASKS))
        return [Rows(at, min(at + width - 1, high), state) for at in range(low, high + 1, width)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        with _opened(self.file) as library:
            there = {r[1] for r in library.execute(f"PRAGMA table_info({self.table})")}
            wanted = ", ".join(f"CAST({name if name in there else DEFAULTS.get(name, 'NULL')} AS {_CASTS[kind]})" for name, kind in self.columns)
            cursor = library.execute(f"SELECT {wanted} FROM {self.table} WHERE rowid BETWEEN ? AND ? ORDER BY rowid", (partition.low, partition.high))
            while rows := cursor.fetchmany(ROWS):
                yield pa.RecordBatch.from_arrays([self._column(kind, values) for (_, kind), values in zip(self.columns, zip(*rows, strict=True), strict=True)], names=[n for n, _ in self.columns])
        if _state(self.file) != partition.state:
            raise RuntimeError(f"{self.file} was changed while it was read")

    @staticmethod
    def _column(kind: str, values: tuple) -> pa.Array:
        if kind == "array<float>":
            return vectors(list(values))
        if kind == "boolean":
            values = [None if v is None else v != 0 for v in values]
        return pa.array(values, _ARROW[kind])


class LibrarySource(DataSource):
    """``spark.read.format("kinfold_library").option("table", "faces").load(file)``: a table of ``store.TABLES``."""

    @classmethod
    def name(cls) -> str:
        return "kinfold_library"

    def schema(self) -> str:
        return store.TABLES[self.options["table"]]

    def reader(self, schema) -> LibraryReader:
        return LibraryReader(local_path(self.options["path"]), self.options["table"])


def library(spark: SparkSession, file: str, table: str) -> DataFrame:
    """One table of an SQLite library."""
    runtime.ship_package(spark)
    spark.dataSource.register(LibrarySource)
    return spark.read.format("kinfold_library").option("table", table).load(file)


def import_library(spark: SparkSession, file: str, into: store.Store) -> None:
    """Put all tables of an SQLite library into ``into``, in one publish; what it held before stays in its older versions alone."""
    into.write(**{table: library(spark, file, table) for table in store.TABLES})
