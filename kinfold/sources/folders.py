"""Folders of files as data sources: an exact recursive listing, and its changes as a stream.

Both walk the file system in tasks, one for each directory that the plan names, so the folder must be mounted alike on the driver and all
executors. Names that begin with a dot or underscore are listed like any others, linked directories are not entered, files that vanish or can't be
looked at are left out, and a directory that can't be read is an error: a drive that isn't mounted must not look like deletions.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlparse
from uuid import uuid4

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from kinfold import constants as C
from kinfold import runtime

#: Directories that a listing is dealt into, at least, where the tree has as many.
LEAST_PARTS = 32
#: Rows of a batch.
ROWS = 8192

LISTED = "path string, mtime double, size bigint, file_id string, changed double"
_LISTED = pa.schema([("path", pa.string()), ("mtime", pa.float64()), ("size", pa.int64()), ("file_id", pa.string()), ("changed", pa.float64())])


def local_path(folder: str) -> str:
    """The path that a file URI names; a plain path is taken as it is. Other schemes are refused."""
    scheme = urlparse(folder).scheme
    if scheme == "file":
        return unquote(urlparse(folder).path)
    if scheme and "://" in folder:
        raise ValueError(f"{folder}: only folders of a mounted file system can be walked")
    return folder


def is_local(folder: str) -> bool:
    return urlparse(folder).scheme == "file" or "://" not in folder


def entries(folder: str) -> tuple[list[str], list[str]]:
    """The directories and the other entries of a directory; an error if it can't be read."""
    folders, files = [], []
    with os.scandir(folder) as found:
        for entry in found:
            # A link to a directory is neither entered nor a file.
            if entry.is_dir(follow_symlinks=False):
                folders.append(entry.path)
            elif not entry.is_dir():
                files.append(entry.path)
    return sorted(folders), sorted(files)


def file_rows(files: list[str]) -> Iterator[tuple]:
    for path in files:
        try:
            seen = os.stat(path)
        except OSError:
            continue
        yield path, seen.st_mtime, seen.st_size, f"{seen.st_dev}:{seen.st_ino}", seen.st_ctime


def walked(folder: str, below: bool = True) -> Iterator[tuple]:
    """The files of a directory, and with ``below`` those of all directories in it."""
    todo = [folder]
    while todo:
        folders, files = entries(todo.pop())
        yield from file_rows(files)
        if below:
            todo += reversed(folders)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


class Directory(InputPartition):
    """A directory, and whether those below it are part of it."""

    def __init__(self, folder: str, below: bool):
        self.folder, self.below = folder, below


class FolderReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Directory]:
        """Level by level until there are enough directories; those above are listed for themselves."""
        alone, level = [], [self.folder]
        while level and len(level) < LEAST_PARTS:
            alone += level
            level = [f for one in level for f in entries(one)[0]]
        return [*(Directory(f, False) for f in alone), *(Directory(f, True) for f in level)]

    def read(self, partition: Directory) -> Iterator[pa.RecordBatch]:
        yield from _batches(walked(partition.folder, partition.below), _LISTED)


class FolderSource(DataSource):
    """``spark.read.format("kinfold_folder").load(folder)``: path, mtime, size, file_id (device and inode) and changed (time of the last change of any kind)."""

    @classmethod
    def name(cls) -> str:
        return "kinfold_folder"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> FolderReader:
        return FolderReader(local_path(self.options["path"]))


# -- changes -------------------------------------------------------------------------------------------------

EVENTS = "kind string, path string, ts timestamp, mtime double, size bigint, file_id string"
_EVENTS = pa.schema([("kind", pa.string()), ("path", pa.string()), ("ts", pa.timestamp("us", tz="UTC")), ("mtime", pa.float64()), ("size", pa.int64()), ("file_id", pa.string())])


class Difference(InputPartition):
    """A sub-directory between two listings; an empty name stands for the folder's own files."""

    def __init__(self, name: str, start: int, end: int):
        self.name, self.start, self.end = name, start, end


class FolderEventsReader(DataSourceStreamReader):
    """An offset is the time of a listing. The listing itself lies in the folder ``snapshots``, one file for each sub-directory.

    A batch is the difference of two listings. A task that finds no listing for the end of its batch makes it and puts it in place in one step; a
    batch that is repeated, by another attempt or after a restart, finds it and gives the same rows.
    """

    def __init__(self, folder: str, snapshots: str, poll_ms: int):
        self.folder, self.snapshots, self.poll_ms = folder, snapshots, poll_ms

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        """The beginning of this stretch of time: in each the folder is listed once."""
        entries(self.folder)
        return {"at": time.time_ns() // 1_000_000 // self.poll_ms * self.poll_ms}

    def _names(self, at: int) -> set[str]:
        folder = f"{self.snapshots}/{at}"
        return {unquote(f.removesuffix(".parquet")[1:]) for f in os.listdir(folder) if f.endswith(".parquet")} if at and os.path.isdir(folder) else set()

    def partitions(self, start: dict, end: dict) -> list[Difference]:
        now = {os.path.basename(f) for f in entries(self.folder)[0]}
        return [Difference(n, start["at"], end["at"]) for n in sorted({""} | now | self._names(start["at"]) | self._names(end["at"]))]

    def _file(self, name: str, at: int) -> str:
        return f"{self.snapshots}/{at}/-{quote(name, safe='')}.parquet"

    def _listed(self, name: str, at: int) -> pa.Table:
        """The listing of a sub-directory at the end of a batch: the one in place, or a new one."""
        place = self._file(name, at)
        if not os.path.exists(place):
            folder = os.path.join(self.folder, name) if name else self.folder
            rows = walked(folder, bool(name)) if os.path.isdir(folder) and not (name and os.path.islink(folder)) else iter(())
            found = pa.Table.from_batches(list(_batches(rows, _LISTED)), schema=_LISTED)
            os.makedirs(os.path.dirname(place), exist_ok=True)
            draft = f"{os.path.dirname(place)}/.{uuid4().hex}"
            pq.write_table(found, draft)
            try:
                # A second name, which fails if another attempt was first.
                os.link(draft, place)
            except FileExistsError:
                pass
            os.unlink(draft)
        return pq.read_table(place)

    def read(self, partition: Difference) -> Iterator[pa.RecordBatch]:
        after = {r["path"]: r for r in self._listed(partition.name, partition.end).to_pylist()}
        place = self._file(partition.name, partition.start)
        before = {r["path"]: r for r in pq.read_table(place).to_pylist()} if partition.start and os.path.exists(place) else {}

        def rows():
            for path in sorted(before.keys() | after.keys()):
                old, new = before.get(path), after.get(path)
                if new is None:
                    yield "deleted", path, partition.end * 1000, old["mtime"], old["size"], old["file_id"]
                elif old is None or (old["mtime"], old["size"], old["file_id"]) != (new["mtime"], new["size"], new["file_id"]):
                    yield "created" if old is None else "changed", path, int(new["changed"] * 1e6), new["mtime"], new["size"], new["file_id"]

        yield from _batches(rows(), _EVENTS)

    def commit(self, end: dict) -> None:
        """Listings before the one that the next batch starts from are no longer needed."""
        for name in os.listdir(self.snapshots) if os.path.isdir(self.snapshots) else ():
            if name.isdigit() and int(name) < end["at"]:
                for file in os.listdir(f"{self.snapshots}/{name}"):
                    os.unlink(f"{self.snapshots}/{name}/{file}")
                os.rmdir(f"{self.snapshots}/{name}")


class FolderEvents(DataSource):
    """``spark.readStream.format("kinfold_folder_events")`` with the options ``path``, ``snapshots`` and ``poll`` (milliseconds)."""

    @classmethod
    def name(cls) -> str:
        return "kinfold_folder_events"

    def schema(self) -> str:
        return EVENTS

    def streamReader(self, schema) -> FolderEventsReader:
        return FolderEventsReader(local_path(self.options["path"]), local_path(self.options["snapshots"]), int(self.options.get("poll", 1000 * C.DEBOUNCE_SECONDS)))


def register(spark: SparkSession) -> None:
    runtime.ship_package(spark)
    spark.dataSource.register(FolderSource)
    spark.dataSource.register(FolderEvents)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """All files below a folder. A missing folder is an error at once, an unreadable one when it is come upon."""
    if not os.path.isdir(local_path(folder)):
        raise FileNotFoundError(f"{folder} does not exist or is no folder")
    register(spark)
    return spark.read.format("kinfold_folder").load(folder)


def events(spark: SparkSession, folder: str, snapshots: str, poll: float = C.DEBOUNCE_SECONDS) -> DataFrame:
    """What changes below a folder, as a stream of created, changed and deleted files; the first batch has all that is there.

    ``snapshots`` is a folder of this stream alone, which lives as long as its checkpoint. Files made in sub-directories that come later are seen, as is whatever happens
    while the stream is stopped. The folder is listed every ``poll`` seconds at most. ``ts`` is the time of the file's last change, for a deletion that of the listing that misses it.
    """
    register(spark)
    return spark.readStream.format("kinfold_folder_events").option("path", folder).option("snapshots", snapshots).option("poll", max(1, round(1000 * poll))).load()


def with_renames(batch: DataFrame) -> DataFrame:
    """A batch of events in which a deletion and a creation of the same file are one ``renamed`` row with ``old_path``.

    Of several names of one file the deleted and the created ones are paired in their order.
    """
    placed = batch.withColumn("nth", F.row_number().over(Window.partitionBy("kind", "file_id").orderBy("path")))
    gone = placed.where("kind = 'deleted'").select("file_id", "nth", F.col("path").alias("old_path"), F.lit(True).alias("moved"))
    made = placed.where("kind = 'created'").join(gone, ["file_id", "nth"], "left")
    made = made.withColumn("kind", F.when(F.col("moved"), "renamed").otherwise("created"))
    left = placed.where("kind = 'deleted'").join(placed.where("kind = 'created'").select("file_id", "nth"), ["file_id", "nth"], "left_anti")
    columns = ["kind", "path", "old_path", "ts", "mtime", "size", "file_id"]
    others = left.union(placed.where("kind = 'changed'").select(left.columns)).withColumn("old_path", F.lit(None).cast("string"))
    return made.select(columns).union(others.select(columns))

