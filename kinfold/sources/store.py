"""A versioned table store: each publish writes new Parquet folders and swaps one small manifest.

Readers see the old version or the new one, never a mix; a failed publish leaves nothing visible. Every publish writes to
folders of its own, which only its manifest names, so a writer that is refused has touched nothing that others read. One
writer at a time: the manifest of a version is put in place by an operation that fails if it is there, so of two writers
that began with the same version the second is refused. The manifest holds a high-water mark of ids for each table, so ids of
deleted rows don't come back.

The rows of a table lie in buckets by a hash of their key, and the manifest names one folder for each bucket. A change of some rows reads and writes the
buckets of their keys alone; the other buckets stay where they are, and old versions stay readable. The manifest also holds the last batch of each
stream that publishes here, put in place in the same step as the batch's rows, so a batch that is replayed publishes nothing twice.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.constants import SCHEMA_VERSION

#: Fixed column lists of the library's tables.
TABLES = {
    "photos": "id bigint, path string, mtime double, size bigint, width bigint, height bigint, exif_date string, exif_lat double, exif_lon double, phash string, analyzed_at double",
    "persons": "id bigint, name string, color string",
    "faces": "id bigint, photo_id bigint, person_id bigint, x double, y double, w double, h double, embedding array<float>, pinned boolean, confidence double",
    "tags": "id bigint, name string",
    "photo_tags": "photo_id bigint, tag_id bigint",
}


#: What the buckets of a table go by. The faces of a photo lie together.
KEYS = {"photos": "id", "persons": "id", "faces": "photo_id", "tags": "id", "photo_tags": "photo_id"}
#: Buckets of a table that is written for the first time; a bucket is one task's work, so large libraries take about one for a million rows.
BUCKETS = 16


class NewerStoreError(RuntimeError):
    """The store was written by a later version of this engine."""


class StaleVersionError(RuntimeError):
    """Another writer has published since this one began; nothing was changed."""


class Store:
    """A folder in any store that Spark's file systems reach."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        #: Of the running transaction, by table: the rows, and the buckets that they are all rows of; None for all buckets.
        self._pending: dict[str, tuple[DataFrame, set[int] | None]] | None = None
        self._batch: tuple[str, int] | None = None
        found = self._manifests()
        if not found:
            self._write_manifest({"version": 0, "schema": SCHEMA_VERSION, "tables": {}, "next_id": {}})
        elif self.manifest()["schema"] > SCHEMA_VERSION:
            raise NewerStoreError(f"schema {self.manifest()['schema']} is newer than {SCHEMA_VERSION}")
        elif self.manifest()["schema"] < SCHEMA_VERSION:
            self._migrate()

    def _manifests(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json") and not s.getPath().getName().startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest, or that of an older version."""
        stream = self._fs.open(self._path(f"{self.path}/manifests/{self._manifests()[-1] if version is None else version}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write_manifest(self, content: dict) -> None:
        target = self._path(f"{self.path}/manifests/{content['version']}.json")
        draft = self._path(f"{self.path}/manifests/.{content['version']}-{uuid.uuid4().hex}.draft")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        if not self._put(draft, target):
            self._fs.delete(draft, False)
            raise StaleVersionError(f"version {content['version']} is there already: another writer was first")

    def _put(self, draft, target) -> bool:
        """Give ``draft`` the name ``target`` unless that is taken, in one step."""
        if self._fs.exists(target):
            return False
        if self._fs.getUri().getScheme() != "file":
            return self._fs.rename(draft, target)
        # A local rename replaces what is there; a second name for the file does not.
        files, paths = self.spark.sparkContext._jvm.java.nio.file.Files, self.spark.sparkContext._jvm.java.nio.file.Paths
        name = lambda p: paths.get(self._fs.makeQualified(p).toUri())
        try:
            files.createLink(name(target), name(draft))
        except Py4JJavaError:
            return False
        files.delete(name(draft))
        return True

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table of the newest version, of the running transaction, or of an older version; empty if never written."""
        if version is None and self._pending is not None and table in self._pending:
            rows, buckets = self._pending[table]
            return rows if buckets is None else rows.unionByName(self._stored(table, self._others(table, buckets)))
        return self._stored(table, None, version)

    def _entry(self, table: str, version: int | None = None) -> dict | None:
        """The number of a table's buckets and their folders; a table from before there were buckets is one folder without a number."""
        found = self.manifest(version)["tables"].get(table)
        return {"buckets": 0, "folders": {"": found}} if isinstance(found, str) else found

    def _others(self, table: str, buckets: set[int]) -> set[int]:
        entry = self._entry(table)
        return {int(k) for k in entry["folders"]} - buckets if entry else set()

    def _stored(self, table: str, buckets: set[int] | None, version: int | None = None) -> DataFrame:
        """The rows of some buckets as they are stored, or of all."""
        entry = self._entry(table, version)
        folders = [f for k, f in entry["folders"].items() if buckets is None or not k or int(k) in buckets] if entry else []
        if not folders:
            return self.spark.createDataFrame([], TABLES[table])
        read = self.spark.read if entry["buckets"] == 0 else self.spark.read.schema(TABLES[table])
        return read.parquet(*(f"{self.path}/{f}" for f in folders))

    def _buckets(self, table: str) -> int:
        entry = self._entry(table)
        return entry["buckets"] if entry and entry["buckets"] else self.buckets

    def bucket(self, table: str) -> Column:
        """The bucket that a row of the table belongs to."""
        return F.pmod(F.xxhash64(F.col(KEYS[table]).cast("bigint")), F.lit(self._buckets(table))).cast("int")

    def next_id(self, table: str) -> int:
        return int(self.manifest()["next_id"].get(table, 1))

    def touched(self, table: str, keys: DataFrame | list[int]) -> set[int]:
        """The buckets of these keys (a list, or a column of the key's name)."""
        if isinstance(keys, list):
            keys = self.spark.createDataFrame([(k,) for k in keys], f"{KEYS[table]} bigint")
        return {r["bucket"] for r in keys.select(self.bucket(table).alias("bucket")).distinct().collect()}

    def rows_of(self, table: str, buckets: set[int]) -> DataFrame:
        """All rows of these buckets."""
        entry = self._entry(table)
        if self._pending is not None and table in self._pending or entry and not entry["buckets"]:
            return self.read(table).where(self.bucket(table).isin(*buckets)) if buckets else self.read(table).limit(0)
        return self._stored(table, buckets)

    def write(self, **tables: DataFrame) -> None:
        """Replace tables: at once, or with the running transaction when it ends well."""
        with self.transaction():
            self._pending.update({name: (rows, None) for name, rows in tables.items()})

    def update(self, table: str, keys: DataFrame | list[int] | set[int], change: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the rows of some buckets by what ``change`` makes of them: those of the keys, or a set of buckets.

        ``change`` gets all rows of these buckets, and its rows must belong to them; one that doesn't is an error. Keys of new rows count too.
        """
        with self.transaction():
            entry = self._entry(table)
            buckets = keys if isinstance(keys, set) else self.touched(table, keys)
            if not buckets:
                return
            rows = change(self.rows_of(table, buckets))
            own = self.bucket(table)
            checked = rows.where(F.when(own.isin(*buckets), True).otherwise(F.raise_error(F.lit(f"a changed row of {table} belongs to another bucket")).cast("boolean")))
            before, covered = self._pending.get(table, (None, set()))
            if before is None and entry and not entry["buckets"]:
                before, covered = self.read(table), None
            if before is None:
                self._pending[table] = (checked, buckets)
            else:
                self._pending[table] = (before.where(~own.isin(*buckets)).unionByName(checked), None if covered is None else covered | buckets)

    @contextmanager
    def transaction(self):
        """Collects writes; the outermost one publishes them together, and an error drops them all."""
        if self._pending is not None:
            yield self
            return
        self._pending = {}
        base = self.manifest()
        try:
            yield self
            if self._pending or self._batch:
                self._publish(base)
        finally:
            self._pending = None

    def once(self, stream: str, batch: int, work: Callable[[], object]) -> bool:
        """Runs ``work`` as one transaction that also records the stream's batch; False, and nothing is done, if that batch or a later one has been published."""
        if self.manifest().get("batches", {}).get(stream, -1) >= batch:
            return False
        self._batch = (stream, batch)
        try:
            with self.transaction():
                work()
        finally:
            self._batch = None
        return True

    def _publish(self, base: dict) -> None:
        version, publish = base["version"] + 1, uuid.uuid4().hex[:12]
        tables, marks, batches = dict(base["tables"]), dict(base["next_id"]), dict(base.get("batches", {}))
        if self._batch:
            if batches.get(self._batch[0], -1) >= self._batch[1]:
                raise StaleVersionError(f"batch {self._batch[1]} of {self._batch[0]} has been published since")
            batches[self._batch[0]] = self._batch[1]
        written = []
        try:
            for name, (rows, buckets) in self._pending.items():
                folder = f"data/{name}-{version}-{publish}"
                written.append(folder)
                number = self._buckets(name)
                rows.withColumn("bucket", self.bucket(name)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
                made = {s.getPath().getName().removeprefix("bucket=") for s in self._fs.listStatus(self._path(f"{self.path}/{folder}")) if s.isDirectory()}
                kept = {} if buckets is None else {k: f for k, f in (self._entry(name) or {"folders": {}})["folders"].items() if int(k) not in buckets}
                tables[name] = {"buckets": number, "folders": kept | {k: f"{folder}/bucket={k}" for k in sorted(made)}}
                if "id" in rows.columns and made:
                    top = self.spark.read.schema("id bigint").parquet(*(f"{self.path}/{folder}/bucket={k}" for k in made)).agg(F.max("id")).first()[0]
                    marks[name] = max(marks.get(name, 1), 1 if top is None else int(top) + 1)
            self._write_manifest({"version": version, "schema": SCHEMA_VERSION, "tables": tables, "next_id": marks, "batches": batches})
        except Exception:
            for folder in written:
                self._fs.delete(self._path(f"{self.path}/{folder}"), True)
            raise

    def _migrate(self) -> None:
        """Bring the tables to this schema, with one manifest: columns that are missing come as nulls. The old version stays as it is."""
        base = self.manifest()
        moved = {}
        for name, schema in TABLES.items():
            if name in base["tables"]:
                entry = self._entry(name)
                rows = self.spark.read.option("mergeSchema", True).parquet(*(f"{self.path}/{f}" for f in entry["folders"].values())) if entry["folders"] else self.spark.createDataFrame([], schema)
                fields = self.spark.createDataFrame([], schema).schema.fields
                moved[name] = rows.select(*(F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields))
        if not moved:
            self._write_manifest(base | {"version": base["version"] + 1, "schema": SCHEMA_VERSION})
            return
        with self.transaction():
            self._pending.update({name: (rows, None) for name, rows in moved.items()})
