"""Integrity of model files: expected hash and size against what lies in a folder."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kinfold import runtime
from kinfold.sources.folders import entries, is_local, local_path


#: Bytes of a file that are held at once.
PIECE = 4 << 20


class OneFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class DigestReader(DataSourceReader):
    """One task for each file, which goes through it piece by piece; so files of any size are fine."""

    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[OneFile]:
        return [OneFile(p) for p in entries(self.folder)[1]]

    def read(self, partition: OneFile):
        digest, size = hashlib.sha256(), 0
        with open(partition.path, "rb") as file:
            while piece := file.read(PIECE):
                digest.update(piece)
                size += len(piece)
        yield os.path.basename(partition.path), size, digest.hexdigest()


class DigestSource(DataSource):
    """``spark.read.format("kinfold_digests").load(folder)``: name, size and SHA-256 of the files in a folder of a mounted file system, empty ones included."""

    @classmethod
    def name(cls) -> str:
        return "kinfold_digests"

    def schema(self) -> str:
        return "name string, size bigint, sha256 string"

    def reader(self, schema) -> DigestReader:
        return DigestReader(local_path(self.options["path"]))


def model_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, size, sha256) of the files in a folder. In stores that are not mounted Spark reads the files, whole ones of up to 2 GB."""
    if is_local(folder):
        runtime.ship_package(spark)
        spark.dataSource.register(DigestSource)
        return spark.read.format("kinfold_digests").load(folder)
    # Spark's file sources leave empty files out, so names come from the listing.
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    listed = spark.createDataFrame([(f.getPath().getName(), f.getLen()) for f in found if f.isFile()], "name string, size bigint")
    read = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))
    return listed.join(read, "name", "left")


def problem(found_size: Column, found_hash: Column, want_size: Column, pinned: Column, recorded: Column) -> Column:
    """Why a file isn't acceptable, or null. In this order: missing, empty, wrong size, no known hash, wrong hash."""
    want = F.coalesce(F.lower(pinned), F.lower(recorded))
    return (
        F.when(found_size.isNull(), "missing")
        .when(found_size == 0, "empty")
        .when(want_size.isNotNull() & (want_size != found_size), "size mismatch")
        .when(want.isNull(), "no known hash")
        .when(want != F.lower(found_hash), "checksum mismatch")
    )


def problems(catalog: DataFrame, files: DataFrame, recorded: DataFrame) -> DataFrame:
    """(name, problem) of each model of ``catalog`` (name, sha256, size) that ``files`` (name, size, sha256) lacks or has wrong.

    ``recorded`` (name, sha256) has hashes that were trusted on first use; a pinned hash goes before.
    """
    own = files.select("name", F.col("size").alias("found_size"), F.col("sha256").alias("found_hash"))
    known = recorded.select("name", F.col("sha256").alias("recorded"))
    rows = catalog.join(own, "name", "left").join(known, "name", "left")
    reason = problem(F.col("found_size"), F.col("found_hash"), F.col("size"), F.col("sha256"), F.col("recorded"))
    return rows.select("name", reason.alias("problem")).where("problem IS NOT NULL")


def first_uses(catalog: DataFrame, files: DataFrame, recorded: DataFrame) -> DataFrame:
    """(name, sha256) to be recorded where the owner trusts files on first use: those of the catalogue whose hash is neither pinned nor recorded, and that have no other problem."""
    unknown = problems(catalog, files, recorded).where("problem = 'no known hash'").select("name")
    return files.join(unknown, "name").select("name", F.lower("sha256").alias("sha256"))


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256) of the record of first use at ``path``; of several entries of a name the first one counts."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], "name string, sha256 string")
    rows = spark.read.schema("name string, sha256 string, at double").parquet(path)
    return rows.groupBy("name").agg(F.min_by("sha256", F.struct("at", "sha256")).alias("sha256"))


def record_first_uses(spark: SparkSession, catalog: DataFrame, files: DataFrame, path: str, now: float) -> DataFrame:
    """Appends to the record what is to be trusted on first use, and returns the problems that are left."""
    rows = runtime.materialize(first_uses(catalog, files, recorded(spark, path)), "first-uses", narrow=0)
    if not rows.isEmpty():
        rows.withColumn("at", F.lit(float(now))).coalesce(1).write.mode("append").parquet(path)
    return problems(catalog, files, recorded(spark, path))
