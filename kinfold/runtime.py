"""What every operator needs from the session: a shared folder to cut lineage in, and the package on the executors."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Bytes of rows that a task sends to Python at once, unless the session says otherwise: long texts make batches of few rows.
_BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"
_shipped: set[str] = set()
_scopes: list[list[str]] = []
_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a ``local`` master may go without the setting; it then gets a folder of its own,
    which is removed when the process ends.
    """
    named = spark.conf.get(_CHECKPOINT_KEY, None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError(f"{_CHECKPOINT_KEY} must name a folder that all executors share")
    if context.applicationId not in _local_dirs:
        made = tempfile.mkdtemp(prefix="kinfold-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _local_dirs[context.applicationId] = f"file://{made}"
    return _local_dirs[context.applicationId]


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path under the shared folder, never used before."""
    path = f"{shared_dir(spark)}/kinfold/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what was materialized within; nothing that reads it may be run later."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, tag: str, narrow: int = 1) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The copy survives the loss of any executor, and every later reader sees the same rows
    even if ``df`` holds an expression whose value depends on how tasks ran. A table of few bytes a row, the result of a shuffle, is
    written in ``narrow`` times fewer files than a shuffle has partitions; 0 is one file, for a few rows.
    """
    path = scratch_path(df.sparkSession, tag)
    if narrow != 1:
        files = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // narrow if narrow else 1
        df = df.coalesce(max(1, files))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few numbers that are broadcast, at most: some 50 MB.
BROADCAST_ROWS = 1_000_000


def if_small(df: DataFrame, rows: int, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, of ``rows`` narrow rows at most, with a hint to broadcast it if these are no more than ``most_rows``; else it joins by a shuffle."""
    return F.broadcast(df) if rows <= most_rows else df


def spare_name(df: DataFrame, wanted: str) -> str:
    """``wanted`` with as many underscores before it as make it a name that ``df`` has no column of, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    name = f"_{wanted}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that nobody holds any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_scratch(spark: SparkSession) -> None:
    """Delete all that this application materialized. Call it once its results are written."""
    _delete(spark, f"{shared_dir(spark)}/kinfold/{spark.sparkContext.applicationId}")


def ship_package(spark: SparkSession) -> None:
    """Put this package on the executors' path, once for each application, and bound the batches that its functions get."""
    context = spark.sparkContext
    if _BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(_BATCH_KEY, BATCH_BYTES)
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="kinfold-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "kinfold.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as packed:
        for file in sorted(root.rglob("*.py")):
            packed.write(file, str(Path("kinfold") / file.relative_to(root)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the tables that lie as Parquet in ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
