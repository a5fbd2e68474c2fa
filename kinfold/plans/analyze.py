"""Bringing a library up to date with a folder, from listing to regrouped persons, one publish for each batch of photos."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener

from kinfold import constants as C
from kinfold import runtime
from kinfold.operators import clustering, edits, matching, sync
from kinfold.operators.ranking import ranked
from kinfold.options import Options
from kinfold.sources import folders, images
from kinfold.sources.store import Store

_BOX = ("x", "y", "w", "h")
#: Photos that are read, detected and published together.
BATCH_PHOTOS = 4096
#: More detections than any photo has.
MOST_DETECTIONS = 1 << 20


@dataclass(frozen=True)
class Progress:
    """What one run did: photos listed, analyzed, failed and gone, and faces found; whether it was cancelled."""

    listed: int
    analyzed: int
    failed: int
    gone: int
    faces: int
    cancelled: bool = False


def analyze_folder(
    spark: SparkSession,
    store: Store,
    folder: str,
    make_engine: Callable[[], images.Engine],
    options: Options | None = None,
    now: float = 0.0,
    regroup: bool = True,
    batch_photos: int = BATCH_PHOTOS,
    on_progress: Callable[[int, int, str], None] | None = None,
    cancelled: Callable[[], bool] | None = None,
) -> Progress:
    """Analyze what is new or changed below ``folder`` and drop what is gone; unchanged files are not opened.

    A missing folder or an engine that can't be made fails before anything is changed; a picture that can't be
    decoded or on which the engine fails is left for the next run. What is gone is dropped first. The other photos go in batches in the
    order of their paths, and each batch is published with its faces, so a run that breaks off is taken up after its last
    batch. Faces of changed photos inherit pinned persons by overlap. At the end the new faces are assigned greedily and
    then all are regrouped, each as one publish.

    ``on_progress(done, total, path)`` is called before each batch with its first path. ``cancelled()`` is asked before each batch; once it
    says so, no further batch is read, what was published is still assigned greedily, and nothing is regrouped.
    """
    options = options or Options()
    make_engine()
    listed = runtime.materialize(images.listing(spark, folder), "listing")
    state = runtime.materialize(sync.classify(store.read("photos"), listed), "state")
    by = {r["state"]: r["count"] for r in state.groupBy("state").count().collect()}
    if by.get("gone"):
        gone = state.where("state = 'gone'").select("id", F.col("id").alias("photo_id"))
        with store.transaction():
            for name, key in (("photos", "id"), ("faces", "photo_id"), ("photo_tags", "photo_id")):
                store.update(name, gone.select(key), lambda rows, key=key: rows.join(gone.select(key), key, "left_anti").select(*rows.columns))
    total, done, analyzed, failed, stopped = by.get("new", 0) + by.get("changed", 0), 0, 0, 0, False
    # Faces from this id on are of this run.
    first_new = store.next_id("faces")
    # The work is cut into batches once; each batch reads its own part.
    todo = ranked(state.where("state IN ('new', 'changed')").join(listed, "path").select("path", "id", "mtime", "size"), "path")
    place = runtime.scratch_path(spark, "batches")
    todo.withColumn("batch", F.floor(F.col("place") / batch_photos).cast("bigint")).drop("place").write.partitionBy("batch").parquet(place)
    for number in range(math.ceil(total / batch_photos)):
        work = spark.read.schema("path string, id bigint, mtime double, size bigint, batch bigint").parquet(place).where(F.col("batch") == number).drop("batch")
        paths = [r["path"] for r in work.select("path").orderBy("path").collect()]
        if stopped := bool(cancelled and cancelled()):
            break
        if on_progress:
            on_progress(done, total, paths[0])
        made, bad = _analyze_batch(spark, store, work, paths, make_engine, now)
        done, analyzed, failed = done + len(paths), analyzed + made, failed + bad
    fresh = store.read("faces").where((F.col("id") >= first_new) & ~F.col("pinned")).select("id")
    found = fresh.count()
    if found:
        _publish(store, clustering.apply_greedy(store.read("faces"), store.read("persons"), fresh, options.clustering_threshold))
    if regroup and not stopped:
        _publish(store, clustering.regroup(store.read("faces"), store.read("persons"), options.clustering_threshold))
    return Progress(sum(n for s, n in by.items() if s != "gone"), analyzed, failed, by.get("gone", 0), found, stopped)


def _publish(store: Store, done: clustering.Regrouped) -> None:
    store.write(faces=done.faces, persons=done.persons)


def _analyze_batch(spark: SparkSession, store: Store, work: DataFrame, paths: list[str], make_engine: Callable[[], images.Engine], now: float) -> tuple[int, int]:
    """Read, detect and publish the photos of ``work`` (path, id, mtime, size), which has these paths; how many were analyzed, and how many were not.

    Only the buckets of these photos are read and written.
    """
    # One read decodes the pictures, and one pass over them gives hashes and detections.
    seen = runtime.materialize(images.analyzed(images.decoded(spark, paths), make_engine), "analyzed")
    good = seen.where("NOT failed")
    facts = good.select("path", "width", "height", "phash").join(images.metadata(images.contents(spark, paths)), "path")
    rows = work.join(facts, "path").select(
        "id", "path", "mtime", "size", F.col("width").cast("bigint").alias("width"), F.col("height").cast("bigint").alias("height"), "exif_date", "exif_lat", "exif_lon", "phash", F.lit(float(now)).alias("analyzed_at")
    )
    # New photos get the next ids in the order of their paths.
    fresh_photos = ranked(rows.where("id IS NULL"), "path").withColumn("id", (F.col("place") + store.next_id("photos")).cast("bigint"))
    rows = runtime.materialize(rows.where("id IS NOT NULL").union(fresh_photos.select(*rows.columns)), "facts")
    made = rows.count()
    if made:
        touched = rows.select(F.col("id").alias("photo_id"), "path")
        dets = good.select("path", F.posexplode("detections").alias("at", "d")).select("path", "at", "d.*").join(touched, "path")
        # Detections are numbered within their photo, so two with one box are two.
        dets = dets.withColumn("det_id", F.col("photo_id") * MOST_DETECTIONS + F.col("at")).select("det_id", "photo_id", *_BOX, "confidence", "embedding")
        buckets = store.touched("faces", touched)
        old = store.rows_of("faces", buckets)
        fresh = matching.reanalyzed(old.join(touched, "photo_id", "left_semi").select(*old.columns), dets)
        fresh = fresh.select("photo_id", F.col("person_id").cast("bigint").alias("person_id"), *_BOX, "embedding", "pinned", "confidence")
        with store.transaction():
            store.update("photos", rows.select("id"), lambda photos: photos.join(rows.select("id"), "id", "left_anti").select(*photos.columns).unionByName(rows))
            store.update("faces", buckets, lambda faces: edits.add_faces(faces.join(touched, "photo_id", "left_anti").select(*faces.columns), fresh, store.next_id("faces")))
    # What could not be decoded counts as failed, too: it is tried again in the next run.
    return made, len(paths) - made


def watch(spark: SparkSession, folder: str, state: str, run: Callable[[], object], clock: Callable[[], float] = time.time, poll: float = C.DEBOUNCE_SECONDS) -> DataStreamWriter:
    """Calls ``run`` once for each batch of files below ``folder`` that were made, changed, renamed or deleted; a run that repeats after a failure finds nothing to do.

    ``state`` is a folder of this watch alone: the listings that changes are told from, and the times of runs. Files that change while a run is going on
    start no other run, as that run's own writes would else set off the next one, also after a restart; the next run lists them anyway.
    """
    runs_path = f"{state.rstrip('/')}/runs"

    def on_batch(batch: DataFrame, number: int) -> None:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(runs_path)
        if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            # Later batches hold changes after those before, so the last run is enough.
            last = spark.read.schema("start_s double, end_s double").parquet(runs_path).agg(F.max(F.struct("end_s", "start_s")).alias("r")).first()["r"]
            if last is not None:
                ts = F.unix_micros("ts") / 1e6
                batch = batch.where(~((ts >= last["start_s"]) & (ts < last["end_s"])))
        if not batch.isEmpty():
            began = clock()
            run()
            spark.createDataFrame([(began, clock())], "start_s double, end_s double").coalesce(1).write.mode("append").parquet(runs_path)

    return folders.events(spark, folder, f"{state.rstrip('/')}/listings", poll).writeStream.foreachBatch(on_batch)


class ProgressListener(StreamingQueryListener):
    """Tells how far a stream of photos is: ``told(done, path)`` after each batch, from what ``counted`` observes in it."""

    def __init__(self, told: Callable[[int, str], None], name: str = "kinfold"):
        self.told, self.name = told, name
        #: Photos so far, for each run of a query.
        self.done: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        """Counting begins with the first batch."""

    def onQueryProgress(self, event) -> None:
        seen, run = event.progress.observedMetrics.get(self.name), str(event.progress.runId)
        if seen is not None and seen["photos"]:
            self.done[run] = self.done.get(run, 0) + seen["photos"]
            self.told(self.done[run], seen["path"])

    def onQueryIdle(self, event) -> None:
        """Nothing has come, so there is nothing to tell."""

    def onQueryTerminated(self, event) -> None:
        self.done.pop(str(event.runId), None)


def counted(photos: DataFrame, name: str = "kinfold") -> DataFrame:
    """``photos`` (path and others), of which a listener is told the number and the last path of each batch."""
    return photos.observe(name, F.count(F.lit(1)).alias("photos"), F.max("path").alias("path"))


def publish_stream(store: Store, name: str, rows: DataFrame, put: Callable[[DataFrame], object]) -> DataStreamWriter:
    """Publishes each micro-batch of ``rows`` once: ``put`` writes it to the store, and the batch's number goes into the same manifest.

    A batch that is replayed, after a crash between the publish and Spark's own note of it, finds its number there and changes nothing. The
    batch is written once before it is put, so what it comes from is worked out once, however often ``put`` reads it.
    """

    def on_batch(batch: DataFrame, number: int) -> None:
        store.once(name, number, lambda: put(runtime.materialize(batch, "arrived")))

    return rows.writeStream.foreachBatch(on_batch)
