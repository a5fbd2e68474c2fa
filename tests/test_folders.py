"""Folders as tables and streams: exact listings, odd names, turned pictures, events across restarts."""

import os
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.sources import folders, images, store


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(pixels, orientation=None):
    """A PNG of red, green and blue rows, with an EXIF block where an orientation is given."""
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    tiff = b"MM\0*" + struct.pack(">IHHHIHHI", 8, 1, 0x0112, 3, 1, orientation or 1, 0, 0)
    exif = chunk(b"eXIf", tiff) if orientation else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + exif + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


ODD_NAMES = ["plain.png", "a b.png", "100%.png", "x#y.png", "a+b.png", "é ü.png", "%20.png", "q?.png", "[1].png", "{a,b}.png", "_under.png", ".dot.png", "semi;colon&.PNG"]


def test_listing_is_exact(spark, tmp_path):
    for name in (".x/a.png", "_x/b.png", "sub/deep/er/c.JPG", "d.png", ".e.png", "_f.png", "no.txt", ".png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * len(name))
    os.symlink(tmp_path / "gone.png", tmp_path / "dangling.png")
    os.symlink(tmp_path / "d.png", tmp_path / "linked.png")
    os.symlink(tmp_path / "sub", tmp_path / "loop")
    os.utime(tmp_path / "d.png", (1.5, 1700000000.123456))
    rows = {os.path.relpath(r["path"], tmp_path): r for r in images.listing(spark, f"file://{tmp_path}").collect()}
    assert sorted(rows) == sorted([".x/a.png", "_x/b.png", "sub/deep/er/c.JPG", "d.png", ".e.png", "_f.png", "linked.png"])
    assert rows["d.png"]["mtime"] == os.stat(tmp_path / "d.png").st_mtime and rows["_f.png"]["size"] == 6
    with pytest.raises(FileNotFoundError, match="does not exist"):
        images.listing(spark, f"{tmp_path}/gone")


def test_many_directories_are_dealt_out(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"d{k}" / "e").mkdir(parents=True)
        (tmp_path / f"d{k}" / "e" / "f.png").write_bytes(b"1")
        (tmp_path / f"d{k}" / "g.png").write_bytes(b"1")
    parts = folders.FolderReader(str(tmp_path)).partitions()
    assert len(parts) == 41 and sum(p.below for p in parts) == 40
    assert folders.files(spark, str(tmp_path)).count() == 80


def test_an_unreadable_directory_is_an_error(monkeypatch, tmp_path):
    (tmp_path / "a" / "shut").mkdir(parents=True)
    real = os.scandir

    def scan(path):
        if str(path).endswith("shut"):
            raise PermissionError(13, "Permission denied", path)
        return real(path)

    monkeypatch.setattr(os, "scandir", scan)
    with pytest.raises(PermissionError):
        list(folders.walked(str(tmp_path)))
    with pytest.raises(PermissionError):
        folders.FolderReader(str(tmp_path)).partitions()


@pytest.mark.parametrize("orientation", [None, 1, 2, 3, 4, 5, 6, 7, 8])
def test_orientation_by_pixel(orientation):
    pixels = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    a, b, c, d, e, f = (pixels[i, j].tolist() for i in range(2) for j in range(3))
    wanted = {
        2: [[c, b, a], [f, e, d]], 3: [[f, e, d], [c, b, a]], 4: [[d, e, f], [a, b, c]], 5: [[a, d], [b, e], [c, f]],
        6: [[d, a], [e, b], [f, c]], 7: [[f, c], [e, b], [d, a]], 8: [[c, f], [b, e], [a, d]],
    }.get(orientation, [[a, b, c], [d, e, f]])
    assert images.upright(pixels, orientation).tolist() == wanted


def test_odd_names_and_turned_pictures_end_to_end(spark, tmp_path):
    from kinfold.plans.analyze import analyze_folder

    class CornerEngine:
        """One box at the brightest pixel."""

        def detect_and_embed(self, pixels):
            y, x = np.unravel_index(int(pixels.sum(axis=2).argmax()), pixels.shape[:2])
            return [images.Detection(float(x), float(y), 1.0, 1.0, 0.9, [1.0, 0.0])]

    folder = tmp_path / "in"
    folder.mkdir()
    for k, name in enumerate(ODD_NAMES):
        pixels = np.full((16, 24, 3), 5, dtype=np.uint8)
        pixels[2, 3] = 200
        (folder / name).write_bytes(png(pixels, k % 9 or None))
    (folder / "broken pic.png").write_bytes(b"nothing")
    (folder / "new.webp").write_bytes(b"RIFF")
    lib = store.Store(spark, f"file://{tmp_path}/lib")
    done = analyze_folder(spark, lib, f"file://{folder}", CornerEngine, now=1.0)
    assert (done.listed, done.analyzed, done.failed) == (len(ODD_NAMES) + 2, len(ODD_NAMES), 2)
    photos = {os.path.basename(r["path"]): r for r in lib.read("photos").collect()}
    assert sorted(photos) == sorted(ODD_NAMES)
    boxes = {r["photo_id"]: (r["x"], r["y"]) for r in lib.read("faces").collect()}
    places = {1: (3, 2), 2: (20, 2), 3: (20, 13), 4: (3, 13), 5: (2, 3), 6: (13, 3), 7: (13, 20), 8: (2, 20)}
    for k, name in enumerate(ODD_NAMES):
        turn = k % 9 or 1
        assert (photos[name]["width"], photos[name]["height"]) == ((16, 24) if turn > 4 else (24, 16)), name
        assert boxes[photos[name]["id"]] == places[turn], name
    # The hash is that of the raster, so turning changes nothing.
    assert len({p["phash"] for p in photos.values()}) == 1
    again = analyze_folder(spark, lib, f"file://{folder}", CornerEngine, now=2.0)
    assert (again.analyzed, again.failed) == (0, 2)


def test_events_come_once_across_restarts(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    put = lambda name, body=b"x": ((folder / name).parent.mkdir(parents=True, exist_ok=True), (folder / name).write_bytes(body))
    put("a.png"), put("sub/b.png"), put("sub/c.png"), put("_d.png")
    batches = []

    def run():
        def on_batch(batch, number):
            batches.append(sorted((r["kind"], os.path.relpath(r["path"], folder), r["old_path"] and os.path.relpath(r["old_path"], folder)) for r in folders.with_renames(batch).collect()))

        stream = folders.events(spark, f"file://{folder}", f"{tmp_path}/snapshots", poll=0.001).writeStream.foreachBatch(on_batch)
        query = stream.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
        time.sleep(0.01)
        return batches.pop() if batches else []

    assert run() == [("created", n, None) for n in ("_d.png", "a.png", "sub/b.png", "sub/c.png")]
    assert run() == []
    put("a.png", b"longer")
    put("later/deep/e.png")
    os.unlink(folder / "_d.png")
    os.rename(folder / "sub/b.png", folder / "later/moved.png")
    os.rename(folder / "sub/c.png", folder / "sub/c2.png")
    assert run() == [("changed", "a.png", None), ("created", "later/deep/e.png", None), ("deleted", "_d.png", None), ("renamed", "later/moved.png", "sub/b.png"), ("renamed", "sub/c2.png", "sub/c.png")]
    assert run() == []
    for name in ("later/deep/e.png", "later/moved.png"):
        os.unlink(folder / name)
    os.rmdir(folder / "later/deep"), os.rmdir(folder / "later")
    assert run() == [("deleted", "later/deep/e.png", None), ("deleted", "later/moved.png", None)]
    # Only the listings that the next batch needs are kept.
    assert len(os.listdir(tmp_path / "snapshots")) <= 2


def test_a_repeated_batch_gives_the_same_events(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a").write_bytes(b"1")
    reader = folders.FolderEventsReader(str(folder), str(tmp_path / "s"), 1)
    read = lambda start, end: [r for p in reader.partitions({"at": start}, {"at": end}) for b in reader.read(p) for r in b.to_pylist()]
    first = read(0, 5)
    (folder / "b").write_bytes(b"1")
    assert [r["path"] for r in first] == [str(folder / "a")] and read(0, 5) == first
    second = read(5, 9)
    os.unlink(folder / "a")
    assert [(r["kind"], os.path.basename(r["path"])) for r in second] == [("created", "b")] and read(5, 9) == second
    reader.commit({"at": 9})
    assert [(r["kind"], os.path.basename(r["path"])) for r in read(9, 12)] == [("deleted", "a")]


def test_difference_hash_in_fixed_point():
    # A literal resampling, pixel by pixel in whole numbers.
    from math import pi, sin

    def lobe(x):
        sinc = lambda v: 1.0 if v == 0 else sin(v * pi) / (v * pi)
        return sinc(x) * sinc(x / 3) if -3 <= x < 3 else 0.0

    def reduced(row, target):
        scale = len(row) / target
        wide, out = max(scale, 1.0), []
        for t in range(target):
            middle = (t + 0.5) * scale
            lo, hi = max(int(middle - 3 * wide + 0.5), 0), min(int(middle + 3 * wide + 0.5), len(row))
            w = [lobe((x - middle + 0.5) / wide) for x in range(lo, hi)]
            w = [v / sum(w) * (1 << 22) for v in w]
            w = [int(v - 0.5) if v < 0 else int(v + 0.5) for v in w]
            out.append(min(255, max(0, (sum(a * b for a, b in zip(w, row[lo:hi], strict=True)) + (1 << 21)) >> 22)))
        return out

    rng = np.random.default_rng(2)
    for h, w in ((64, 64), (37, 121), (8, 9), (5, 4), (300, 211)):
        pixels = rng.integers(0, 256, (h, w, 3), dtype=np.uint8)
        gray = [[(int(b) * 7471 + int(g) * 38470 + int(r) * 19595 + 32768) >> 16 for b, g, r in row] for row in pixels]
        rows = [reduced(row, 9) for row in gray]
        columns = [reduced(list(c), 8) for c in zip(*rows, strict=True)]
        assert images.gray_grid(pixels).tolist() == [list(map(float, r)) for r in zip(*columns, strict=True)]


def test_watching_across_a_restart(spark, tmp_path):
    from kinfold.plans.analyze import watch

    folder = tmp_path / "in"
    folder.mkdir()
    runs = []

    def run():
        runs.append(len(runs))
        if len(runs) == 1:
            # What a run makes itself starts no other, also when the watch is begun anew.
            (folder / "made-by-the-run").write_bytes(b"x")
            time.sleep(0.05)

    def look():
        time.sleep(0.05)
        query = watch(spark, f"file://{folder}", f"file://{tmp_path}/state", run, poll=0.001).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()

    (folder / "a").write_bytes(b"x")
    for _ in range(3):
        look()
    assert runs == [0]
    (folder / "b").write_bytes(b"x")
    look()
    look()
    assert runs == [0, 1]
    os.rename(folder / "b", folder / "c")
    look()
    os.unlink(folder / "c")
    look()
    assert runs == [0, 1, 2, 3]


def test_an_edit_writes_its_bucket_only(spark, tmp_path):
    from kinfold.operators import edits

    lib = store.Store(spark, f"file://{tmp_path}/lib", buckets=8)
    people = spark.range(1, 201).select("id", F.concat(F.lit("P"), "id").alias("name"), F.lit("#000000").alias("color"))
    lib.write(persons=people)
    before = lib.manifest()
    assert len(before["tables"]["persons"]["folders"]) == 8 and lib.next_id("persons") == 201
    lib.update("persons", [7], lambda rows: edits.rename_person(rows, 7, "Alice"))
    after = lib.manifest()
    changed = [k for k, f in after["tables"]["persons"]["folders"].items() if f != before["tables"]["persons"]["folders"][k]]
    assert len(changed) == 1 and len(os.listdir(f"{tmp_path}/lib/{after['tables']['persons']['folders'][changed[0]].rsplit('/', 1)[0]}")) <= 3
    name = lambda version=None: lib.read("persons", version).where("id = 7").first()["name"]
    assert name() == "Alice" and name(before["version"]) == "P7" and lib.read("persons").count() == 200
    # Several changes of one transaction, an insert among them; a bucket that empties goes.
    with lib.transaction():
        lib.update("persons", [7], lambda rows: rows.where("id <> 7"))
        lib.update("persons", [300], lambda rows: edits.create_person(rows, 300, "New", "#1"))
        lib.update("persons", [7], lambda rows: edits.create_person(rows, 7, "Back", "#2"))
        assert lib.read("persons").count() == 201
    assert name() == "Back" and lib.read("persons").count() == 201 and lib.next_id("persons") == 301
    other = next(k for k in range(1, 100) if not lib.touched("persons", [7]) & lib.touched("persons", [k]))
    with pytest.raises(Exception, match="belongs to another bucket"):
        lib.update("persons", [7], lambda rows: edits.create_person(rows, other, "Wrong", "#1"))
    assert lib.read("persons").count() == 201
    one = lib.touched("persons", [7])
    lib.update("persons", one, lambda rows: rows.limit(0))
    assert len(lib.manifest()["tables"]["persons"]["folders"]) == 7 and lib.rows_of("persons", one).count() == 0


def test_a_store_without_buckets_is_read_and_moved(spark, tmp_path):
    lib = store.Store(spark, f"file://{tmp_path}/lib", buckets=4)
    lib.write(tags=spark.createDataFrame([(1, "a"), (2, "b")], store.TABLES["tags"]))
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], store.TABLES["tags"]).write.parquet(f"{tmp_path}/lib/data/flat")
    content = lib.manifest()
    lib._write_manifest(content | {"version": content["version"] + 1, "tables": {"tags": "data/flat"}})
    assert lib.read("tags").count() == 3 and lib.rows_of("tags", lib.touched("tags", [2])).where("id = 2").count() == 1
    lib.update("tags", [2], lambda rows: rows.withColumn("name", F.when(F.col("id") == 2, "z").otherwise(F.col("name"))))
    assert sorted(tuple(r) for r in lib.read("tags").collect()) == [(1, "a"), (2, "z"), (3, "c")] and lib.manifest()["tables"]["tags"]["buckets"] == 4


def test_batches_are_published_once(spark, tmp_path):
    from kinfold.plans.analyze import ProgressListener, counted, publish_stream

    lib = store.Store(spark, f"file://{tmp_path}/lib", buckets=4)
    (tmp_path / "in").mkdir()
    put = lambda k: spark.createDataFrame([(k, f"t{k}")], store.TABLES["tags"]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    add = lambda batch: lib.update("tags", batch.select("id"), lambda rows: rows.unionByName(batch))
    told = []
    listener = ProgressListener(lambda done, path: told.append((done, path)), "tags")
    spark.streams.addListener(listener)

    def run(checkpoint):
        rows = spark.readStream.schema(store.TABLES["tags"]).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        rows = counted(rows.withColumn("path", F.col("name")), "tags").drop("path")
        publish_stream(lib, "tags-in", rows, add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    try:
        put(1), put(2)
        run(f"{tmp_path}/cp")
        assert lib.read("tags").count() == 2 and lib.manifest()["batches"] == {"tags-in": 1}
        version = lib.manifest()["version"]
        # Spark's note of the last batch is lost, as in a crash after the publish: the batch is replayed.
        commits = tmp_path / "cp/commits"
        for name in ("1", ".1.crc"):
            if (commits / name).exists():
                (commits / name).unlink()
        run(f"{tmp_path}/cp")
        assert lib.read("tags").count() == 2 and lib.manifest()["version"] == version
        put(3)
        run(f"{tmp_path}/cp")
        assert sorted(r["id"] for r in lib.read("tags").collect()) == [1, 2, 3] and lib.manifest()["batches"] == {"tags-in": 2}
        for _ in range(50):
            if len(told) >= 3:
                break
            time.sleep(0.1)
        assert told[:2] == [(1, "t1"), (2, "t2")] or told[:2] == [(1, "t2"), (2, "t1")]
        assert len(told) == 3 and told[-1] == (1, "t3")
    finally:
        spark.streams.removeListener(listener)
    with pytest.raises(RuntimeError, match="stop"):
        lib.once("other", 5, lambda: (_ for _ in ()).throw(RuntimeError("stop")))
    assert "other" not in lib.manifest()["batches"] and lib.once("other", 5, lambda: None) and not lib.once("other", 5, lambda: None)


def test_the_engine_as_a_table_function(spark, tmp_path):
    for k in range(4):
        pixels = np.full((12, 20, 3), 5, dtype=np.uint8)
        pixels[2, 3 + k] = 200
        (tmp_path / f"{k}.png").write_bytes(png(pixels, 6 if k == 1 else None))

    class Stub:
        def detect_and_embed(self, pixels):
            y, x = np.unravel_index(int(pixels.sum(axis=2).argmax()), pixels.shape[:2])
            if x == 5:
                raise RuntimeError("no")
            return [images.Detection(float(x), float(y), 2.0, 2.0, 0.9, [1.0, float(k)]) for k in range(0 if x == 6 else 2)]

    pictures = images.decoded(spark, [f"{tmp_path}/{k}.png" for k in range(4)])
    wanted = sorted(map(str, images.detect(pictures, Stub).collect()))
    images.register_detector(spark, Stub)
    pictures.createOrReplaceTempView("pictures")
    found = spark.sql("SELECT p.path, d.* FROM pictures p, LATERAL detect_faces(p.width, p.height, p.channels, p.data, p.orientation) d")
    assert sorted(map(str, found.select("path", "failed", "x", "y", "w", "h", "confidence", "embedding").collect())) == wanted and len(wanted) == 6
    broken = spark.sql("SELECT d.* FROM (SELECT 5 AS w, 5 AS h, 3 AS c, CAST('x' AS BINARY) AS data) t, LATERAL detect_faces(t.w, t.h, t.c, t.data, NULL) d").collect()
    assert [(r["failed"], r["x"]) for r in broken] == [(True, None)]


def test_small_pictures_are_made_once(spark, tmp_path):
    import hashlib

    for k in range(3):
        (tmp_path / f"{k}.png").write_bytes(png(np.full((40, 60, 3), 40 * k, dtype=np.uint8)))
        os.utime(tmp_path / f"{k}.png", (1, 1700000000 + k / 4))
    (tmp_path / "bad.png").write_bytes(b"no")
    photos = images.listing(spark, f"{tmp_path}")
    cache = f"file://{tmp_path}/cache"
    assert images.fill_thumbnails(spark, photos, cache, side=20, batch_photos=2) == 4
    rows = {r["key"]: r for r in images.cached_thumbnails(spark, cache).collect()}
    assert set(rows) == {hashlib.sha1(f"{tmp_path}/{k}.png:{1700000000 + k / 4!r}:20".encode()).hexdigest() for k in range(3)}
    assert {(r["width"], r["height"]) for r in rows.values()} == {(20, 13)}
    # Only what is not there is opened: the broken one, and later the changed one.
    assert images.fill_thumbnails(spark, photos, cache, side=20) == 1
    os.utime(tmp_path / "1.png", (1, 1700000009.5))
    assert images.fill_thumbnails(spark, images.listing(spark, f"{tmp_path}"), cache, side=20) == 2
    content = rows[hashlib.sha1(f"{tmp_path}/2.png:1700000000.5:20".encode()).hexdigest()]["content"]
    (tmp_path / "again.png").write_bytes(content)
    back = images.decoded(spark, [f"{tmp_path}/again.png"]).first()
    assert (back["width"], back["height"]) == (20, 13) and set(bytes(back["data"])) == {80}


def test_large_files_and_the_record_of_first_use(spark, tmp_path):
    import hashlib

    from kinfold.sources import models

    folder = tmp_path / "m"
    folder.mkdir()
    (folder / "pinned.onnx").write_bytes(b"a" * 1000)
    (folder / "loose.onnx").write_bytes(b"b" * 1000)
    (folder / "empty.onnx").write_bytes(b"")
    with open(folder / "sparse.onnx", "wb") as file:
        file.truncate(3 << 30)
    files = models.model_files(spark, f"file://{folder}")
    rows = {r["name"]: r for r in files.collect()}
    assert rows["sparse.onnx"]["size"] == 3 << 30 and rows["empty.onnx"]["sha256"] == hashlib.sha256(b"").hexdigest()
    os.unlink(folder / "sparse.onnx")
    files = models.model_files(spark, f"file://{folder}")
    good = hashlib.sha256(b"a" * 1000).hexdigest()
    catalog = spark.createDataFrame([("pinned.onnx", good.upper(), 1000), ("loose.onnx", None, None), ("empty.onnx", None, None), ("gone.onnx", None, None)], "name string, sha256 string, size bigint")
    path = f"file://{tmp_path}/record"
    told = lambda df: {r["name"]: r["problem"] for r in df.collect()}
    assert told(models.problems(catalog, files, models.recorded(spark, path))) == {"loose.onnx": "no known hash", "empty.onnx": "empty", "gone.onnx": "missing"}
    left = models.record_first_uses(spark, catalog, files, path, 1.0)
    assert told(left) == {"empty.onnx": "empty", "gone.onnx": "missing"}
    assert [(r["name"], r["sha256"]) for r in models.recorded(spark, path).collect()] == [("loose.onnx", hashlib.sha256(b"b" * 1000).hexdigest())]
    # The first record counts: another file of the name is a mismatch and is not recorded anew; a pinned hash goes before a recorded one.
    (folder / "loose.onnx").write_bytes(b"c" * 1000)
    assert told(models.record_first_uses(spark, catalog, files, path, 2.0))["loose.onnx"] == "checksum mismatch"
    pinned = spark.createDataFrame([("loose.onnx", hashlib.sha256(b"c" * 1000).hexdigest(), None)], catalog.schema)
    assert told(models.problems(pinned, files, models.recorded(spark, path))) == {}


def test_events_outside_runs_on_a_stream(spark, tmp_path):
    import json

    from kinfold.streaming.debounce import outside_runs_stream

    (tmp_path / "in").mkdir()
    second = lambda s: f"2026-01-01T00:00:{s:06.3f}Z"
    number = iter(range(100))

    def put(events=(), runs=()):
        rows = [{"id": int(s * 10), "ts": second(s)} for s in events] + [{"start_ts": second(a), **({"end_ts": second(b)} if b else {})} for a, b in runs]
        (tmp_path / "in" / f"{next(number):03}.json").write_text("\n".join(map(json.dumps, rows)))
        time.sleep(0.02)

    found = []

    def run():
        # One source, so that what happens together is read together.
        both = spark.readStream.schema("id bigint, ts timestamp, start_ts timestamp, end_ts timestamp").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
        events, runs = both.where("id IS NOT NULL").select("id", "ts"), both.where("id IS NULL").select("start_ts", "end_ts")
        stream = outside_runs_stream(events, runs, "2 seconds").writeStream.foreachBatch(lambda b, _: found.extend(r["id"] for r in b.collect()) and None)
        stream.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()

    # One run is told when it is over, a second one overlaps it, a third is open over the restart.
    put([1, 2.5, 3], [])
    put([4, 6], [(2, 3.5), (3.2, 5)])
    put([9], [(8, None)])
    run()
    # Whether the last watermark is acted upon before the stream ends is Spark's choice.
    assert found in ([10], [10, 60])
    put([12, 13], [])
    run()
    assert found == [10, 60]
    put([20], [(8, 12.5)])
    put([30], [])
    put([40], [])
    run()
    assert found in ([10, 60, 130, 200], [10, 60, 130, 200, 300])
