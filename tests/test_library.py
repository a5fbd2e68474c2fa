"""Parsers, hashes, edits, synchronizing, the store and streaming on hand-written rows."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold import runtime
from kinfold.functions import exif, media
from kinfold.operators import duplicates, edits, gallery, matching, sync
from kinfold.options import Options
from kinfold.sources import images, models, store
from kinfold.streaming import debounce, online


def values(spark, schema, rows, column):
    return [r["x"] for r in spark.createDataFrame(list(enumerate(rows)) if not isinstance(rows[0], tuple) else [(i, *r) for i, r in enumerate(rows)], "i int, " + schema).select("i", column.alias("x")).orderBy("i").collect()]


def test_capture_dates(spark):
    good = ["2021:07:04 15:30:59", " 2021:07:04T15:30:59 trailing", "2021:07:04 15:30:59\0"]
    bad = ["0000:00:00 00:00:00", "0000:01:01 00:00:00", "2021:13:01 00:00:00", "2021:02:30 10:00:00", "2021:07:04 25:00:00", "2021:07:04 10:00:60", "garbage", "", None]
    assert values(spark, "t string", good + bad, exif.capture_date(F.col("t"))) == ["2021-07-04T15:30:59"] * 3 + [None] * len(bad)


def test_degrees(spark):
    rows = [([10.0, 30.0, 0.0], "N"), ([10.0, 30.0, 0.0], "s"), ([45.0], " S\0"), ([45.0, 30.0], "North"), ([10.0, 60.0], "N"), ([-1.0], "N"), ([1.0, 2.0, 3.0, 4.0], "N"), ([], "N"), ([float("nan")], "N"), (None, "N"), ([1.0], "E"), ([1.0], None), ([1.0], "")]
    got = values(spark, "p array<double>, r string", rows, exif.dms_to_decimal(F.col("p"), F.col("r"), "N", "S"))
    assert got == [10.5, -10.5, -45.0, 45.5] + [None] * 9


def test_gps_pairs(spark):
    rows = [(40.0, -74.0), (90.0, 180.0), (91.0, 0.0), (10.0, 181.0), (0.0, 0.0), (None, 3.0), (0.0, 5.0)]
    got = values(spark, "a double, o double", rows, exif.gps(F.col("a"), F.col("o")))
    assert [g and tuple(g) for g in got] == [(40.0, -74.0), (90.0, 180.0), None, None, None, None, (0.0, 5.0)]


def test_ratios(spark):
    assert values(spark, "n double, d double", [(1.0, 2.0), (1.0, 0.0), (math.inf, 1.0), (None, 1.0)], exif.ratio(F.col("n"), F.col("d"))) == [0.5, None, None, None]


def test_names_and_colors(spark):
    import colorsys
    import hashlib

    names = ["beach", "vacation", "é"]
    hue = [int(hashlib.sha1(n.encode()).hexdigest(), 16) % 360 for n in names]
    assert values(spark, "n string", names, media.tag_hue(F.col("n"))) == hue
    rgb = ["#{:02x}{:02x}{:02x}".format(*(int(c * 255) for c in colorsys.hsv_to_rgb(h / 360, 0.6, 0.9))) for h in hue]
    assert values(spark, "n string", names, media.tag_color(F.col("n"))) == rgb
    assert values(spark, "p string", ["/a/b.JPG", "/a/.jpg", "x.tar.png", "noext"], media.extension(F.col("p"))) == [".jpg", "", ".png", ""]
    assert values(spark, "t string", [" Yes ", "0", None, "on"], media.truthy(F.col("t"))) == [True, False, False, True]


def test_hamming_and_iou(spark):
    rows = [("0000000000000001", "0000000000000003"), ("ffffffffffffffff", "0000000000000000")]
    assert values(spark, "a string, b string", rows, media.hamming(media.hash_bits(F.col("a")), media.hash_bits(F.col("b")))) == [1, 64]
    box = lambda p: tuple(F.col(f"{p}{k}") for k in range(4))
    got = values(spark, ", ".join(f"{p}{k} double" for p in "ab" for k in range(4)), [(0.0, 0.0, 2.0, 2.0, 1.0, 0.0, 2.0, 2.0), (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], media.iou(box("a"), box("b")))
    assert got == [pytest.approx(1 / 3), 0.0]


def photos_of(spark, hashes):
    return spark.createDataFrame([(i, f"/p/{i}.jpg", h) for i, h in enumerate(hashes)], "id bigint, path string, phash string")


def test_duplicate_groups(spark):
    photos = photos_of(spark, ["1000000000000000", "1000000000000003", "100000000000000f", "ffffffffffffffff", None, "0" * 16, "0" * 16, "ffff000012345678", "ffff000012345679", "ffff000012345678"])
    groups = {r["group_id"]: r["paths"] for r in duplicates.group_listing(duplicates.duplicate_groups(photos, 2)).collect()}
    assert groups == {0: "/p/0.jpg|/p/1.jpg|/p/2.jpg", 7: "/p/7.jpg|/p/8.jpg|/p/9.jpg"}
    assert duplicates.duplicate_pairs(photos, 2).count() == 5
    assert duplicates.duplicate_groups(photos.limit(0)).count() == 0


def test_rank_is_a_total_order(spark):
    photos = spark.createDataFrame([(1, "b", None), (2, None, "x"), (3, "a", "x"), (4, "a", None)], "id bigint, path string, exif_date string")
    assert [r["id"] for r in gallery.with_rank(photos).orderBy("rank").collect()] == [3, 4, 1, 2]
    assert [r["rank"] for r in gallery.with_rank(photos, "date").orderBy("id").collect()] == [2, 0, 1, 3]


def test_palette_runs_out(spark):
    from kinfold.constants import PERSON_PALETTE

    people = spark.createDataFrame([(i, "x", c) for i, c in enumerate(PERSON_PALETTE)], "id bigint, name string, color string")
    assert gallery.next_color(people).first()["color"] not in PERSON_PALETTE
    assert gallery.next_color(people.where("id <> 4")).first()["color"] == PERSON_PALETTE[4]


def test_edits(spark):
    persons = spark.createDataFrame([(1, "A", "#1"), (2, "B", "#2")], "id bigint, name string, color string")
    faces = spark.createDataFrame([(1, 1, True), (2, 2, False), (3, None, False)], "id bigint, person_id bigint, pinned boolean")
    people, moved = edits.merge_persons(persons, faces, 1, 2)
    assert [r["id"] for r in people.collect()] == [2] and {tuple(r) for r in moved.collect()} == {(1, 2, True), (2, 2, False), (3, None, False)}
    with pytest.raises(ValueError):
        edits.merge_persons(persons, faces, 1, 1)
    _, freed = edits.delete_person(persons, faces, 1)
    assert {tuple(r) for r in freed.collect()} == {(1, None, False), (2, 2, False), (3, None, False)}
    assert edits.rename_person(persons, 1, "  ").where("id = 1").first()["name"] == "A"
    tags = spark.createDataFrame([(1, "beach")], "id bigint, name string")
    links = spark.createDataFrame([], "photo_id bigint, tag_id bigint")
    tags, links = edits.tag_photo(tags, links, 5, " beach ", 2)
    tags, links = edits.tag_photo(tags, links, 5, "beach", 2)
    assert tags.count() == 1 and [tuple(r) for r in links.collect()] == [(5, 1)]
    assert edits.get_or_create_tag(tags, "   ", 9).count() == 1
    assert edits.untag_photo(links, 5, 1).count() == 0


def test_matching_is_one_to_one(spark):
    faces = spark.createDataFrame([(1, 1, 10, True, 0.0, 0.0, 10.0, 10.0), (2, 1, 20, True, 1.0, 0.0, 10.0, 10.0)], "id bigint, photo_id bigint, person_id bigint, pinned boolean, x double, y double, w double, h double")
    found = spark.createDataFrame([(1, 1, 1.0, 0.0, 10.0, 10.0), (2, 1, 2.0, 0.0, 10.0, 10.0)], "det_id bigint, photo_id bigint, x double, y double, w double, h double")
    assert {(r["face_id"], r["det_id"]) for r in matching.iou_match(faces, found).collect()} == {(2, 1), (1, 2)}
    assert {r["det_id"]: r["person_id"] for r in matching.reanalyzed(faces, found).collect()} == {1: 20, 2: 10}


def test_sync_of_an_empty_folder(spark):
    photos = spark.createDataFrame([(1, "/a", 1.0, 5, 1.0)], "id bigint, path string, mtime double, size bigint, analyzed_at double")
    nothing = spark.createDataFrame([], "path string, mtime double, size bigint")
    assert [r["state"] for r in sync.classify(photos, nothing).collect()] == ["gone"]
    faces, tags = spark.createDataFrame([(1, 1)], "id bigint, photo_id bigint"), spark.createDataFrame([(1, 1)], "photo_id bigint, tag_id bigint")
    assert [t.count() for t in sync.delete_missing(photos, nothing, faces, tags)] == [0, 0, 0]


def test_store_publishes_all_or_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/lib"
    lib = store.Store(spark, path)
    person = spark.createDataFrame([(1, "A", "#1"), (7, "B", "#2")], "id bigint, name string, color string")
    lib.write(persons=person)
    with pytest.raises(RuntimeError, match="stop"):
        with lib.transaction():
            lib.write(persons=person.limit(0))
            with lib.transaction():
                assert lib.read("persons").count() == 0
            raise RuntimeError("stop")
    assert lib.read("persons").count() == 2 and lib.next_id("persons") == 8
    lib.write(persons=lib.read("persons").where("id = 1"))
    assert lib.next_id("persons") == 8 and store.Store(spark, path).read("persons").count() == 1


def test_store_migrates_old_and_refuses_newer(spark, tmp_path):
    path = f"file://{tmp_path}/lib"
    lib = store.Store(spark, path)
    old = spark.createDataFrame([(1, "/a", 1.0, 2)], "id bigint, path string, mtime double, size bigint")
    lib.write(photos=old)
    content = lib.manifest()
    lib._write_manifest(content | {"version": content["version"] + 1, "schema": 0})
    moved = store.Store(spark, path)
    assert moved.read("photos").first()["phash"] is None and moved.manifest()["schema"] == 1
    content = moved.manifest()
    moved._write_manifest(content | {"version": content["version"] + 1, "schema": 99})
    with pytest.raises(store.NewerStoreError):
        store.Store(spark, path)


def test_capture_dates_have_no_zone(spark):
    # Hours that clocks skip, or run through twice, somewhere.
    times = ["2021:03:28 02:30:00", "2021:10:31 02:30:00", "2021:03:14 02:15:00"]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("Europe/Berlin", "America/New_York", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert values(spark, "t string", times, exif.capture_date(F.col("t"))) == ["2021-03-28T02:30:00", "2021-10-31T02:30:00", "2021-03-14T02:15:00"], zone
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_a_refused_writer_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/lib"
    person = lambda name: spark.createDataFrame([(1, name, "#1")], "id bigint, name string, color string")
    first, second = store.Store(spark, path), store.Store(spark, path)
    first.write(persons=person("base"))
    with pytest.raises(store.StaleVersionError):
        with second.transaction():
            second.write(persons=person("second"))
            # The other writer publishes the same version in between.
            first.write(persons=person("first"))
    assert [r["name"] for r in store.Store(spark, path).read("persons").collect()] == ["first"]
    assert len(list((tmp_path / "lib" / "data").iterdir())) == 2 and not list((tmp_path / "lib" / "manifests").glob("*.draft"))
    second.write(persons=person("later"))
    assert first.read("persons").first()["name"] == "later"


def jpeg_with_exif(date: bytes, lat, lon) -> bytes:
    """A JPEG header with an EXIF segment: original date in its block, coordinates in theirs."""

    def directory(entries, at):
        body, tail, rest = b"", b"", at + 2 + 12 * len(entries) + 4
        for tag, kind, n, data in entries:
            if len(data) > 4:
                body += struct.pack("<HHII", tag, kind, n, rest + len(tail))
                tail += data
            else:
                body += struct.pack("<HHI", tag, kind, n) + data.ljust(4, b"\0")
        return struct.pack("<H", len(entries)) + body + struct.pack("<I", 0) + tail

    rationals = lambda v: b"".join(struct.pack("<II", *p) for p in v)
    sub = directory([(0x9003, 2, len(date), date)], 38)
    gps = directory([(1, 2, 2, b"S\0"), (2, 5, 3, rationals(lat)), (3, 2, 2, b"E\0"), (4, 5, 3, rationals(lon))], 38 + len(sub))
    main = directory([(0x8769, 4, 1, struct.pack("<I", 38)), (0x8825, 4, 1, struct.pack("<I", 38 + len(sub)))], 8)
    tiff = b"II*\0" + struct.pack("<I", 8) + main + sub + gps
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xda\0\2"


def test_metadata_from_bytes(spark):
    good = jpeg_with_exif(b"2021:07:04 15:30:59\0", [(33, 1), (51, 1), (0, 1)], [(151, 1), (12, 1), (0, 1)])
    bad = jpeg_with_exif(b"2021:13:04 15:30:59\0", [(33, 1), (51, 0), (0, 1)], [(151, 1), (12, 1), (0, 1)])
    files = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(bad)), ("c", bytearray(b"\xff\xd8nothing")), ("d", None), ("e", bytearray(good[:60]))], "path string, content binary")
    got = {r["path"]: (r["exif_date"], r["exif_lat"], r["exif_lon"]) for r in images.metadata(files).collect()}
    assert got["a"] == ("2021-07-04T15:30:59", pytest.approx(-33.85), pytest.approx(151.2))
    assert got["b"] == got["c"] == got["d"] == (None, None, None) and got["e"][1] is None


def png(pixels: np.ndarray) -> bytes:
    import zlib

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + pixels[i].tobytes() for i in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_folder_of_images(spark, tmp_path):
    rng = np.random.default_rng(1)
    first = rng.integers(0, 256, (64, 64, 3), dtype=np.uint8)
    edited = first.copy()
    edited[30:33, 30:33] = 0
    other = rng.integers(0, 256, (64, 64, 3), dtype=np.uint8)
    (tmp_path / "sub").mkdir()
    for name, data in (("a.png", png(first)), ("sub/b.PNG", png(edited)), ("c.png", png(other)), ("d.png", b"broken"), ("e.txt", b"text")):
        (tmp_path / name).write_bytes(data)
    listed = images.listing(spark, f"file://{tmp_path}")
    assert sorted(r["path"].rsplit("/", 1)[1] for r in listed.collect()) == ["a.png", "b.PNG", "c.png", "d.png"]
    decoded = images.decoded(spark, [r["path"] for r in listed.collect()])
    got = {r["path"].rsplit("/", 1)[1]: int(r["phash"], 16) for r in images.hashes(decoded).collect()}
    assert sorted(got) == ["a.png", "b.PNG", "c.png"]
    assert bin(got["a.png"] ^ got["b.PNG"]).count("1") <= 6 and bin(got["a.png"] ^ got["c.png"]).count("1") > 12

    class Stub:
        def detect_and_embed(self, pixels):
            if pixels[0, 0].sum() == other[0, 0].sum():
                raise RuntimeError("no")
            return [images.Detection(0, 0, 5, 5, 0.9, [1.0, 2.0])]

    found = {r["path"].rsplit("/", 1)[1]: (r["failed"], r["w"]) for r in images.detect(decoded, Stub).collect()}
    assert found == {"a.png": (False, 5.0), "b.PNG": (False, 5.0), "c.png": (True, None)}
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        images.listing(spark, f"file://{tmp_path}/gone").count()


def test_difference_hash_of_known_pictures():
    # Columns that darken set all bits of a row, columns that brighten none; one gray level more is enough.
    ramp = lambda step: np.repeat(np.repeat((128 + step * np.arange(9))[None, :], 8, axis=0).astype(np.uint8)[..., None], 3, axis=2)
    assert (np.diff(images.gray_grid(ramp(-1)), axis=1) == -1).all() and (np.diff(images.gray_grid(ramp(1)), axis=1) == 1).all()
    blue, green, red = (np.zeros((8, 9, 3), dtype=np.uint8) for _ in range(3))
    blue[..., 0], green[..., 1], red[..., 2] = 255, 255, 255
    assert [images.gray_grid(x)[0, 0] for x in (blue, green, red)] == [29, 150, 76]


def test_pictures_are_reduced(spark):
    rng = np.random.default_rng(4)
    wide = rng.integers(0, 256, (20, 1000, 3), dtype=np.uint8)
    rows = [("a", 1000, 20, 3, bytearray(wide.tobytes())), ("b", 3, 2, 1, bytearray(b"abcdef"))]
    got = {r["path"]: r for r in images.thumbnails(spark.createDataFrame(rows, "path string, width int, height int, channels int, data binary"), 500).collect()}
    assert (got["a"]["width"], got["a"]["height"]) == (500, 10) and bytes(got["b"]["data"]) == b"abcdef"
    small = np.frombuffer(bytes(got["a"]["data"]), dtype=np.uint8).reshape(10, 500, 3)
    assert np.abs(small - wide.reshape(10, 2, 500, 2, 3).astype(float).mean(axis=(1, 3))).max() <= 0.5

    class Corner:
        def detect_and_embed(self, pixels):
            assert max(pixels.shape) <= 1600
            return [images.Detection(pixels.shape[1] / 2, 0, pixels.shape[1] / 2, pixels.shape[0], 1.0, [1.0])]

    box = images._detected(Corner(), np.zeros((100, 4000, 3), dtype=np.uint8))[0]
    assert (box["x"], box["w"], box["h"]) == (2000, 2000, 100)


def test_model_problems(spark, tmp_path):
    import hashlib

    payload = b"weights" * 100
    for name, data in (("good", payload), ("wrong", b"other" * 140), ("empty", b""), ("loose", payload), ("short", payload[:5])):
        (tmp_path / name).write_bytes(data)
    want = hashlib.sha256(payload).hexdigest()
    catalog = spark.createDataFrame([("good", want.upper(), 700), ("wrong", want, 700), ("empty", want, None), ("loose", None, None), ("gone", want, None), ("short", want, 700)], "name string, sha256 string, size bigint")
    recorded = spark.createDataFrame([], "name string, sha256 string")
    got = {r["name"]: r["problem"] for r in models.problems(catalog, models.model_files(spark, f"file://{tmp_path}"), recorded).collect()}
    assert got == {"wrong": "checksum mismatch", "empty": "empty", "loose": "no known hash", "gone": "missing", "short": "size mismatch"}


def test_debounce_stream(spark, tmp_path):
    events = spark.sql("SELECT * FROM VALUES (1, timestamp'2025-01-01 00:00:00'), (2, timestamp'2025-01-01 00:00:01'), (3, timestamp'2025-01-01 00:00:05'), (4, timestamp'2025-01-01 00:01:00') AS t(event_id, ts)")
    assert sorted(r["events"] for r in debounce.debounce_batch(events).collect()) == [1, 1, 2]
    events.write.parquet(f"{tmp_path}/in")
    stream = debounce.debounce_stream(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["events"] for r in spark.table("bursts").collect()) == [1, 2]
    runs = spark.sql("SELECT timestamp'2025-01-01 00:00:01' AS start_ts, timestamp'2025-01-01 00:00:05' AS end_ts")
    assert sorted(r["event_id"] for r in debounce.outside_runs(events, runs).collect()) == [1, 3, 4]


def test_online_assignment(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.1, 0.95])]
    spark.createDataFrame(rows, "id bigint, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/in")
    faces = spark.readStream.schema("id bigint, embedding array<float>").parquet(f"{tmp_path}/in")
    query = online.assign_stream(faces).writeStream.format("memory").queryName("assigned").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    query.stop()
    got = {r["face_id"]: r["person_id"] for r in spark.table("assigned").collect()}
    assert got[1] == got[2] != got[3] == got[4]


def test_folder_end_to_end(spark, tmp_path):
    from kinfold.plans.analyze import analyze_folder

    class ColorEngine:
        """One face on each picture, whose vector is that of its red value."""

        def detect_and_embed(self, pixels):
            red = int(pixels[0, 0, 2])
            if red == 255:
                raise RuntimeError("no")
            return [images.Detection(1, 1, 8, 8, 0.9, [1.0 if k == red // 32 else 0.0 for k in range(8)])]

    folder = tmp_path / "in"
    folder.mkdir()
    for k, red in enumerate((10, 12, 14, 200, 201, 90, 255)):
        pixels = np.zeros((32, 32, 3), dtype=np.uint8)
        pixels[..., 0], pixels[..., 1] = red, np.arange(32)[None, :] * (k + 1)
        (folder / f"{k}.png").write_bytes(png(pixels))
    (folder / "broken.jpg").write_bytes(b"no picture")
    lib = store.Store(spark, f"file://{tmp_path}/lib")
    seen = []
    # Cancelled before the third batch: what was published stays and has persons, the rest is done by the next run.
    part = analyze_folder(spark, lib, f"file://{folder}", ColorEngine, now=4.0, batch_photos=2, on_progress=lambda *x: seen.append(x), cancelled=lambda: len(seen) == 2)
    assert part.cancelled and (part.analyzed, part.faces) == (4, 4) and [(n, t) for n, t, _ in seen] == [(0, 8), (2, 8)]
    assert lib.read("photos").count() == 4 and lib.read("faces").where("person_id IS NULL").count() == 0
    done = analyze_folder(spark, lib, f"file://{folder}", ColorEngine, now=5.0)
    assert (done.listed, done.analyzed, done.failed, done.gone, done.faces, done.cancelled) == (8, 2, 2, 0, 2, False)
    counts = gallery.person_counts(lib.read("persons"), lib.read("faces")).collect()
    assert sorted(r["face_count"] for r in counts) == [1, 2, 3] and all(r["name"].startswith("Persona ") for r in counts)
    (folder / "3.png").unlink()
    last = analyze_folder(spark, lib, f"file://{folder}", ColorEngine, now=7.0)
    # Nothing else has changed, so nothing is read again.
    assert (last.gone, last.analyzed, last.faces) == (1, 0, 0) and lib.read("photos").count() == 5 and lib.read("faces").count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        analyze_folder(spark, lib, f"file://{tmp_path}/gone", ColorEngine)
    assert lib.read("photos").count() == 5


def test_thresholds_of_many_hashes(spark):
    """All plans that numbers of hashes lead to give the same pairs."""
    import random
    from unittest import mock

    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(40)]
    hashes = [f"{b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(7))):016x}" for b in base for _ in range(5)]
    photos = photos_of(spark, hashes)
    want = {(i, j) for i in range(200) for j in range(i) if bin(int(hashes[i], 16) ^ int(hashes[j], 16)).count("1") <= 4}
    plans = {tuple(duplicates.thresholds(n, 4)) for n in (10, 10**6, 10**8, 10**9)}
    assert plans == {(0, 0, 0, 0, 0), (1, 0, 0, 0), (1, 1, 0), (2, 1)}
    for plan in plans:
        with mock.patch.object(duplicates, "thresholds", lambda n, d, plan=plan: list(plan)):
            assert {(r["id_b"], r["id_a"]) for r in duplicates.duplicate_pairs(photos).collect()} == want


def test_running_sums_over_ranges(spark):
    from kinfold.operators.ranking import running_sums

    rows = spark.range(500).select("id", ((F.col("id") * 37) % 101).alias("x"), (F.col("id") % 7).alias("w")).repartition(4)
    sums = {"before": F.col("w"), "place": F.lit(1).cast("bigint")}
    got = [{r["id"]: (r["before"], r["place"]) for r in running_sums(rows, "x", "id", one_task_rows=n, **sums).collect()} for n in (10, 1000)]
    ordered = sorted(range(500), key=lambda i: (i * 37 % 101, i))
    want = {i: (sum(j % 7 for j in ordered[:k]), k) for k, i in enumerate(ordered)}
    assert got == [want, want]
    assert running_sums(rows.limit(0), "x", "id", one_task_rows=0, **sums).count() == 0


def test_settings_change_the_view(spark):
    photos = spark.createDataFrame([(1, "b", None), (2, "a", "2020-01-01"), (3, "c", "2019-01-01")], "id bigint, path string, exif_date string")
    faces = spark.createDataFrame([(7, 1, 5, 1.0, 2.0, 3.0, 4.0), (6, 1, None, 0.0, 0.0, 1.0, 1.0)], "id bigint, photo_id bigint, person_id bigint, x double, y double, w double, h double")
    persons = spark.createDataFrame([(5, "Ann", "#123456")], "id bigint, name string, color string")

    def shown(**settings):
        return {r["id"]: r for r in gallery.gallery_view(photos, faces, persons, Options(**settings)).collect()}

    plain = shown()
    assert {i: r["rank"] for i, r in plain.items()} == {2: 0, 1: 1, 3: 2} and plain[1]["card_height"] == 250
    assert [tuple(b) for b in plain[1]["boxes"]] == [(0, 0, 1, 1, "#888888"), (1, 2, 3, 4, "#123456")] and plain[2]["boxes"] == []
    other = shown(sort_order="date", aspect="4:3", show_face_boxes=False)
    assert {i: r["rank"] for i, r in other.items()} == {3: 0, 2: 1, 1: 2}
    assert all(r["boxes"] == [] and (r["card_width"], r["card_height"]) == (190, 210) for r in other.values())
