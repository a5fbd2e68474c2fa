"""Import of a library that lies in an SQLite file: vectors, types, missing columns, ranges, changes while it is read."""

import sqlite3
import struct
from collections import Counter

import pytest

from kinfold.sources import sqlite, store

PLAIN = {t: ", ".join(c.strip().split(" ")[0] + (" INTEGER PRIMARY KEY" if c.strip().startswith("id ") else "") for c in columns.split(",")) for t, columns in store.TABLES.items()}


@pytest.fixture
def file(tmp_path):
    """Photos with odd names, faces with vectors of several lengths, a deleted row, no tags."""
    path = tmp_path / "a library?#%20é.db"
    with sqlite3.connect(path) as db:
        for table, columns in PLAIN.items():
            db.execute(f"CREATE TABLE {table} ({columns})")
        for i in range(1, 31):
            db.execute("INSERT INTO photos VALUES (?,?,?,?,?,?,?,?,?,?,?)", (i, f"/p/{i} é%#.jpg", i + 0.25, 10**10 + i, None if i == 3 else 4, 5, None, i / 7, None, "00ff", 1))
        db.execute("DELETE FROM photos WHERE id = 8")
        db.execute("INSERT INTO persons VALUES (1, 'Ann', '#ff0000')")
        for i in range(1, 21):
            vector = struct.pack(f"<{i % 4}f", *(k + i / 3 for k in range(i % 4)))
            db.execute("INSERT INTO faces VALUES (?,?,?,?,?,?,?,?,?,?)", (i, i, 1 if i % 2 else None, 1, 2, 3.5, 4, None if i == 5 else vector, i % 3, "0.5" if i == 2 else 0.25))
        db.execute("INSERT INTO photo_tags VALUES (1, 2), (1, 3), (2, 2)")
    db.close()
    return path


def test_rows_and_types(spark, file):
    faces = {r["id"]: r for r in sqlite.library(spark, str(file), "faces").collect()}
    assert len(faces) == 20 and faces[5]["embedding"] is None and faces[4]["embedding"] == []
    for i, r in faces.items():
        if i != 5:
            assert r["embedding"] == pytest.approx([k + i / 3 for k in range(i % 4)], rel=1e-6)
        assert (r["pinned"], r["person_id"], r["w"], r["confidence"]) == (i % 3 != 0, 1 if i % 2 else None, 3.5, 0.5 if i == 2 else 0.25)
    photos = sqlite.library(spark, f"file://{str(file).replace('%', '%25').replace('?', '%3F').replace('#', '%23')}", "photos")
    assert photos.where("id = 3 AND width IS NULL AND path = '/p/3 é%#.jpg' AND size = 10000000003").count() == 1
    assert photos.count() == 29 and sqlite.library(spark, str(file), "tags").count() == 0


def test_ranges_hold_each_row_once(file, monkeypatch):
    for rows, most in ((7, 10_000), (1, 3), (100_000, 10_000)):
        monkeypatch.setattr(sqlite, "TASK_ROWS", rows)
        monkeypatch.setattr(sqlite, "MOST_TASKS", most)
        reader = sqlite.LibraryReader(str(file), "photos")
        parts = reader.partitions()
        assert len(parts) == {7: 5, 1: 3, 100_000: 1}[rows]
        assert Counter(i for p in parts for b in reader.read(p) for i in b.column("id").to_pylist()) == Counter(i for i in range(1, 31) if i != 8)


def test_import_is_one_publish(spark, file, tmp_path):
    lib = store.Store(spark, f"file://{tmp_path}/lib", buckets=4)
    sqlite.import_library(spark, str(file), lib)
    assert {t: lib.read(t).count() for t in store.TABLES} == {"photos": 29, "persons": 1, "faces": 20, "tags": 0, "photo_tags": 3}
    # New rows go on behind the imported ones.
    assert lib.next_id("photos") == 31


def test_older_files_bad_vectors_and_changes(spark, tmp_path, file):
    old = tmp_path / "old.db"
    with sqlite3.connect(old) as db:
        db.execute("CREATE TABLE faces (id INTEGER PRIMARY KEY, photo_id, person_id, x, y, w, h, embedding)")
        db.execute("INSERT INTO faces VALUES (1, 1, NULL, 0, 0, 1, 1, x'0000803f')")
    db.close()
    assert [tuple(r)[-3:] for r in sqlite.library(spark, str(old), "faces").collect()] == [([1.0], False, 0.0)]
    with pytest.raises(ValueError, match="3 bytes"):
        sqlite.vectors([b"abc"])
    reader = sqlite.LibraryReader(str(file), "persons")
    planned = reader.partitions()
    with sqlite3.connect(file) as db:
        db.execute("UPDATE persons SET name = 'Bea' || hex(zeroblob(9000))")
    db.close()
    with pytest.raises(RuntimeError, match="changed"):
        list(reader.read(planned[0]))
    with pytest.raises(ValueError, match="not one of"):
        sqlite.LibraryReader(str(file), "sqlite_master")
