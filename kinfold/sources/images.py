"""Image folders as tables: listing, metadata from the files' headers, difference hashes and a detector interface."""

from __future__ import annotations

import io
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold import constants as C
from kinfold import runtime
from kinfold.functions import exif, media
from kinfold.operators.ranking import ranked
from kinfold.sources import folders


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, mtime, size) of all images below a folder. A missing folder is an error, before anything is changed.

    Only file metadata is read. A folder of a mounted file system is listed exactly: names that start with a dot or underscore count, times are as fine as the
    file system has them, and a directory that can't be read is an error. In other stores Spark lists, and skips such names.
    """
    if folders.is_local(folder):
        rows = folders.files(spark, folder).select("path", "mtime", "size")
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        rows = files.select("path", F.col("modificationTime").cast("double").alias("mtime"), F.col("length").alias("size"))
    return rows.where(media.is_image(F.col("path")))


def _plain(path: str):
    return F.regexp_replace(path, "^file:(//)?", "")


def _escaped(path: str) -> str:
    """A path that Spark doesn't take for a pattern."""
    return re.sub(r"([\\\[\]{}*?^,])", r"\\\1", path)


def _hidden(path: str) -> bool:
    """Whether Spark's file sources leave a file with this name out, even if it is named to them."""
    name = path.rsplit("/", 1)[-1]
    return name.startswith((".", "_")) or name.endswith("._COPYING_")


def _staged(spark: SparkSession, paths: list[str]) -> tuple[list[str], DataFrame | None]:
    """Paths that Spark reads these files by, and (staged, path) of those that had to be copied as their names are hidden ones."""
    hidden = [p for p in paths if _hidden(p)]
    if not hidden:
        return [_escaped(p) for p in paths], None
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder, rows = runtime.scratch_path(spark, "staged"), []
    for k, path in enumerate(hidden):
        source, target = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{folder}/{k}{os.path.splitext(path)[1]}")
        jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, target.getFileSystem(conf), target, False, conf)
        rows.append((re.sub("^file:(//)?", "", target.toString()), path))
    return [*(_escaped(p) for p in paths if not _hidden(p)), *(staged for staged, _ in rows)], spark.createDataFrame(rows, "staged string, path string")


def _listed_paths(rows: DataFrame, staged: DataFrame | None) -> DataFrame:
    """``rows`` with the paths that the files were listed by."""
    if staged is None:
        return rows
    own = rows.withColumnRenamed("path", "staged").join(F.broadcast(staged), "staged", "left")
    return own.select(F.coalesce("path", "staged").alias("path"), *(c for c in rows.columns if c != "path"))


def contents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, content) of these files; no others are opened."""
    names, staged = _staged(spark, paths)
    return _listed_paths(spark.read.format("binaryFile").option("pathGlobFilter", "*").load(names).select(_plain("path").alias("path"), "content"), staged)


# -- metadata ------------------------------------------------------------------------------------------------

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
#: Tag numbers of the blocks and fields that are read.
_EXIF_BLOCK, _GPS_BLOCK = 0x8769, 0x8825
_ORIGINAL, _DIGITIZED, _MODIFIED, _ORIENTATION = 0x9003, 0x9004, 0x0132, 0x0112
_LAT_REF, _LAT, _LON_REF, _LON = 1, 2, 3, 4


def tiff_of(data: bytes) -> bytes | None:
    """The TIFF structure in a JPEG's EXIF segment, a PNG's eXIf chunk or a TIFF file."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF:
            kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if kind == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return data[at + 10 : at + 2 + size]
            if kind == 0xDA or size < 2:
                return None
            at += 2 + size
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            size = int.from_bytes(data[at : at + 4], "big")
            if data[at + 4 : at + 8] == b"eXIf":
                return data[at + 8 : at + 8 + size]
            at += 12 + size
    return None


def tiff_fields(tiff: bytes, at: int) -> dict[int, object]:
    """The fields of one directory: bytes, or lists of numbers and (numerator, denominator) pairs."""
    order = "<" if tiff[:2] == b"II" else ">"
    out: dict[int, object] = {}
    (count,) = struct.unpack_from(order + "H", tiff, at)
    for k in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", tiff, at + 2 + 12 * k)
        size = _SIZES.get(kind, 0) * n
        place = at + 10 + 12 * k
        if size > 4:
            (place,) = struct.unpack_from(order + "I", tiff, place)
        raw = tiff[place : place + size]
        if not size or len(raw) < size:
            continue
        if kind in (1, 2, 7):
            out[tag] = raw
        elif kind in (5, 10):
            flat = struct.unpack(order + ("I" if kind == 5 else "i") * 2 * n, raw)
            out[tag] = list(zip(flat[::2], flat[1::2], strict=True))
        else:
            out[tag] = list(struct.unpack(order + {3: "H", 4: "I", 9: "i"}[kind] * n, raw))
    return out


def raw_metadata(data: bytes) -> dict:
    """Dates as text and coordinates as rational parts, as the file has them; each block may fail by itself."""
    out: dict = {k: None for k in ("original", "digitized", "modified", "lat", "lat_ref", "lon", "lon_ref", "orientation")}
    text = lambda v: v.decode("latin-1") if isinstance(v, bytes) else None
    parts = lambda v: [{"num": float(a), "den": float(b)} for a, b in v] if isinstance(v, list) and v and isinstance(v[0], tuple) else None
    try:
        tiff = tiff_of(data)
        if tiff is None:
            return out
        main = tiff_fields(tiff, struct.unpack_from("<I" if tiff[:2] == b"II" else ">I", tiff, 4)[0])
    except (struct.error, IndexError, KeyError):
        return out
    out["modified"] = text(main.get(_MODIFIED))
    turn = main.get(_ORIENTATION)
    out["orientation"] = turn[0] if isinstance(turn, list) and turn and turn[0] in range(1, 9) else None
    for block, names in ((_EXIF_BLOCK, {"original": _ORIGINAL, "digitized": _DIGITIZED}), (_GPS_BLOCK, {"lat_ref": _LAT_REF, "lon_ref": _LON_REF, "lat": _LAT, "lon": _LON})):
        try:
            if block in main:
                own = tiff_fields(tiff, main[block][0])
                out |= {n: (parts if n in ("lat", "lon") else text)(own.get(t)) for n, t in names.items()}
        except (struct.error, IndexError, KeyError, TypeError):
            continue
    return out


_PARTS = "array<struct<num:double,den:double>>"


def metadata(files: DataFrame) -> DataFrame:
    """(path, exif_date, exif_lat, exif_lon) of (path, content): bytes are read in Python, values are judged in columns."""
    runtime.ship_package(files.sparkSession)
    part = pa.list_(pa.struct([("num", pa.float64()), ("den", pa.float64())]))
    schema = pa.schema([("path", pa.string()), *((n, pa.string()) for n in ("original", "digitized", "modified")), ("lat", part), ("lat_ref", pa.string()), ("lon", part), ("lon_ref", pa.string())])

    def read(batches):
        for batch in batches:
            rows = [{k: v for k, v in raw_metadata(c or b"").items() if k != "orientation"} | {"path": p} for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    raw = files.select("path", "content").mapInArrow(read, f"path string, original string, digitized string, modified string, lat {_PARTS}, lat_ref string, lon {_PARTS}, lon_ref string")
    degrees = lambda c: F.transform(c, lambda p: exif.ratio(p["num"], p["den"]))
    place = exif.gps(exif.dms_to_decimal(degrees("lat"), F.col("lat_ref"), "N", "S"), exif.dms_to_decimal(degrees("lon"), F.col("lon_ref"), "E", "W"))
    dated = exif.first_date(F.col("original"), F.col("digitized"), F.col("modified"))
    return raw.select("path", dated.alias("exif_date"), place["lat"].alias("exif_lat"), place["lon"].alias("exif_lon"))


# -- pixels --------------------------------------------------------------------------------------------------


#: Bits behind the point of the weights of a resampling of bytes.
_FIXED_BITS = 22


def _lanczos(source: int, target: int) -> np.ndarray:
    """Weights (target, source) of a Lanczos resampling with three lobes, widened when shrinking, in whole parts of 2**22.

    A target takes in the source pixels whose middle lies within the lobes, cut at whole pixels; weights add up to one before they are rounded.
    """
    scale = max(source / target, 1.0)
    out = np.zeros((target, source))
    for t in range(target):
        middle = (t + 0.5) * source / target
        lo, hi = max(int(middle - 3 * scale + 0.5), 0), min(int(middle + 3 * scale + 0.5), source)
        x = (np.arange(lo, hi) - middle + 0.5) / scale
        w = np.where((x >= -3) & (x < 3), np.sinc(x) * np.sinc(x / 3), 0)
        w = w / w.sum() * (1 << _FIXED_BITS)
        out[t, lo:hi] = np.trunc(w + np.where(w < 0, -0.5, 0.5))
    return out


def gray_grid(pixels: np.ndarray) -> np.ndarray:
    """Eight rows of nine gray values (0 to 255) of an image (rows, columns, 3 or 1 channels, blue first).

    Luminance is that of BT.601 in 16-bit fixed point. Columns are reduced first, then rows, with weights of 22 bits, and each step gives bytes. All
    sums are whole numbers below 2**53, so floating point adds them exactly.
    """
    if pixels.shape[-1] == 1:
        gray = pixels[..., 0].astype(np.float64)
    else:
        # The weights of blue, green and red in parts of 65536.
        gray = ((pixels[..., :3].astype(np.int64) @ np.array([7471, 38470, 19595]) + 32768) >> 16).astype(np.float64)
    whole = lambda x: np.clip(np.floor((x + (1 << _FIXED_BITS - 1)) / (1 << _FIXED_BITS)), 0, 255)
    return whole(_lanczos(gray.shape[0], 8) @ whole(gray @ _lanczos(gray.shape[1], 9).T))


def upright(pixels: np.ndarray, orientation: int | None) -> np.ndarray:
    """A picture as it is to be looked at, from its raster and the orientation that its EXIF block states."""
    if orientation in (5, 6, 7, 8):
        pixels = pixels.transpose(1, 0, 2)
    rows = {3: -1, 4: -1, 7: -1, 8: -1}.get(orientation, 1)
    columns = {2: -1, 3: -1, 6: -1, 7: -1}.get(orientation, 1)
    return np.ascontiguousarray(pixels[::rows, ::columns])


def orientations(files: DataFrame) -> DataFrame:
    """(path, orientation) of those of (path, content) whose picture is to be turned."""
    runtime.ship_package(files.sparkSession)

    def read(batches):
        for batch in batches:
            turns = [raw_metadata(c or b"")["orientation"] for c in batch.column("content").to_pylist()]
            turned = [k for k, t in enumerate(turns) if t and t > 1]
            yield pa.RecordBatch.from_arrays([batch.column("path").take(pa.array(turned, pa.int64())), pa.array([turns[k] for k in turned], pa.int32())], names=["path", "orientation"])

    return files.select("path", "content").mapInArrow(read, "path string, orientation int")


_DECODED = "path string, width int, height int, channels int, data binary"


def decoded(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, width, height, channels, data, orientation) of these images, as their rasters lie in the files; those that can't be decoded are left out.

    Spark decodes what Java knows. Other formats, such as WebP, go to Pillow where that is installed. ``orientation`` is null where nothing is to be turned; ``upright`` turns.
    """
    by_java = [p for p in paths if not p.lower().endswith(_NOT_JAVA)]
    others = [p for p in paths if p.lower().endswith(_NOT_JAVA)]
    rows = spark.createDataFrame([], _DECODED)
    if by_java:
        names, staged = _staged(spark, by_java)
        read = spark.read.format("image").option("dropInvalid", True).load(names).select("image.*")
        # The origin is a URI, in which blanks and other characters are escaped; a plus sign stands for itself.
        origin = _plain("origin")
        path = F.url_decode(F.replace(origin, F.lit("+"), F.lit("%2B"))).alias("path")
        rows = _listed_paths(read.select(path, "width", "height", F.col("nChannels").alias("channels"), "data"), staged)
    if others:
        runtime.ship_package(spark)
        rows = rows.union(contents(spark, others).mapInArrow(_with_pillow, _DECODED))
    turned = orientations(contents(spark, paths)) if paths else spark.createDataFrame([], "path string, orientation int")
    return rows.join(runtime.if_small(turned, len(paths)), "path", "left")


#: File name endings that Java's decoders don't know.
_NOT_JAVA = (".webp",)


def _with_pillow(batches) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), *((n, pa.int32()) for n in ("width", "height", "channels")), ("data", pa.binary())])
    try:
        from PIL import Image
    except ImportError:
        Image = None
    for batch in batches if Image else ():
        rows = []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            try:
                pixels = np.asarray(Image.open(io.BytesIO(content)).convert("RGB"))[..., ::-1]
            except Exception:  # noqa: BLE001  a broken file is left out, whatever its decoder raises
                continue
            rows.append({"path": path, "width": pixels.shape[1], "height": pixels.shape[0], "channels": 3, "data": pixels.tobytes()})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _turns(batch: pa.RecordBatch) -> list[int | None]:
    return batch.column("orientation").to_pylist() if "orientation" in batch.schema.names else [None] * batch.num_rows


def _gray_of(width: int, height: int, channels: int, data: bytes | None) -> list[float] | None:
    return gray_grid(np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)).ravel().tolist() if data else None


def hashes(pictures: DataFrame) -> DataFrame:
    """(path, width, height, phash) of decoded images: pixels are reduced in Python, bits are set in columns.

    The hash is that of the raster as it lies in the file, the lengths are those of the upright picture.
    """
    runtime.ship_package(pictures.sparkSession)

    def reduce(batches):
        for batch in batches:
            grids = [_gray_of(*row) for row in zip(*(batch.column(n).to_pylist() for n in ("width", "height", "channels", "data")), strict=True)]
            sizes = [(h, w) if t and t > 4 else (w, h) for w, h, t in zip(batch.column("width").to_pylist(), batch.column("height").to_pylist(), _turns(batch), strict=True)]
            lengths = [pa.array([x[k] for x in sizes], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), *lengths, pa.array(grids, pa.list_(pa.float64()))], names=["path", "width", "height", "gray"])

    rows = pictures.mapInArrow(reduce, "path string, width int, height int, gray array<double>")
    return rows.select("path", "width", "height", media.dhash(F.col("gray")).alias("phash"))


def _shrunk(pixels: np.ndarray, side: int) -> tuple[np.ndarray, float]:
    """A picture no larger than ``side``, and the factor from its lengths back to those of the original."""
    h, w = pixels.shape[:2]
    scale = min(1.0, side / max(h, w))
    if scale == 1.0:
        return pixels, 1.0
    rows, columns = max(1, round(h * scale)), max(1, round(w * scale))
    flat = np.tensordot(_area(h, rows), pixels.astype(np.float32), axes=(1, 0))
    small = np.tensordot(flat, _area(w, columns), axes=(1, 1)).transpose(0, 2, 1)
    return np.clip(np.rint(small), 0, 255).astype(np.uint8), 1 / scale


def _area(source: int, target: int) -> np.ndarray:
    """Weights (target, source) with which each target pixel is the mean of the source pixels that it covers."""
    edges = np.arange(target + 1) * (source / target)
    covered = np.minimum(edges[1:, None], np.arange(1, source + 1)) - np.maximum(edges[:-1, None], np.arange(source))
    covered = np.maximum(covered, 0).astype(np.float32)
    return covered / covered.sum(axis=1, keepdims=True)


def thumbnails(pictures: DataFrame, side: int = C.THUMBNAIL_SIDE) -> DataFrame:
    """(path, width, height, channels, data): decoded images reduced to at most ``side`` on the longer side; smaller ones stay."""
    runtime.ship_package(pictures.sparkSession)

    def reduce(batches):
        for batch in batches:
            rows = []
            for path, w, h, c, d in zip(*(batch.column(n).to_pylist() for n in ("path", "width", "height", "channels", "data")), strict=True):
                small = _shrunk(np.frombuffer(d, dtype=np.uint8).reshape(h, w, c), side)[0]
                rows.append({"path": path, "width": small.shape[1], "height": small.shape[0], "channels": c, "data": small.tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    return pictures.select("path", "width", "height", "channels", "data").mapInArrow(reduce, _DECODED)


# -- detection -----------------------------------------------------------------------------------------------


@dataclass
class Detection:
    x: float
    y: float
    w: float
    h: float
    confidence: float
    embedding: list[float] = field(default_factory=list)


class Engine(Protocol):
    """Finds and embeds what is on a picture, given as an array with blue first."""

    def detect_and_embed(self, pixels: np.ndarray) -> list[Detection]: ...


def _detected(engine: Engine, pixels: np.ndarray) -> list[dict] | None:
    """Detections on a picture, in its own lengths; None if the engine fails. Engines see no more than DETECTOR_MAX_SIDE pixels a side."""
    try:
        small, back = _shrunk(pixels, C.DETECTOR_MAX_SIDE)
        return [vars(d) | {k: getattr(d, k) * back for k in ("x", "y", "w", "h")} for d in engine.detect_and_embed(small)]
    except Exception:  # noqa: BLE001  any failure of a plugged-in engine concerns this picture only
        return None


_FOUND = "x double, y double, w double, h double, confidence double, embedding array<float>"
_BOXES = pa.list_(pa.struct([*((n, pa.float64()) for n in ("x", "y", "w", "h", "confidence")), ("embedding", pa.list_(pa.float32()))]))


def analyzed(pictures: DataFrame, make_engine: Callable[[], Engine]) -> DataFrame:
    """(path, width, height, phash, failed, detections) of decoded images, in one pass over them.

    Lengths and detections are those of the upright picture, the hash is that of the raster.
    The engine is made once up front, so that one that can't be made fails before anything is changed, and then once in each task.
    """
    runtime.ship_package(pictures.sparkSession)
    make_engine()
    schema = pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("gray", pa.list_(pa.float64())), ("failed", pa.bool_()), ("detections", _BOXES)])

    def run(batches) -> Iterator[pa.RecordBatch]:
        engine = make_engine()
        for batch in batches:
            rows = []
            for path, w, h, c, d, turn in zip(*(batch.column(n).to_pylist() for n in ("path", "width", "height", "channels", "data")), _turns(batch), strict=True):
                pixels = upright(np.frombuffer(d, dtype=np.uint8).reshape(h, w, c), turn)
                found = _detected(engine, pixels)
                rows.append({"path": path, "width": pixels.shape[1], "height": pixels.shape[0], "gray": _gray_of(w, h, c, d), "failed": found is None, "detections": found or []})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    found = pictures.mapInArrow(run, f"path string, width int, height int, gray array<double>, failed boolean, detections array<struct<{_FOUND.replace(' double', ':double').replace(' array', ':array')}>>")
    return found.select("path", "width", "height", media.dhash(F.col("gray")).alias("phash"), "failed", "detections")


def detect(pictures: DataFrame, make_engine: Callable[[], Engine]) -> DataFrame:
    """One row for each detection; a picture without any has one row of nulls, a picture that fails has ``failed`` set."""
    rows = analyzed(pictures, make_engine).select("path", "failed", F.explode_outer("detections").alias("d"))
    return rows.select("path", "failed", "d.*")


# -- detection in SQL ----------------------------------------------------------------------------------------


def detector(make_engine: Callable[[], Engine]):
    """A table function (width, height, channels, data, orientation) of a decoded picture: the rows that ``detect`` has for it.

    One row for each detection; a picture without any has one row of nulls, a picture that can't be worked on one with ``failed`` set. The engine is made once in each task.
    """
    make_engine()

    class Detect:
        def __init__(self):
            self.engine = make_engine()

        def eval(self, width: int, height: int, channels: int, data: bytes, orientation: int):
            try:
                pixels = upright(np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels), orientation)
            except (TypeError, ValueError, AttributeError):
                pixels = None
            found = None if pixels is None else _detected(self.engine, pixels)
            for d in found or [{}]:
                yield found is None, *(d.get(k) for k in ("x", "y", "w", "h", "confidence")), d["embedding"] if d else None

    return F.udtf(Detect, returnType=f"failed boolean, {_FOUND}", useArrow=True)


def register_detector(spark: SparkSession, make_engine: Callable[[], Engine], name: str = "detect_faces") -> None:
    """Makes the engine a function of SQL: ``SELECT p.path, d.* FROM pictures p, LATERAL detect_faces(p.width, p.height, p.channels, p.data, p.orientation) d``."""
    runtime.ship_package(spark)
    spark.udtf.register(name, detector(make_engine))


# -- a cache of small pictures -------------------------------------------------------------------------------

_CACHED = "key string, width int, height int, content binary"


def png_of(pixels: np.ndarray) -> bytes:
    """A picture (blue first, or gray) as the bytes of a PNG file."""
    h, w, channels = pixels.shape
    body = pixels[..., 0] if channels == 1 else pixels[..., 2::-1]
    lines = np.concatenate([np.zeros((h, 1), dtype=np.uint8), np.ascontiguousarray(body).reshape(h, -1)], axis=1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if channels == 1 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def thumbnail_keys(photos: DataFrame, side: int = C.THUMBNAIL_SIDE) -> DataFrame:
    """(path, mtime, key) of photos: the key names path, time and side, the time printed in as few digits as tell it apart."""
    runtime.ship_package(photos.sparkSession)

    def printed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("mtime"), pa.array([None if m is None else repr(m) for m in batch.column("mtime").to_pylist()], pa.string())], names=["path", "mtime", "printed"])

    rows = photos.select("path", "mtime").mapInArrow(printed, "path string, mtime double, printed string")
    return rows.select("path", "mtime", media.thumbnail_key(F.col("path"), F.col("printed"), side).alias("key"))


def cached_thumbnails(spark: SparkSession, cache: str) -> DataFrame:
    """(key, width, height, content) of all small pictures in the cache; empty before the first is put there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], _CACHED)
    return spark.read.schema(_CACHED).parquet(cache)


def fill_thumbnails(spark: SparkSession, photos: DataFrame, cache: str, side: int = C.THUMBNAIL_SIDE, batch_photos: int = 4096) -> int:
    """Puts small pictures (PNG) of photos (path, mtime) into the cache and returns how many photos were opened for it.

    Keys are looked up first: a photo whose picture is there is not opened. Photos go in batches, each published by one append; those that can't be decoded are
    left out and tried again the next time.
    """
    keys = thumbnail_keys(photos, side)
    todo = runtime.materialize(ranked(keys.join(cached_thumbnails(spark, cache).select("key"), "key", "left_anti"), "path", "key"), "todo")
    total = todo.count()

    def encode(batches):
        for batch in batches:
            rows = zip(*(batch.column(n).to_pylist() for n in ("width", "height", "channels", "data")), strict=True)
            content = [png_of(np.frombuffer(d, dtype=np.uint8).reshape(h, w, c)) for w, h, c, d in rows]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("width"), batch.column("height"), pa.array(content, pa.binary())], names=["path", "width", "height", "content"])

    for first in range(0, total, batch_photos):
        own = todo.where((F.col("place") >= first) & (F.col("place") < first + batch_photos)).select("path", "key")
        small = thumbnails(decoded(spark, sorted({r["path"] for r in own.collect()})), side).mapInArrow(encode, "path string, width int, height int, content binary")
        small.join(own, "path").select("key", "width", "height", "content").coalesce(max(1, min(batch_photos, total) // 512)).write.mode("append").parquet(cache)
    return total
