"""Vector joins: all pairs above a cosine threshold, means by person, nearest person."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold import constants as C
from kinfold import runtime
from kinfold.functions import vectors

#: Vectors of one block of the pairwise join: two blocks fit a task, their product is taken in tiles that a core's cache holds.
BLOCK_ROWS, TILE_ROWS = 8192, 2048
PAIR_TILE = (256, 1024)
#: Pairs whose products are taken row by row at once.
PAIR_ROWS = 1 << 15
#: Tasks, at most, that the pairs of blocks are dealt to.
PAIR_TASKS = 4096


def matrix_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors as float64 rows, shorter ones filled up with 0; they are taken over whole where all have one length."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = [p.flatten() for p in parts]
    lengths = {n for p in parts for n in p.value_lengths().unique().to_pylist()}
    if len(lengths) == 1 and None not in lengths and not any(f.null_count for f in flat):
        return np.concatenate([f.to_numpy() for f in flat]).astype(np.float64).reshape(len(column), lengths.pop())
    rows = [np.asarray(x if x is not None else [], dtype=np.float64) for x in column.to_pylist()]
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def unit_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors as float64 rows of unit length; NaN and infinities count as 0, rows without length stay 0."""
    return _of_unit_length(matrix_of(column))


def _of_unit_length(out: np.ndarray) -> np.ndarray:
    out[~np.isfinite(out)] = 0
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, length, out=np.zeros_like(out), where=length > 0)


def kept_apart(anchors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have an anchor, and which one: rows with different ones never come together."""
    return np.asarray(anchors.is_valid()), np.asarray(anchors.fill_null(0))


def pair_products(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of row a and row b of ``x`` for each pair (a, b), summed in one order for both directions of a pair."""
    out = np.empty(len(a))
    for s in range(0, len(a), PAIR_ROWS):
        p, q = a[s : s + PAIR_ROWS], b[s : s + PAIR_ROWS]
        out[s : s + PAIR_ROWS] = np.einsum("ij,ij->i", x[p], x[q])
    return out


def _hits(fits: np.ndarray) -> np.ndarray:
    """Where ``fits``, a tile of few true values, is true; eight values are looked at together where their number allows it."""
    flat = fits.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    some = np.flatnonzero(flat.view(np.uint64))
    at, k = np.nonzero(flat.reshape(-1, 8)[some])
    return some[at] * 8 + k


def near_pairs(x: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows a of ``left`` and b of ``right`` whose product in ``x``, of unit rows, is at least ``threshold``, and that product.

    Products of 32 bits, with room for their rounding, tell which pairs are taken in 64 bits. Where both are the same array, of rising
    numbers, each two of its rows are compared once: a < b.
    """
    y, room = x.astype(np.float32), 1e-5 + 2.0**-22 * x.shape[1]
    found: list[list[np.ndarray]] = [[np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0)]]
    high, wide = PAIR_TILE
    columns = [(right[t : t + wide], y[right[t : t + wide]].T) for t in range(0, len(right), wide)]
    for s in range(0, len(left), high):
        own = left[s : s + high]
        rows = y[own]
        for other, across in columns[s // wide if left is right else 0 :]:
            at = _hits(rows @ across >= np.float32(threshold - room))
            a, b = own[at // len(other)], other[at % len(other)]
            if left is right:
                once = a < b
                a, b = a[once], b[once]
            sim = pair_products(x, a, b)
            fit = sim >= threshold
            for part, values in zip(found, (a[fit], b[fit], sim[fit]), strict=True):
                part.append(values)
    return tuple(np.concatenate(part) for part in found)


def cosine_pairs(faces: DataFrame, threshold: float = C.COSINE_THRESHOLD, block_rows: int = BLOCK_ROWS, apart: str | None = None, count: int | None = None) -> DataFrame:
    """(a, b, sim), a < b, of faces (id, embedding) whose cosine is at least ``threshold``; those with different values of the column ``apart`` are no pair.

    All pairs must be compared: at such a threshold no bound on lengths or angles rules any out. Vectors are cut into blocks; each
    pair of blocks is one group of a shuffle and one matrix product, so nothing is broadcast and no task holds more than two blocks.
    A block travels as one row, once for each block; vectors of 32 bits travel as they are and get their length where they are compared. ``count``: the faces, where they have been counted.
    """
    runtime.ship_package(faces.sparkSession)
    blocks = max(1, -(-(faces.count() if count is None else count) // block_rows))
    anchor = (F.col(apart) if apart else F.lit(None)).cast("bigint").alias("anchor")
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("own")

    def packed(rows: pa.Table) -> pa.Table:
        column = rows.column("embedding")
        x = matrix_of(column).astype(np.float32) if pa.types.is_float32(column.type.value_type) else unit_rows(column)
        return packed_block(rows.column("own")[0].as_py(), rows.column("id"), x, rows.column("anchor"))

    return block_pairs(faces.select("id", "embedding", anchor, own).repartition(blocks, "own").groupBy("own").applyInArrow(packed, BLOCK), blocks, threshold)


#: A block of vectors in one row: its number, and ids, vectors end to end and anchors as an Arrow stream. Vectors of 64 bits are ready, those of 32 bits as the table has them.
BLOCK = "own int, payload binary"


def packed_block(own: int, ids: pa.ChunkedArray | pa.Array, x: np.ndarray, anchors: pa.ChunkedArray | pa.Array) -> pa.Table:
    flat = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    width = x.shape[1]
    vectors = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), width) if width else pa.nulls(len(x), pa.null())
    batch = pa.RecordBatch.from_arrays([flat(ids), vectors, flat(anchors)], names=["id", "x", "anchor"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return pa.table({"own": pa.array([own], pa.int32()), "payload": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _unpacked(payload: pa.Scalar) -> tuple[np.ndarray, np.ndarray, pa.ChunkedArray]:
    with pa.ipc.open_stream(payload.as_buffer()) as file:
        rows = file.read_all()
    column = rows.column("x").combine_chunks()
    x = np.zeros((len(rows), 0)) if pa.types.is_null(column.type) else column.flatten().to_numpy().reshape(len(rows), -1)
    if x.dtype == np.float32:
        x = _of_unit_length(x.astype(np.float64))
    return np.asarray(rows.column("id")), x, rows.column("anchor")


def block_pairs(packed: DataFrame, blocks: int, threshold: float) -> DataFrame:
    """(a, b, sim), a < b, of vectors no longer than 1 in the ``blocks`` of ``packed`` whose product is at least ``threshold``; those of different anchors are no pair."""
    sent = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sent = sent.select("own", "payload", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def product(rows: pa.Table) -> pa.Table:
        at = np.argsort(np.asarray(rows.column("own")))
        parts = [_unpacked(rows.column("payload")[k]) for k in at.tolist()]
        same = rows.column("i")[0].as_py() == rows.column("j")[0].as_py()
        if len(parts) == 1 and not same:
            # The other block is empty.
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        ids, x, anchors = parts[0]
        left = right = np.arange(len(ids))
        if not same:
            more, y, pins = parts[1]
            width = max(x.shape[1], y.shape[1])
            right = len(ids) + np.arange(len(more))
            x = np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, y)])
            ids, anchors = np.concatenate([ids, more]), pa.chunked_array([*anchors.chunks, *pins.chunks], pa.int64())
        held, tied = kept_apart(anchors)
        a, b, sim = near_pairs(x, left, right, threshold)
        free = ~(held[a] & held[b] & (tied[a] != tied[b]))
        if same:
            free &= ids[a] != ids[b]
        first, second, sims = ids[a[free]], ids[b[free]], sim[free]
        return pa.table({"a": np.minimum(first, second), "b": np.maximum(first, second), "sim": sims})

    # As many tasks as there are pairs of blocks, else some task would get many of them.
    if blocks > 1:
        sent = sent.repartition(min(PAIR_TASKS, blocks * (blocks + 1) // 2), "i", "j")
    return sent.groupBy("i", "j").applyInArrow(product, "a bigint, b bigint, sim double")


def person_means(faces: DataFrame, key: str = "person_id") -> DataFrame:
    """The mean vector of each person's faces and their number, by components, so sums are partial before the shuffle."""
    parts = faces.where(F.col(key).isNotNull()).select(key, F.posexplode(vectors.cleaned(F.col("embedding"))).alias("pos", "x"))
    sums = parts.groupBy(key, "pos").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    return sums.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"), F.max("n").alias("faces"))


#: Bytes of person means that are broadcast; with more of them, blocks of faces meet blocks of means.
MEANS_BYTES = 64 << 20


def _best_of(ids: list, means: np.ndarray, faces: pa.RecordBatch | pa.Table) -> pa.RecordBatch:
    """Each face with the first of the most similar means, which lie in the order of their ids."""
    x = unit_rows(faces.column("embedding"))
    width = max(x.shape[1], means.shape[1])
    wide = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
    near, best = np.zeros(len(x), dtype=np.int64), np.full(len(x), -np.inf)
    for i in range(0, len(means) if len(x) else 0, TILE_ROWS):
        sim = wide(x) @ wide(means[i : i + TILE_ROWS]).T
        at = sim.argmax(axis=1)
        top = sim[np.arange(len(x)), at]
        better = top > best
        best[better], near[better] = top[better], np.asarray(ids[i : i + TILE_ROWS], dtype=np.int64)[at[better]]
    column = faces.column("id")
    return pa.RecordBatch.from_arrays([column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, pa.array(near), pa.array(best)], names=["id", "near_id", "sim"])


def nearest_person(faces: DataFrame, means: DataFrame, threshold: float = C.COSINE_THRESHOLD, means_bytes: int = MEANS_BYTES) -> DataFrame:
    """(id, near_id, sim): each face with the person of the most similar mean, if the cosine is over ``threshold``; ties go to the smaller id.

    Means that are small enough are broadcast, so faces are not moved. Otherwise every block of faces meets every block of means in a group of
    its own, and the best of the blocks are reduced by a partial maximum.
    """
    runtime.ship_package(faces.sparkSession)
    means = runtime.materialize(means.select(F.col("person_id").alias("near_id"), "mean"), "means")
    told = means.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("mean")), F.lit(0)).alias("width")).first()
    schema = "id bigint, near_id bigint, sim double"
    if told["n"] * told["width"] * 8 <= means_bytes:
        rows = sorted(means.collect())
        held = faces.sparkSession.sparkContext.broadcast(([r["near_id"] for r in rows], unit_rows(pa.array([r["mean"] for r in rows], pa.list_(pa.float64())))))
        best = faces.select("id", "embedding").mapInArrow(lambda batches: (_best_of(*held.value, b) for b in batches), schema)
    else:
        rows = max(1, means_bytes // (8 * max(told["width"], 1)))
        blocks, parts = -(-told["n"] // rows), max(1, -(-faces.count() // rows))
        # Each face is sent to every block of means, each mean to every part of the faces.
        left = faces.select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        right = means.select("near_id", "mean", F.pmod(F.xxhash64("near_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("part"))

        def compare(own: pa.Table, other: pa.Table) -> pa.Table:
            other = other.sort_by("near_id")
            found = _best_of(other.column("near_id").to_pylist(), unit_rows(other.column("mean")), own)
            return pa.Table.from_batches([found])

        pairs = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(compare, schema)
        best = pairs.groupBy("id").agg(F.max(F.struct("sim", (-F.col("near_id")).alias("order"))).alias("x")).select("id", (-F.col("x.order")).alias("near_id"), "x.sim")
    hit = F.col("sim") > threshold
    return best.select("id", F.when(hit, F.col("near_id")).alias("near_id"), F.when(hit, F.col("sim")).alias("sim"))
