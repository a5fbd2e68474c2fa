"""Operator 7, substring dedup: anchors at the positions of a difference cover, then extension to whole windows.

A word goes if a window of ``width`` words that covers it also starts in a document of smaller id. To find
such windows without sending every window of the corpus, only windows of ``width - period + 1`` words
are hashed, and only at positions whose number modulo the period is in a difference cover: for any two
positions some shift below the period takes both into the cover, so every match of ``width`` words shares
an aligned anchor. Four steps follow, all on blocks of documents that are written once, in the order in which they come:

1. anchors that stand in several of some ``SAMPLED`` blocks are shared, and so are known windows around them; both lists are bounded and broadcast,
   and the smallest doc_id of each such window is found by partial minima of each task;
2. each block sends its other distinct anchors, a few bytes each, to the buckets of their hashes, and gets back
   one bit for each: whether the anchor stands in more than one document;
3. each block extends the shared anchors to the windows around them and sends each distinct window that isn't known yet with its
   smallest doc_id; back comes one bit: whether a smaller doc_id has it elsewhere;
4. each block marks the words under windows that start in a smaller document and drops them.

A passage that a third of all documents share is thus in the lists, and one that fewer share is sent once for each block, whatever the
number of documents in it, so no bucket grows hot. Windows are compared by 64 bits of one hash and the bucket of
another. The blocks are shuffled once, compressed, for steps 3 and 4 together.

Defined results: null and blank texts have no words. Fewer words than a window: nothing goes. A null
doc_id counts as larger than all others. Rows of one doc_id are one document and don't remove from each
other. Columns other than doc_id and text are passed through by ``drop_repeats`` and not read by ``repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold import runtime
from kinfold.llm import hashed_features as hf
from kinfold.llm import textblocks as tb

WIDTH = 13
#: Each difference modulo 7 is that of two of these: fixed values of a perfect difference set.
PERIOD, COVER = 7, (0, 1, 3)
#: Bytes of text of a block, and of the texts whose anchors share a bucket.
BLOCK_BYTES, BUCKET_BYTES = 2 << 20, 16 << 20
#: Blocks in which frequent anchors and windows are looked for, and in how many of them one is frequent.
SAMPLED, OFTEN = 32, 2

_LARGEST = np.iinfo(np.int64).max
_MARKS = "block bigint, step int, bucket bigint, bits binary"
_SENT = "bucket bigint, block bigint, payload binary"


@dataclass
class Words:
    """The words of a block's documents, in the order of the rows, and their hashes."""

    data: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    row: np.ndarray
    ids: np.ndarray
    hashes: np.ndarray


def _column(rows: pa.Table, name: str) -> pa.Array:
    found = rows.column(name).combine_chunks()
    return found if isinstance(found, pa.Array) else pa.concat_arrays(found.chunks)


def words_of(rows: pa.Table) -> Words:
    data, offsets = tb.column_bytes(_column(rows, "text"))
    begins, ends, first = tb.word_bounds(data, offsets)
    ids = np.asarray(_column(rows, "doc_id").cast(pa.int64()).fill_null(_LARGEST))
    return Words(data, begins, ends, first, tb.row_of(first, len(begins)), ids, tb.span_hashes(data, begins, ends))


def _starts(w: Words, width: int) -> np.ndarray:
    """True at each word from which ``width`` words of its row follow."""
    n = len(w.row)
    ok = np.zeros(n, dtype=bool)
    if n >= width:
        ok[: n - width + 1] = w.row[: n - width + 1] == w.row[width - 1 :]
    return ok


def anchors(w: Words, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchors of a block as sorted (bucket << 32 | 31 bits << 1), whether each stands in two rows or more;
    the positions of all occurrences and the number of the anchor at each."""
    size = WIDTH - PERIOD + 1
    place = (np.arange(len(w.row)) - w.first[w.row]) % PERIOD if len(w.row) else np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(_starts(w, size) & np.isin(place, COVER))
    h = tb.window_hashes(w.hashes, size)[at]
    key = ((h >> np.uint64(33)) % np.uint64(buckets) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFE))
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(order) else np.zeros(0, dtype=bool)
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    firsts = np.flatnonzero(new)
    rows = w.row[at][order]
    apart = np.zeros(len(firsts), dtype=bool)
    if len(firsts):
        apart = np.maximum.reduceat(rows, firsts) != np.minimum.reduceat(rows, firsts)
    return key[order][new], apart, at, number


def second_hash(w: Words, start: np.ndarray, buckets: int) -> np.ndarray:
    """The buckets of the windows from these words on, by another hash than the one they are compared by."""
    return tb.window_hashes(w.hashes[::-1], WIDTH)[::-1][start] % np.uint64(buckets) if len(start) else np.zeros(0, dtype=np.uint64)


def windows(w: Words, at: np.ndarray, shared: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows over the shared anchors, ordered by bucket and hash: buckets, hashes and smallest ids;
    the start words of all occurrences and the number of the window at each."""
    start = np.zeros(len(w.row) + PERIOD, dtype=bool)
    hit = at[shared]
    for k in range(PERIOD):
        start[hit - k] = True  # below zero wraps into the spare end
    start = np.flatnonzero(start[: len(w.row)] & _starts(w, WIDTH))
    h = tb.window_hashes(w.hashes, WIDTH)[start]
    bucket = second_hash(w, start, buckets)
    ids = w.ids[w.row[start]] if len(start) else np.zeros(0, dtype=np.int64)
    order = np.lexsort((h, bucket))
    b, x = bucket[order], h[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (b[1:] != b[:-1])]) if len(order) else np.zeros(0, dtype=bool)
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    firsts = np.flatnonzero(new)
    smallest = np.minimum.reduceat(ids[order], firsts) if len(firsts) else np.zeros(0, dtype=np.int64)
    return b[new], x[new], smallest, start, number


def _by_bucket(bucket: np.ndarray):
    """Ranges of equal values in the sorted ``bucket``."""
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else [0]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(bucket[i]), int(i), int(j)


def _sent(block: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array([block] * len(rows), pa.int64()), pa.array([p for _, p in rows], pa.binary())], names=["bucket", "block", "payload"])


def _bits_of(marks: pa.Table, step: int, buckets: np.ndarray) -> np.ndarray:
    """The bits that came back for a block's sorted distinct keys, whose buckets are given."""
    out = np.zeros(len(buckets), dtype=bool)
    mine = marks.filter(pa.compute.equal(marks.column("step"), step))
    came = dict(zip(mine.column("bucket").to_pylist(), mine.column("bits").to_pylist(), strict=True))
    for bucket, i, j in _by_bucket(buckets):
        out[i:j] = np.unpackbits(np.frombuffer(came[bucket], dtype=np.uint8), count=j - i)
    return out


def _answer(step: int, judge):
    """Reads rows sorted by bucket; ``judge`` takes a bucket's payloads and returns one boolean array for each."""

    def answer(block: list[int], bucket: int, payload: list[bytes]) -> pa.RecordBatch:
        bits = [np.packbits(x).tobytes() for x in judge(payload)]
        return pa.RecordBatch.from_arrays(
            [pa.array(block, pa.int64()), pa.array([step] * len(block), pa.int32()), pa.array([bucket] * len(block), pa.int64()), pa.array(bits, pa.binary())],
            names=["block", "step", "bucket", "bits"],
        )

    def run(batches):
        now, block, payload = None, [], []
        for batch in batches:
            for bucket, own, sent in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if bucket != now and block:
                    yield answer(block, now, payload)
                    block, payload = [], []
                now = bucket
                block.append(own)
                payload.append(sent)
        if block:
            yield answer(block, now, payload)

    return run


def _cut(values: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(values, np.cumsum(sizes)[:-1])


def judge_anchors(payloads: list[bytes]) -> list[np.ndarray]:
    """True for each anchor that another block has, or that its block has in two rows (the lowest bit)."""
    parts = [np.frombuffer(p, dtype=np.uint32) for p in payloads]
    sent = np.concatenate(parts)
    key, twice = sent >> np.uint32(1), (sent & np.uint32(1)).astype(bool)
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    group = np.empty(len(key), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    shared = np.bincount(group) > 1
    shared[group[twice]] = True
    return _cut(shared[group], [len(p) for p in parts])


def judge_windows(payloads: list[bytes]) -> list[np.ndarray]:
    """True for each window that another block has with a smaller doc_id."""
    sizes = [len(p) // 16 for p in payloads]
    key = np.concatenate([np.frombuffer(p, dtype=np.uint64, count=n) for p, n in zip(payloads, sizes, strict=True)])
    own = np.concatenate([np.frombuffer(p, dtype=np.int64, offset=8 * n) for p, n in zip(payloads, sizes, strict=True)])
    order = np.argsort(key, kind="stable")
    firsts = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    least = np.empty(len(key), dtype=np.int64)
    least[order] = np.repeat(np.minimum.reduceat(own[order], firsts), np.diff(np.append(firsts, len(key))))
    return _cut(least < own, sizes)


def _packed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(payload) -> pa.Table:
    with pa.ipc.open_stream(payload) as file:
        return file.read_all()


def _ingest(docs: DataFrame, block_bytes: int) -> DataFrame:
    """(block, payload): ``docs`` in blocks of about ``block_bytes`` of text, each a compressed Arrow stream; written once, so the numbers hold."""
    at = docs.columns.index("text")

    def run(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            _, offsets = tb.column_bytes(batch.column(at))
            for i, j in tb.pieces(offsets, block_bytes):
                yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + n]), pa.array([_packed(batch.slice(i, j - i))], pa.binary())], names=["block", "payload"])
                n += 1

    return runtime.materialize(docs.mapInArrow(run, "block bigint, payload binary"), "blocks")


def _each(batches) -> Iterator[tuple[int, pa.Table]]:
    for batch in batches:
        for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
            yield block, _unpacked(payload.as_buffer())
    tb.release()


def _often(rows: DataFrame, *keys: str) -> np.ndarray:
    """The keys that several of the sampled blocks have sent, sorted, as unsigned numbers, one column for each."""
    found = rows.groupBy(*keys).count().where(F.col("count") >= OFTEN).select(*keys).toArrow()
    columns = [np.asarray(found.column(k).combine_chunks()).view(np.uint64) for k in keys]
    order = np.lexsort(columns[::-1])
    return np.stack([c[order] for c in columns])


@dataclass
class Known:
    """What is known of the corpus beforehand: frequent anchors, frequent windows by hash and bucket, and the smallest doc_id of each."""

    buckets: int
    anchors: np.ndarray
    windows: np.ndarray | None = None
    least: np.ndarray | None = None

    def shared(self, keys: np.ndarray) -> np.ndarray:
        return tb.is_in(keys, self.anchors)[1]

    def listed_windows(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets, hashes and doc_ids of a block's windows whose hash may be that of a frequent one."""
        maybe = np.zeros(1 << 20, dtype=bool)
        maybe[(self.windows[0] >> np.uint64(44)).astype(np.int64)] = True
        start = np.flatnonzero(_starts(w, WIDTH))
        h = tb.window_hashes(w.hashes, WIDTH)[start]
        near = maybe[(h >> np.uint64(44)).astype(np.int64)]
        return second_hash(w, start[near], self.buckets), h[near], w.ids[w.row[start[near]]]

    def window_at(self, bucket: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each window among the frequent ones, and whether it is one of them."""
        at, there = tb.is_in(hashes, self.windows[0])
        there[there] = self.windows[1][at[there]] == bucket[there]
        return at, there


def _known(blocks: DataFrame, buckets: int) -> Known:
    spark, count = blocks.sparkSession, blocks.count()
    some = blocks.where(F.pmod(F.xxhash64("block"), F.lit(max(1, count // SAMPLED))) == 0)
    column = lambda x: pa.array(x.astype(np.uint64).view(np.int64))

    def anchors_of(batches):
        for _, rows in _each(batches):
            yield pa.RecordBatch.from_arrays([column(anchors(words_of(rows), buckets)[0])], names=["key"])

    known = Known(buckets, _often(some.mapInArrow(anchors_of, "key bigint"), "key")[0])
    first = spark.sparkContext.broadcast(known)

    def own_windows(rows: pa.Table, held: Known):
        w = words_of(rows)
        keys, _, at, number = anchors(w, buckets)
        return windows(w, at, held.shared(keys)[number], buckets)

    def windows_of(batches):
        for _, rows in _each(batches):
            bucket, h, *_ = own_windows(rows, first.value)
            yield pa.RecordBatch.from_arrays([column(h), column(bucket)], names=["h", "bucket"])

    # Of windows with one hash but several buckets, the first is kept; the others are sent like any window.
    listed = _often(some.mapInArrow(windows_of, "h bigint, bucket bigint"), "h", "bucket")
    known.windows = listed[:, np.concatenate([[True], listed[0][1:] != listed[0][:-1]])] if listed.shape[1] else listed
    second = spark.sparkContext.broadcast(known)

    def least_of(batches):
        least = np.full(known_size, _LARGEST)
        for _, rows in _each(batches):
            # Every window is looked at: which anchors of a passage are aligned differs from text to text.
            bucket, h, ids = second.value.listed_windows(words_of(rows))
            at, there = second.value.window_at(bucket, h)
            np.minimum.at(least, at[there], ids[there])
        met = np.flatnonzero(least < _LARGEST)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(least[met])], names=["at", "least"])

    known_size = known.windows.shape[1]
    known.least = np.full(known_size, _LARGEST)
    if known_size:
        found = blocks.mapInArrow(least_of, "at bigint, least bigint").groupBy("at").agg(F.min("least").alias("least")).toArrow()
        known.least[np.asarray(found.column("at").combine_chunks())] = np.asarray(found.column("least").combine_chunks())
    return known


def _shared_anchors(w: Words, marks: pa.Table, known: Known):
    """The anchors of a block, and which of them are shared: by the lists, or by the bits that came back."""
    keys, _, at, number = anchors(w, known.buckets)
    shared = known.shared(keys)
    rest = np.flatnonzero(~shared)
    shared[rest] = _bits_of(marks, 1, keys[rest] >> np.uint64(32))
    return at, shared[number]


def _covered(w: Words, marks: pa.Table, known: Known) -> np.ndarray:
    """True for each word of the block that goes."""
    bucket, h, smallest, start, which = windows(w, *_shared_anchors(w, marks, known), known.buckets)
    at, listed = known.window_at(bucket, h)
    elsewhere = np.zeros(len(h), dtype=bool)
    elsewhere[listed] = known.least[at[listed]] < smallest[listed]
    elsewhere[~listed] = _bits_of(marks, 2, bucket[~listed])
    start = start[elsewhere[which] | (smallest[which] < w.ids[w.row[start]])] if len(start) else start
    edge = np.zeros(len(w.row) + WIDTH + 1, dtype=np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + WIDTH, -1)
    return np.cumsum(edge)[: len(w.row)] > 0


def _run(docs: DataFrame, finish, schema, block_bytes: int) -> DataFrame:
    """``finish(rows, words, covered)`` of each block, after both steps of marks."""
    spark = hf.whole_ids(docs).sparkSession
    runtime.ship_package(spark)
    blocks = _ingest(docs, block_bytes)
    buckets = max(1, -(-blocks.count() * block_bytes // BUCKET_BYTES))
    held = spark.sparkContext.broadcast(_known(blocks, buckets))

    def send_anchors(batches):
        for block, rows in _each(batches):
            keys, apart, _, _ = anchors(words_of(rows), buckets)
            rest = ~held.value.shared(keys)
            keys, apart = keys[rest], apart[rest]
            low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32) | apart.astype(np.uint32)
            yield _sent(block, [(b, low[i:j].tobytes()) for b, i, j in _by_bucket(keys >> np.uint64(32))])

    def send_windows(rows: pa.Table, marks: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.Table.from_batches([_sent(0, [])])
        w = words_of(_unpacked(rows.column("payload")[0].as_buffer()))
        bucket, h, smallest, _, _ = windows(w, *_shared_anchors(w, marks, held.value), buckets)
        rest = ~held.value.window_at(bucket, h)[1]
        bucket, h, smallest = bucket[rest], h[rest], smallest[rest]
        tb.release()
        return pa.Table.from_batches([_sent(rows.column("block")[0].as_py(), [(b, h[i:j].tobytes() + smallest[i:j].tobytes()) for b, i, j in _by_bucket(bucket)])])

    def last(rows: pa.Table, marks: pa.Table) -> pa.Table:
        own = _unpacked(rows.column("payload")[0].as_buffer())
        w = words_of(own)
        done = finish(own, w, _covered(w, marks, held.value))
        tb.release()
        return done

    def answers(sent: DataFrame, step: int, judge) -> DataFrame:
        return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_answer(step, judge), _MARKS)

    groups = blocks.groupBy("block")
    first = answers(blocks.mapInArrow(send_anchors, _SENT), 1, judge_anchors)
    second = answers(groups.cogroup(first.groupBy("block")).applyInArrow(send_windows, _SENT), 2, judge_windows)
    return groups.cogroup(first.union(second).groupBy("block")).applyInArrow(last, schema)


def repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for each row of ``docs``."""
    kind = docs.schema["doc_id"].dataType

    def finish(rows: pa.Table, w: Words, covered: np.ndarray) -> pa.Table:
        gone = np.concatenate([[0], np.cumsum(covered)])
        removed = gone[w.first[1:]] - gone[w.first[:-1]]
        return pa.table(
            [rows.column("doc_id"), pa.array(np.diff(w.first)), pa.array(removed), pa.array([hashlib.sha256(t).hexdigest() for t in _kept(w, covered)], pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    return _run(docs.select("doc_id", "text"), finish, schema, block_bytes)


def _kept(w: Words, covered: np.ndarray):
    own = w.data.tobytes()
    stays = np.flatnonzero(~covered)
    cuts = np.searchsorted(stays, w.first)
    begins, ends = w.begins[stays].tolist(), w.ends[stays].tolist()
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield b" ".join([own[a:b] for a, b in zip(begins[i:j], ends[i:j], strict=True)])


def drop_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` with repeated words taken out of ``text``; n_chars, if there, follows.

    A text that loses nothing stays as it is; otherwise the kept words are joined by one space.
    """
    schema = docs.schema

    def finish(rows: pa.Table, w: Words, covered: np.ndarray) -> pa.Table:
        gone = np.concatenate([[0], np.cumsum(covered)])
        removed = (gone[w.first[1:]] - gone[w.first[:-1]]).tolist()
        old = _column(rows, "text").to_pylist()
        texts = [t if not r else k.decode() for t, r, k in zip(old, removed, _kept(w, covered), strict=True)]
        rows = rows.set_column(rows.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
        at = rows.schema.get_field_index("n_chars")
        if at >= 0:
            counts = [n if not r else len(t) for n, r, t in zip(rows.column(at).to_pylist(), removed, texts, strict=True)]
            rows = rows.set_column(at, "n_chars", pa.array(counts, rows.schema.field(at).type))
        return rows

    return _run(docs, finish, schema, block_bytes)


#: The same result in SQL: every window of every document with the smallest document that has it.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT row_id, doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM (SELECT row_id, doc_id, w, unnest(range(1, greatest(len(w) - 12, 0) + 1)) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS least_id FROM x GROUP BY s),
c AS (SELECT DISTINCT row_id, unnest(range(i, i + 13)) AS pos FROM x JOIN m USING (s) WHERE least_id < doc_id),
t AS (SELECT row_id, doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
k AS (SELECT row_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM t ANTI JOIN c USING (row_id, pos) GROUP BY row_id),
n AS (SELECT row_id, count(*) AS n_removed FROM c GROUP BY row_id)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (row_id) LEFT JOIN n USING (row_id)
"""
