"""Operator 4, LM scoring: exact corpus word counts and a causal self-attention model over subword ids.

Counts. Texts are cut into blocks of bounded size. The words that stand in many blocks, found in a bounded sample of
blocks, are counted by partial sums of each task and broadcast: they are at most ``SAMPLED`` / ``OFTEN`` times the words
of a block. Each other word of a block is sent once, as a hash with its count among the learning texts, to the bucket of
the hash, and the block gets back the word's count in the whole learning corpus. The word counts give the base score; the
counts of subwords, summed over all learning texts too, give the subword classes.

Model. Subword ids come from a public tokenizer whose file is a parameter; the driver ships it to the tasks. The
network of ``attention`` learns from all windows of all learning texts at every size. A hash deals them to ``ROUNDS`` rounds and, within a round, to shards
of about ``SHARD_WINDOWS``; in a round, whose windows travel by themselves, a copy of the network walks through each of its shards, and the copies are averaged.
Pairs of an embedding row and the class that follows are counted over all learning texts and mixed with the network, by weights that all their windows tell.
A word's probability is mixed from five parts: its share of the corpus; its subwords by the network; its share of the text so far; what followed
the word before it so far; and the class of its first subword by the network, times the word's share of the corpus words of that class. The weights
are fitted to all places of all learning texts, each word counted without itself. All whole texts are scored: their parts are found once, written, and read for both.

Where a window is learned from follows from a hash of id and text, and sums are of whole numbers, so scores do not depend on
files, partitions or blocks beyond the rounding of 32-bit products.

Defined results: null, empty and blank texts are one end token. A null doc_id is learned from. With nothing to
learn from, counts are 0 and the model is untrained. Repeated rows are scored one by one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold import runtime
from kinfold.llm import attention
from kinfold.llm import hashed_features as hf
from kinfold.llm import textblocks as tb

#: The tokenizer's file; a path that the driver can read.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
#: All windows of the learning texts are dealt to ROUNDS rounds. SHARD_WINDOWS of them, about, are a shard, which one copy of the network
#: walks through; after each round the copies are averaged.
SHARD_WINDOWS, ROUNDS = 1024, 3
#: Windows whose inputs are held at once.
CHUNK_WINDOWS = 4096
#: Rounds in which the weights of the parts are fitted.
FIT_ROUNDS = 10
BLOCK_BYTES = 1 << 20
#: Parts that tables of sums are added up in.
SLICES = 64
#: Blocks in which frequent words are looked for, and in how many of them a word is frequent.
SAMPLED, OFTEN = 32, 2
#: Bytes of text whose distinct words share a bucket.
BUCKET_CHARS = 32_000_000
ADD = 0.1

_BLOCK = "block bigint, payload binary"
_SENT = "bucket bigint, block bigint, payload binary"
_loaded: dict[int, object] = {}


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays of any lengths as one compressed Arrow stream: first bytes of all numbers, then second bytes, and so on, which compress better."""
    planes = {f"{name}:{a.dtype.str}": np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T).ravel() for name, a in arrays.items()}
    batch = pa.RecordBatch.from_arrays([pa.array([x], pa.list_(pa.uint8())) for x in planes.values()], names=list(planes))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> dict[str, np.ndarray]:
    with pa.ipc.open_stream(pa.py_buffer(payload)) as file:
        batch = file.read_next_batch()
    found = {}
    for field in batch.schema.names:
        name, _, kind = field.partition(":")
        kind = np.dtype(kind)
        found[name] = np.ascontiguousarray(np.asarray(batch.column(field).values).reshape(kind.itemsize, -1).T).ravel().view(kind)
    return found


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in as few bytes as hold the largest."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def tokenizer(model: bytes):
    """The tokenizer of a model file's bytes, loaded once in a process."""
    key = hash(model)
    if key not in _loaded:
        import sentencepiece

        _loaded[key] = sentencepiece.SentencePieceProcessor(model_proto=model)
    return _loaded[key]


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the hash, so sorted hashes have sorted buckets."""
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def block_of(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, known: np.ndarray, held: np.ndarray, model, keys: np.ndarray | None = None) -> bytes:
    """A block of texts. Words are numbered by falling frequency in it; the block keeps the numbers of its texts' words
    and, for each number, the word's hash, its subwords and its count among the learning texts. ``keys`` tell the texts apart when some are chosen."""
    data = tb.translate(data, tb.LOWER)
    begins, ends, first = tb.word_bounds(data, offsets)
    spans = tb.span_hashes(data, begins, ends)
    hashes, where, codes, times = np.unique(spans, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(order), dtype=np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    hashes, where, codes = hashes[order], where[order], rank[codes]
    own = data.tobytes()
    words = [own[a:b].decode() for a, b in zip(begins[where].tolist(), ends[where].tolist(), strict=True)]
    # A word that the tokenizer makes nothing of is one unknown subword.
    parts = [p or [0] for p in model.encode(words, num_threads=1)] if words else []
    sizes = np.fromiter(map(len, parts), dtype=np.int32, count=len(parts))
    pieces = np.fromiter(chain.from_iterable(parts), dtype=np.int32, count=int(sizes.sum()))
    counts = np.diff(first)
    train = np.bincount(codes[np.repeat(~held, counts)], minlength=len(hashes)).astype(np.int32)
    return pack(ids=ids, keys=ids.astype(np.int64) if keys is None else keys, known=known, held=held.astype(np.int8), counts=counts.astype(np.int32), codes=codes, sizes=sizes, pieces=pieces, hashes=hashes, train=train)


def subwords(block: dict[str, np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The subword ids of a block's texts end to end, each text followed by ``end``; their lengths; the sizes of all words, ends included."""
    sizes = np.append(block["sizes"], np.int32(1))
    # An end is one more word, whose only subword stands behind all others.
    pieces = np.append(block["pieces"], np.int32(end))
    first = np.cumsum(sizes, dtype=np.int64) - sizes
    stops = np.cumsum(block["counts"], dtype=np.int64)
    codes = np.insert(block["codes"], stops, len(sizes) - 1)
    n = sizes[codes]
    before = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
    at = np.repeat(first[codes] - before[:-1], n)
    at += np.arange(len(at))
    edges = before[np.concatenate([[0], stops + np.arange(1, len(stops) + 1)])]
    return pieces[at], np.diff(edges), n


@dataclass
class Corpus:
    """Totals over the learning texts, the frequent words and their counts, the words (ends included) of each class of a first subword, and the weights of the parts of a word's probability."""

    tokens: int
    distinct: int
    texts: int
    frequent: np.ndarray
    counts: np.ndarray
    classes: np.ndarray | None = None
    weights: np.ndarray | None = None


def _payloads(batches) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    for batch in batches:
        for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
            yield block, unpack(payload.as_buffer())
    tb.release()


def _ingest(docs: DataFrame, held_out: Column, model: bytes, block_bytes: int) -> DataFrame:
    """Blocks of texts."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = tb.column_bytes(batch.column("text"))
            ids = batch.column("doc_id").cast(pa.int64())
            known, ids = np.asarray(ids.is_valid()).astype(np.int8), np.asarray(ids.fill_null(0))
            held, keys = np.asarray(batch.column("held")), np.asarray(batch.column("key"))
            for i, j in tb.pieces(offsets, block_bytes):
                payload = block_of(*tb.piece_of(data, offsets, i, j), ids[i:j], known[i:j], held[i:j], tokenizer(shipped.value), keys[i:j])
                yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + n]), pa.array([payload], pa.binary())], names=["block", "payload"])
                n += 1
        tb.release()

    # Written once: block numbers are those of the attempt that was committed.
    return runtime.materialize(docs.select("doc_id", "text", held_out.alias("held"), F.xxhash64("doc_id", "text").alias("key")).mapInArrow(run, _BLOCK), "blocks")


def _one_in(share: int, least: int, count: int) -> Column:
    """True for one block in ``share``, chosen by a hash of its number, and for about ``least`` blocks if these are more."""
    return F.pmod(F.xxhash64("block"), F.lit(max(1, min(share, count // least)))) == 0


def frequent_words(blocks: DataFrame, count: int) -> np.ndarray:
    """Sorted hashes of words that stand in several of some ``SAMPLED`` blocks; a bounded number."""

    def run(batches):
        for _, block in _payloads(batches):
            yield pa.RecordBatch.from_arrays([pa.array(block["hashes"].view(np.int64))], names=["hash"])

    some = blocks.where(_one_in(1 << 62, SAMPLED, count)).mapInArrow(run, "hash bigint")
    rows = some.groupBy("hash").count().where(F.col("count") >= OFTEN).select("hash")
    return np.sort(np.asarray(rows.toArrow().column("hash").combine_chunks()).view(np.uint64))


def _summed(blocks: DataFrame, width: int, add) -> np.ndarray:
    """The sum of a vector of ``width`` numbers over all blocks: ``add(total, block)`` within a task, then slice by slice."""
    size = -(-width // SLICES)

    def run(batches):
        total = np.zeros(SLICES * size, dtype=np.int64)
        for _, block in _payloads(batches):
            add(total, block)
        yield _sliced(total)

    sums = blocks.mapInArrow(run, "slice int, payload binary").repartition("slice").mapInArrow(_slice_totals, "slice int, payload binary")
    out = np.zeros((SLICES, size), dtype=np.int64)
    for row in sums.toLocalIterator():
        out[row["slice"]] = unpack(row["payload"])["x"]
    return out.ravel()[:width]


def _sliced(total: np.ndarray) -> pa.RecordBatch:
    own = [pack(x=part) for part in np.split(total, SLICES)]
    return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(own, pa.binary())], names=["slice", "payload"])


def _slice_totals(batches):
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for number, payload in zip(batch.column("slice").to_pylist(), batch.column("payload"), strict=True):
            totals[number] = totals.get(number, 0) + unpack(payload.as_buffer())["x"]
    yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([pack(x=t) for t in totals.values()], pa.binary())], names=["slice", "payload"])


@dataclass
class Line:
    """The words of a block in order, an end after each text: codes (an end has that behind all words), texts, places in the text, and the words before."""

    codes: np.ndarray
    text: np.ndarray
    nth: np.ndarray
    before: np.ndarray


def line_of(block: dict[str, np.ndarray]) -> Line:
    words, stops, end = block["counts"].astype(np.int64), np.cumsum(block["counts"], dtype=np.int64), len(block["hashes"])
    codes = np.insert(block["codes"].astype(np.int64), stops, end)
    text = np.repeat(np.arange(len(stops)), words + 1)
    nth = np.arange(len(codes)) - np.repeat(stops - words + np.arange(len(stops)), words + 1)
    # Before the first word of a text stands an end.
    before = np.roll(codes, 1)
    before[nth == 0] = end
    return Line(codes, text, nth, before)


def rare_keys(block: dict[str, np.ndarray], frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of a block's words that are not frequent; where they stand among all its words; which words are frequent."""
    often = tb.is_in(block["hashes"], frequent)[1]
    at = np.flatnonzero(~often)
    at = at[np.argsort(block["hashes"][at])]
    return block["hashes"][at], at, often


def _send(frequent, buckets: int):
    """A block's words that are not frequent, by bucket: hashes and counts in learning texts, as they lie in memory."""

    def run(batches):
        for number, block in _payloads(batches):
            hashes, at, _ = rare_keys(block, frequent.value)
            train = block["train"][at]
            bucket = bucket_of(hashes, buckets)
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, dtype=np.int64)
            sent = [hashes[i:j].tobytes() + train[i:j].tobytes() for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array(np.full(len(sent), number)), pa.array(sent, pa.binary())], names=["bucket", "block", "payload"])

    return run


def _total(batches):
    """Rows sorted by bucket: answers each block with the corpus counts of its words, and tells the bucket's totals."""

    def answer(bucket: int, blocks: list[int], payloads: list) -> pa.RecordBatch:
        sizes = [len(p) // 12 for p in payloads]
        hashes = np.concatenate([np.frombuffer(p, dtype=np.uint64, count=n) for p, n in zip(payloads, sizes, strict=True)])
        train = np.concatenate([np.frombuffer(p, dtype=np.int32, offset=8 * n) for p, n in zip(payloads, sizes, strict=True)])
        distinct, which = np.unique(hashes, return_inverse=True)
        counts = np.bincount(which, weights=train, minlength=len(distinct)).astype(np.int64)
        parts = np.split(counts[which], np.cumsum(sizes)[:-1])
        told = np.zeros((2, len(blocks)), dtype=np.int64)
        told[:, 0] = counts.sum(), (counts > 0).sum()
        return pa.RecordBatch.from_arrays(
            [pa.array(blocks, pa.int64()), pa.array([bucket] * len(blocks), pa.int64()), pa.array([c.tobytes() for c in parts], pa.binary()), pa.array(told[0]), pa.array(told[1])],
            names=["block", "bucket", "counts", "tokens", "words"],
        )

    now, blocks, payloads = None, [], []
    for batch in batches:
        for bucket, block, payload in zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist(), batch.column("payload"), strict=True):
            if bucket != now and blocks:
                yield answer(now, blocks, payloads)
                blocks, payloads = [], []
            now = bucket
            blocks.append(block)
            payloads.append(payload.as_buffer())
    if blocks:
        yield answer(now, blocks, payloads)


#: A window as it travels: the number that names it, embedding rows of its keys, classes of its targets, and the first and the end of its keys that are of the text.
_WINDOW = np.dtype([("u", "<i8"), ("rows", "<i2", attention.KEYS), ("kinds", "u1", attention.STEP), ("low", "u1"), ("high", "u1")])


def _learning(block: dict[str, np.ndarray], voc, chosen=None) -> Iterator[tuple[np.ndarray, tuple]]:
    """The windows of a block's learning texts, some at a time: numbers that follow from texts, ids and places alone, and the inputs as ``attention.window_inputs`` has them.

    ``chosen`` takes all numbers and tells which windows are wanted, in what order.
    """
    ids, lengths, _ = subwords(block, voc.end)
    first, begin, end = attention.windows(lengths)
    text = np.repeat(np.arange(len(lengths)), -(-lengths // attention.STEP))
    u = tb.mix(block["keys"].view(np.uint64)[text] * np.uint64(0x9E3779B97F4A7C15) + (first - begin).astype(np.uint64))
    wanted = np.flatnonzero(block["held"][text] == 0)
    if chosen is not None:
        wanted = wanted[chosen(u[wanted])]
    for i in range(0, len(wanted), CHUNK_WINDOWS):
        take = wanted[i : i + CHUNK_WINDOWS]
        yield u[take], attention.window_inputs(voc, ids, first[take], begin[take], end[take])


def _windows(shards: int, voc, rounds: int = 1, seed: int = 0):
    """The learning windows of every shard that leaves ``seed`` when divided by ``rounds``; a row holds those that a piece of a block has for a shard."""

    def chosen(u: np.ndarray) -> np.ndarray:
        shard = u % np.uint64(shards)
        own = np.flatnonzero(shard % np.uint64(rounds) == seed)
        return own[np.argsort(shard[own], kind="stable")]

    def run(batches):
        for _, block in _payloads(batches):
            for u, (rows, there, target, _) in _learning(block, voc.value, chosen):
                own = np.empty(len(u), dtype=_WINDOW)
                own["u"], own["rows"], own["kinds"] = u.view(np.int64), rows, voc.value.kind[target]
                own["low"], own["high"] = there.argmax(axis=1), attention.KEYS - there[:, ::-1].argmax(axis=1)
                shard = (u % np.uint64(shards)).astype(np.int32)
                cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
                payload = [own[i:j].tobytes() for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard[cuts[:-1]]), pa.array(payload, pa.binary())], names=["shard", "payload"])

    return run


def _inputs(windows):
    """Embedding rows, places of the text, classes and places of targets of windows as they travel."""
    own = np.frombuffer(windows, dtype=_WINDOW)
    at = np.arange(attention.KEYS)
    there = (at >= own["low"][:, None]) & (at < own["high"][:, None])
    return own["rows"].astype(np.int64), there, own["kinds"].astype(np.int64), there[:, attention.CONTEXT :]


def _shards(batches) -> Iterator[np.ndarray]:
    """The windows of each shard in the order of their numbers, of rows sorted by shard. Equal texts of one id have equal windows, and these are one."""

    def whole(payloads: list[bytes]) -> np.ndarray:
        own = np.frombuffer(b"".join(payloads), dtype=_WINDOW)
        return own[np.unique(own["u"], return_index=True)[1]]

    now, payloads = None, []
    for batch in batches:
        for shard, payload in zip(batch.column("shard").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            if shard != now and payloads:
                yield whole(payloads)
                payloads = []
            now = shard
            payloads.append(payload)
    if payloads:
        yield whole(payloads)


#: Squared gradients are added up as multiples of one in this many.
_SQUARES = float(1 << 20)


def _walk(held, seed: int):
    """Each shard's copy of the network goes on by one walk through its windows. Told: how far each number moved and what its squared gradients are, times the windows."""

    def run(batches):
        net, squares = held.value
        began, total = attention.flat(net), None
        for windows in _shards(batches):
            inputs = _inputs(windows)
            own, seen = attention.copy_of(net), attention.from_flat(net, squares).parts()
            seen = attention.train(*inputs, net=own, epochs=1, batch=32, seed=seed, seen=seen)
            moved = (attention.flat(own).astype(np.float64) - began) * attention.FIXED
            met = len(inputs[0])
            # Sums of whole numbers don't depend on the order in which shards are added.
            told = np.rint(np.concatenate([moved, np.concatenate([x.ravel() for x in seen]) * _SQUARES, [1.0]]) * met).astype(np.int64)
            total = told if total is None else total + told
        if total is not None:
            yield _sliced(np.pad(total, (0, -len(total) % SLICES)))

    return run


def learned(shards: DataFrame, net: attention.Network, rounds: int = ROUNDS, dealt=None) -> attention.Network:
    """``net`` after some rounds, among which the shards are dealt: a copy of it walks through each shard of the round, and after it stands the mean of the copies by windows.

    ``dealt`` makes the windows of one round alone, which then travel without the others; without it they are picked from ``shards``.
    """
    spark, n = shards.sparkSession, len(attention.flat(net))
    squares = np.full(n, 1e-6)
    for seed in range(rounds):
        held = spark.sparkContext.broadcast((net, squares))
        rows = dealt(seed) if dealt else shards.where(F.col("shard") % rounds == seed)
        sums = rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(_walk(held, seed), "slice int, payload binary").repartition("slice").mapInArrow(_slice_totals, "slice int, payload binary")
        found = sorted((r["slice"], r["payload"]) for r in sums.collect())
        # The next round's windows take the place of these.
        del rows, sums
        runtime.free_shuffles(spark)
        if not found:
            continue
        total = np.concatenate([unpack(p)["x"] for _, p in found]).astype(np.float64)
        met = total[2 * n]
        net = attention.from_flat(net, attention.flat(net) + total[:n] / met / attention.FIXED)
        squares = total[n : 2 * n] / met / _SQUARES
    return net


def _packed_places(payload) -> tuple[np.ndarray, np.ndarray]:
    own = unpack(payload)
    return own["kind"], own["parts"]


def fitted(rows: DataFrame, kinds: int, parts: int, rounds: int = FIT_ROUNDS, read=_packed_places) -> np.ndarray:
    """For each kind of place the weights under which the places are likeliest, by rounds over all of ``rows``, of whose payloads ``read`` makes kinds and, place by place, their parts.

    Each round adds up whole numbers place by place, so the weights do not depend on how the rows lie. A kind that no place has keeps equal weights.
    """
    weights = np.full((kinds, parts), 1 / parts)

    def told(weights):
        by_part = np.ascontiguousarray(weights.T)

        def run(batches):
            total = np.zeros((parts, kinds))
            for batch in batches:
                for payload in batch.column("payload"):
                    kind, own = read(payload.as_buffer())
                    share = own.reshape(parts, -1) * by_part[:, kind]
                    share *= attention.FIXED / np.maximum(share.sum(axis=0), 1e-300)
                    np.rint(share, out=share)
                    total += np.stack([np.bincount(kind, weights=x, minlength=kinds) for x in share])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts * kinds)), pa.array(total.ravel().astype(np.int64))], names=["at", "n"])

        return run

    for _ in range(rounds):
        sums = np.zeros(kinds * parts)
        for r in rows.mapInArrow(told(weights), "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():
            sums[r["at"]] = r["n"]
        sums = sums.reshape(parts, kinds).T
        met = sums.sum(axis=1, keepdims=True)
        weights = np.where(met > 0, sums / np.maximum(met, 1), weights)
    return weights


#: Bins of the share that the network has in the sum of both probabilities of a place.
BINS = 1024


def two_weights(counts: np.ndarray, shares: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """For each kind the weight of the second of two parts under which its places are likeliest, of which each bin tells the number and the mean of the first one's share in the sum of both.

    More than this share does not matter to the weights. A kind that no place has keeps equal weights.
    """
    weight, met = np.full(len(counts), 0.5), counts.sum(axis=1)
    for _ in range(rounds):
        second = weight[:, None] * (1 - shares)
        taken = second / np.maximum(second + (1 - weight[:, None]) * shares, 1e-300)
        weight = np.where(met > 0, (taken * counts).sum(axis=1) / np.maximum(met, 1), weight)
    return weight


def _fit_pairs(blocks: DataFrame, net: attention.Network, voc) -> attention.Pairs:
    """What class follows each embedding row, over all learning texts; its weight beside the network is fitted to all windows of these."""
    cells = attention.ROWS * attention.CLASSES

    def add(total, block):
        ids, lengths, _ = subwords(block, voc.value.end)
        total += np.pad(attention.pair_counts(voc.value, ids, lengths, block["held"] > 0).ravel(), (0, len(total) - cells))

    counts = _summed(blocks, cells, add).reshape(attention.ROWS, attention.CLASSES)
    shipped = blocks.sparkSession.sparkContext.broadcast((net, counts))
    bins = attention.LEVELS * BINS

    def run(batches):
        total = np.zeros(2 * bins, dtype=np.int64)
        for _, block in _payloads(batches):
            for _, (rows, there, target, aimed) in _learning(block, voc.value):
                kind, (own, other) = attention.pair_places(*shipped.value, rows, there, voc.value.kind[target], aimed)
                share = np.rint(own / np.maximum(own + other, 1e-300) * _SQUARES).astype(np.int64)
                at = kind * BINS + np.minimum(share * BINS // int(_SQUARES), BINS - 1)
                total[:bins] += np.bincount(at, minlength=bins)
                total[bins:] += np.bincount(at, weights=share, minlength=bins).astype(np.int64)
        yield _sliced(total)

    sums = blocks.mapInArrow(run, "slice int, payload binary").repartition("slice").mapInArrow(_slice_totals, "slice int, payload binary")
    total = np.zeros((SLICES, 2 * bins // SLICES), dtype=np.int64)
    for row in sums.toLocalIterator():
        total[row["slice"]] = unpack(row["payload"])["x"]
    met, share = total.reshape(2, attention.LEVELS, BINS).astype(np.float64)
    return attention.pair_model(counts, two_weights(met, share / np.maximum(met, 1) / _SQUARES))


def _train(blocks: DataFrame, voc, subword_total: int, windows: int) -> tuple[attention.Network, attention.Pairs]:
    shards = ROUNDS * max(1, round(subword_total / attention.STEP / ROUNDS / windows))
    dealt = lambda *which: blocks.mapInArrow(_windows(shards, voc, *which), "shard int, payload binary")
    net = learned(dealt(), attention.new_network(), ROUNDS, lambda seed: dealt(ROUNDS, seed))
    return net, _fit_pairs(blocks, net, voc)


def corpus_counts(block: dict[str, np.ndarray], answers: pa.Table, corpus: Corpus) -> np.ndarray:
    """The corpus counts of a block's distinct words."""
    _, at, often = rare_keys(block, corpus.frequent)
    out = np.zeros(len(often), dtype=np.int64)
    out[often] = corpus.counts[tb.is_in(block["hashes"][often], corpus.frequent)[0]]
    came = sorted(zip(answers.column("bucket").to_pylist(), answers.column("counts").to_pylist(), strict=True))
    # Answers come by bucket and, within one, in the order of the hashes.
    out[at] = np.frombuffer(b"".join(c for _, c in came), dtype=np.int64)
    return out


#: Kinds of places: how far into the text, and how often the word before has had another behind it in the text.
_FAR, _MET = (16, 64, 256), (1, 2, 4)
KINDS = (len(_FAR) + 1) * (len(_MET) + 1)
#: What a word's probability is mixed from, by name.
PARTS = ("corpus", "subwords", "text", "follows", "classes")


def earlier(keys: np.ndarray) -> np.ndarray:
    """How many equal keys, whole numbers from 0, stand before each key."""
    n = len(keys)
    if n and int(keys.max()) < (1 << 62) // n:
        # With its place put into each number, numbers can be sorted, which is faster than places by them.
        key, order = np.divmod(np.sort(keys * n + np.arange(n)), n)
    else:
        order = np.argsort(keys, kind="stable")
        key = keys[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n else order
    out = np.empty(n, dtype=np.int64)
    out[order] = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    return out


@dataclass
class Places:
    """The words of a block in order, the end of each text included.

    ``own``: the corpus count of the word; ``text``: the number of its text; ``kind``: the kind of its place; ``opens``: the class of its first subword; ``parts``, as named by ``PARTS``: its
    probability by its share of the corpus, by its subwords, by its share of the text so far, by what followed the word
    before it in the text so far, and by the class of its first subword, as the network has it, and its share of the words of that class. Each part sums to one over all words, or to zero where nothing is known.
    """

    own: np.ndarray
    text: np.ndarray
    kind: np.ndarray
    parts: np.ndarray
    opens: np.ndarray
    #: What the parts of the text so far and of the class are made of.
    told: dict[str, np.ndarray] | None = None


def places(block: dict[str, np.ndarray], answers: pa.Table, model, leave_out: bool = False, without: tuple[str, ...] = ()) -> Places:
    """With ``leave_out`` the words of learning texts are counted without themselves; the parts named in ``without`` are zero."""
    scorer, corpus = model.value
    line = line_of(block)
    voc = scorer.voc
    counts = corpus_counts(block, answers, corpus)
    ids, lengths, sizes = subwords(block, voc.end)
    codes, text, nth, end = line.codes, line.text, line.nth, len(counts)
    counts = np.append(counts, corpus.texts)
    own = counts[codes]
    seen = earlier(text * (end + 1) + codes)
    # How often the word before has had another behind it: as often as it stood before.
    met = np.roll(seen, 1)
    met[nth == 0] = 0
    follows = np.where(nth == 0, 0, earlier((text * (end + 1) + line.before) * (end + 1) + codes))
    less = leave_out * (block["held"] == 0)[text]
    parts, opens, shown = np.zeros((len(PARTS), len(codes))), np.zeros(len(codes), dtype=np.int64), np.zeros(len(codes))
    parts[0] = np.maximum(own - less, 0) / np.maximum(corpus.tokens - less, 1)
    parts[2], parts[3] = seen / np.maximum(nth, 1), follows / np.maximum(met, 1)
    if len(ids):
        own_log, begins = attention.log10_probabilities(scorer, ids, lengths)
        parts[1] = 10.0 ** np.maximum(attention.word_scores(own_log, begins, sizes, codes == end), -300)
        first = np.cumsum(sizes) - sizes
        begun = ids[first]
        kind = opens = voc.kind[begun]
        # The class of the first subword, given that a word begins or the text ends here.
        shown = 10.0 ** (own_log[first].astype(np.float64) - voc.log_share[begun] - begins[first]) * voc.begins[kind]
        shown = np.minimum(shown, 1)
        parts[4] = shown * np.maximum(own - less, 0) / np.maximum(corpus.classes[kind] - less, 1)
    for name in without:
        parts[PARTS.index(name)] = 0
    kind = np.searchsorted(_FAR, nth, side="right") * (len(_MET) + 1) + np.searchsorted(_MET, met, side="right")
    return Places(own, text, kind, parts, opens, {"seen": seen, "follows": follows, "met": met, "shown": shown})


def _written(model, without: tuple[str, ...]):
    """A block's texts with the places of their words, as ``read_places`` takes them: what follows from counts is left out, and small probabilities are logarithms."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"payload": pa.array([], pa.binary())})
        block = unpack(rows.column("payload")[0].as_buffer())
        found = places(block, answers, model, without=without)
        subword = np.log10(np.maximum(found.parts[1], 1e-300)).astype(np.float32)
        payload = pack(
            **{k: block[k] for k in ("ids", "known", "held", "counts")}, own=narrow(found.own), kind=found.kind.astype(np.uint8), opens=found.opens.astype(np.uint8),
            subword=subword, shown=found.told["shown"].astype(np.float32), **{k: narrow(found.told[k]) for k in ("seen", "follows", "met")},
        )
        tb.release()
        return pa.table({"payload": pa.array([payload], pa.binary())})

    return run


def read_places(block: dict[str, np.ndarray], corpus: Corpus, leave_out: bool = False, without: tuple[str, ...] = (), only: np.ndarray | None = None) -> Places:
    """The places that ``_written`` has written, of the texts that ``only`` marks; those of ``places`` with ``leave_out`` follow from a word's count."""
    words = block["counts"].astype(np.int64) + 1
    text = np.repeat(np.arange(len(block["ids"])), words)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(words) - words, words)
    told = {k: block[k] for k in ("own", "kind", "opens", "subword", "shown", "seen", "follows", "met")}
    if only is not None and not only.all():
        chosen = only[text]
        text, nth, told = text[chosen], nth[chosen], {k: x[chosen] for k, x in told.items()}
    own, opens = told["own"].astype(np.int64), told["opens"].astype(np.int64)
    less = (block["held"] == 0)[text].astype(np.int64) if leave_out else 0
    left, of_class = own - less, corpus.classes[opens] - less
    parts = np.zeros((len(PARTS), len(own)))
    np.maximum(left, 0, out=left)
    np.divide(left, np.maximum(corpus.tokens - less, 1), out=parts[0])
    np.exp(told["subword"] * np.log(10.0), out=parts[1])
    np.divide(told["seen"], np.maximum(nth, 1), out=parts[2])
    np.divide(told["follows"], np.maximum(told["met"], 1), out=parts[3])
    np.divide(left, np.maximum(of_class, 1), out=parts[4])
    parts[4] *= told["shown"]
    for name in without:
        parts[PARTS.index(name)] = 0
    return Places(own, text, told["kind"].astype(np.int64), parts, opens)


def _to_fit(corpus, without: tuple[str, ...]):
    """Kinds and parts of the places of a block's learning texts, each word counted without itself."""

    def read(payload) -> tuple[np.ndarray, np.ndarray]:
        block = unpack(payload)
        found = read_places(block, corpus.value, True, without, block["held"] == 0)
        return found.kind, found.parts

    return read


def mixed(found: Places, weights: np.ndarray) -> np.ndarray:
    """The probability of each word: its parts by the weights of its kind of place."""
    return (found.parts * weights[found.kind].T).sum(axis=0)


_RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score(corpus, without: tuple[str, ...]):
    def run(batches):
        total = corpus.value
        scale = total.tokens + ADD * (total.distinct + 1)
        for batch in batches:
            for payload in batch.column("payload"):
                block = unpack(payload.as_buffer())
                found = read_places(block, total, without=without)
                n = len(block["ids"])
                sums = lambda values: np.bincount(found.text, weights=values, minlength=n)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block["ids"], mask=block["known"] == 0),
                        pa.array(block["held"] > 0),
                        pa.array(block["counts"].astype(np.int64) + 1),
                        pa.array(sums(found.own > 0).astype(np.int64)),
                        pa.array(np.full(n, total.tokens, dtype=np.int64)),
                        pa.array(sums(np.log10((found.own + ADD) / scale))),
                        pa.array(sums(np.log10(np.maximum(mixed(found, total.weights), 1e-300)))),
                    ],
                    schema=_RESULT,
                )
        tb.release()

    return run


def score(docs: DataFrame, held_out: Column, tokenizer_path: str = TOKENIZER, windows: int = SHARD_WINDOWS, block_bytes: int = BLOCK_BYTES, without: tuple[str, ...] = ()) -> DataFrame:
    """Base and model scores of all rows of ``docs``; rows for which the Column ``held_out`` holds are not learned from.

    ``windows``: about so many are a shard. ``without``: names of ``PARTS`` to leave out, which shows what each is good for.
    """
    spark = hf.whole_ids(docs).sparkSession
    runtime.ship_package(spark)
    with open(tokenizer_path, "rb") as file:
        model = file.read()
    pieces = tokenizer(model)
    size = pieces.get_piece_size()
    first = np.array([pieces.id_to_piece(i).startswith("▁") for i in range(size)])
    blocks = _ingest(docs, F.coalesce(held_out, F.lit(False)), model, block_bytes)
    count = blocks.count()
    frequent = frequent_words(blocks, count)
    shipped = spark.sparkContext.broadcast(frequent)

    def add(total, block):
        """Counts of the subwords, of the learning texts, of the frequent words, and of the words by their first subword."""
        total[:size] += np.bincount(block["pieces"], weights=np.repeat(block["train"], block["sizes"]), minlength=size).astype(np.int64)
        total[size] += (block["held"] == 0).sum()
        at, often = tb.is_in(block["hashes"], shipped.value)
        total[size + 1 + at[often]] += block["train"][often]
        opens = block["pieces"][np.cumsum(block["sizes"]) - block["sizes"]]
        total[size + 1 + len(frequent) :][:size] += np.bincount(opens, weights=block["train"], minlength=size).astype(np.int64)

    sums = _summed(blocks, 2 * size + 1 + len(frequent), add)
    piece_counts, often, opened = np.split(sums, [size + 1, size + 1 + len(frequent)])
    # A block holds as many bytes of text as a bucket's share of the blocks says.
    buckets = max(1, -(-count * block_bytes // BUCKET_CHARS))
    answers = blocks.mapInArrow(_send(shipped, buckets), _SENT).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_total, "block bigint, bucket bigint, counts binary, tokens bigint, words bigint")
    answers = runtime.materialize(answers, "counts")
    runtime.free_shuffles(spark)
    told = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    texts = int(piece_counts[size])
    voc = attention.vocabulary(piece_counts.astype(np.float64), first)
    classes = np.bincount(voc.kind, weights=np.append(opened, texts), minlength=attention.CLASSES)
    corpus = Corpus(int(told["tokens"]) + int(often.sum()) + texts, int(told["words"]) + int((often > 0).sum()) + int(texts > 0), texts, frequent, often, classes)
    net, pairs = _train(blocks, spark.sparkContext.broadcast(voc), int(piece_counts.sum()), windows)
    scorer = attention.Scorer(net, voc, pairs)
    answers = answers.select("block", "bucket", "counts")
    model_of = spark.sparkContext.broadcast((scorer, corpus))
    found = blocks.select("block", "payload").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_written(model_of, without), "payload binary")
    runtime.free_shuffles(spark)
    found = runtime.materialize(found, "places")
    runtime.free_shuffles(spark)
    corpus.weights = np.maximum(fitted(found, KINDS, len(PARTS), read=_to_fit(spark.sparkContext.broadcast(corpus), without)), 1e-4)
    result = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return found.mapInArrow(_score(spark.sparkContext.broadcast(corpus), without), result)
