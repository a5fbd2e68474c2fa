"""Operator 13, n-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of a stated value or more.

A set is hashed into a parity sketch: each shingle flips one bit, so two sketches differ in at most as many bits as their sets have
shingles apart, and a sketch folds by exclusive or to any smaller power of two. For the join each bit is widened to a 64-bit word, the exclusive or of the
hashes of the shingles that fall on it. Two sets of sizes a and b that link differ in at most d = (a + b) (1 - s) / (1 + s) shingles, so of
m > d words at least m - d agree: the pigeonhole.

Sizes are cut into bands, each wide enough for a set of the smallest size and its largest partner. Two sets of one band meet in the band's own
family of keys, two of neighbouring bands in a family of their boundary, which only sizes that can have a partner beyond it take part in. A family has d + 1 + s words. A word on which no shingle falls
says nothing; a set of which at most s words are empty sends none of them, as a partner agrees with it in s + 1 words.
One with more empty words is hashed anew, and so is any partner with which it agrees in empty words alone; after ``ROUNDS`` rounds empty words are sent too.
No pair that links is lost.

Keys travel in packed lists, one list for each part of the key space and task, and a set is sent once by a task however many copies it has there. A reducer names the
keys that several sets share: pairs of sets for a key of few, rows for a crowded one. These are filtered by the whole sketches and sizes, crowded keys in
blocks of which each two meet, and what is left is joined to components of candidates. Last, the shingle sets of each such component are compared themselves: only
the stated similarity links, exactly. Shingles are told apart by 64-bit hashes.

Defined results: documents without words, null texts included, have no shingle and link with nothing, not even with each other. Repeated rows and copies are one
component; a null id is in no minimum, so a component of null ids alone is null. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache
from math import erfc, exp, factorial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold import runtime
from kinfold.llm import hashed_features as hf
from kinfold.llm import textblocks as tb
from kinfold.llm.simhash_wide import in_block_pairs
from kinfold.operators.components import connected_components

#: Words of a shingle; the similarity as a fraction.
SHINGLE, SIMILARITY = 5, (80, 100)
#: Hash functions that a set with too many empty words is sent by.
ROUNDS = 3
#: Share of the smallest sets of a family that may have too many empty words.
TOO_EMPTY = 0.1
#: Rows of keys that a task holds before it sends them, and that a reducer holds before it looks for crowded keys.
HELD_ROWS = 1 << 20
#: Parts of the key space for each shuffle partition.
PARTS = 4
#: Sets of a key that are paired at once; rows of a crowded key that one task compares.
FEW, CROWD_ROWS = 8, 8192
#: Shingles of the sets that one task compares, about; larger candidate components are cut into blocks.
GROUP_SHINGLES = 1 << 19
#: Least bits of a sketch, and bits for each shingle, at least.
SKETCH_BITS, BITS_A_SHINGLE = 64, 2
#: Parts that rows of one key are dealt into where a large table is joined to them.
TURNS = 32

_KEYED = np.dtype([("key", "<u8"), ("node", "<i8")])
_ODD = 0x9E3779B97F4A7C15


def _salt(*numbers: int) -> np.uint64:
    out = 0
    for x in numbers:
        out = (out * 0xD6E8FEB86659FD93 + x + 1) * _ODD & (2**64 - 1)
    return np.uint64(out)


@lru_cache(maxsize=64)
def bands(similarity: tuple[int, int], upto: int) -> list[int]:
    """The least size of each band, the first one beyond ``upto`` included."""
    num, den = similarity
    out = [1]
    while out[-1] <= upto:
        out.append(max(out[-1] + 1, -(-out[-1] * den * den // (num * num))))
    return out


def most_apart(total: int | np.ndarray, similarity: tuple[int, int]):
    """How many shingles two linked sets differ in at most, when their sizes add up to ``total``."""
    num, den = similarity
    return total * (den - num) // (den + num)


@lru_cache(maxsize=4096)
def words_of(least: int, apart: int) -> tuple[int, int]:
    """Words of a family whose smallest set has ``least`` shingles, and how many of them may be empty."""
    best = None
    for spare in range(0, apart + 1, 1 + apart // 1000):
        m = apart + 1 + spare
        empty = m * (1 - 1 / m) ** least
        # The number of empty words is about Poisson's, or normal where they are many.
        tail = 1 - sum(exp(-empty) * empty**k / factorial(k) for k in range(spare + 1)) if empty < 20 and spare < 100 else 0.5 * erfc((spare + 0.5 - empty) / (2 * empty) ** 0.5)
        if best is None or tail < best[0]:
            best = tail, m, spare
        if tail <= TOO_EMPTY:
            break
    return best[1], best[2]


@lru_cache(maxsize=65536)
def families(size: int, similarity: tuple[int, int]) -> tuple[tuple[int, int, int], ...]:
    """Number, words and words that may be empty of each family that a set of this size takes part in.

    Families in which only equal sets could meet are left out: equal sets are one already.
    """
    num, den = similarity
    low = bands(similarity, size * den // num + 1)
    t = int(np.searchsorted(low, size, side="right")) - 1
    out = []
    if apart := most_apart(2 * (low[t + 1] - 1), similarity):
        out.append((2 * t, *words_of(low[t], apart)))
    for boundary in {t, t + 1}:
        c = low[boundary]
        least, most = -(-num * c // den), den * (c - 1) // num
        if c > 1 and most >= c and least <= size <= most and (apart := most_apart(c - 1 + most, similarity)):
            out.append((2 * boundary + 1, *words_of(least, apart)))
    return tuple(out)


def shingle_sets(column: pa.Array, shingle: int) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles; fewer words are one, a blank text has none."""
    data, offsets = tb.column_bytes(column)
    out: list[np.ndarray] = []
    for i, j in tb.pieces(offsets):
        own, at = tb.piece_of(data, offsets, i, j)
        own = tb.translate(own, tb.LOWER)
        starts, ends, first = tb.word_bounds(own, at)
        words = tb.span_hashes(own, starts, ends)
        windows = tb.window_hashes(words, shingle)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= shingle:
                out.append(np.unique(windows[a : b - shingle + 1]))
            else:
                # The number of words is part of the hash: a short text is no window of a longer one.
                out.append(tb.mix(tb.window_hashes(words[a:b], b - a) + np.uint64(b - a)) if b > a else words[:0])
    return out


def name_of(own: np.ndarray) -> int:
    """A hash that names a set."""
    x = xxhash.xxh64_intdigest(own.tobytes(), 42)
    return x - (1 << 64) if x >> 63 else x


def sketch(own: np.ndarray) -> bytes:
    """The parity of the shingles that fall on each bit."""
    bits = max(SKETCH_BITS, 1 << int(BITS_A_SHINGLE * len(own) - 1).bit_length()) if len(own) else SKETCH_BITS
    flips = np.bincount((tb.mix(own + np.uint64(1)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, all folded to the shortest one's length."""
    least = min(len(s) for s in sketches) // 8
    return np.array([np.bitwise_xor.reduce(np.frombuffer(s, dtype="<u8").reshape(-1, least), axis=0) for s in sketches])


def keys_of(sets: list[np.ndarray], similarity: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The keys that each set is sent by, and the place of the set for each."""
    keys, owners = [], []
    todo = [(k, f) for k, own in enumerate(sets) if len(own) for f in families(len(own), similarity)]
    for round_ in range(ROUNDS):
        if not todo:
            break
        sizes = np.array([len(sets[k]) for k, _ in todo])
        many = np.array([f[1] for _, f in todo])
        spare = np.array([f[2] for _, f in todo])
        begin = np.concatenate([[0], np.cumsum(many)])
        flat = np.concatenate([sets[k] for k, _ in todo])
        salts = np.repeat(np.array([_salt(f[0], round_) for _, f in todo], dtype=np.uint64), sizes)
        hashed = tb.mix(flat + salts)
        # The upper half of the hash chooses the word.
        at = np.repeat(begin[:-1], sizes) + ((hashed >> np.uint64(32)) * np.repeat(many, sizes).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        values = np.zeros(begin[-1], dtype=np.uint64)
        np.bitwise_xor.at(values, at, tb.mix(hashed ^ np.uint64(_ODD)))
        full = np.bincount(at, minlength=begin[-1]) > 0
        which = np.repeat(np.arange(len(todo)), many)
        place = (np.arange(begin[-1]) - np.repeat(begin[:-1], many)).astype(np.uint64)
        empty = many - np.add.reduceat(full.astype(np.int64), begin[:-1])
        again = empty > spare
        sent = full | again[which] if round_ == ROUNDS - 1 else full
        tags = np.array([_salt(f[0], round_, 7) for _, f in todo], dtype=np.uint64)
        keys.append(tb.mix(tb.mix(values + tags[which]) + place)[sent])
        owners.append(np.array([k for k, _ in todo])[which][sent])
        todo = [todo[i] for i in np.flatnonzero(again).tolist()]
    if not keys:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def _described(shingle: int):
    """doc_id, the name and size of its set, and the sketch."""

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column("text"), shingle)
            names = [pa.array([name_of(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([sketch(x) for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *names], names=["doc_id", "node", "n", "sketch"])
        tb.release()

    return run


def _binary(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * flat.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes())]).cast(pa.binary())


def _sent(shingle: int, similarity: tuple[int, int], parts: int):
    """The keys of the texts' sets, packed by parts of the key space."""

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held)
        part = ((rows["key"] >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        sizes = np.bincount(part, minlength=parts)
        there = np.flatnonzero(sizes)
        return pa.RecordBatch.from_arrays([pa.array(there), _binary(rows[order], sizes[there])], names=["part", "rows"])

    def run(batches):
        seen: set[int] = set()
        held, n = [], 0
        for batch in batches:
            sets = []
            for own in shingle_sets(batch.column("text"), shingle):
                if len(own) and (name := name_of(own)) not in seen:
                    seen.add(name)
                    sets.append((name, own))
            # Some hundred thousand shingles at once.
            at = 0
            while at < len(sets):
                end, shingles = at, 0
                while end < len(sets) and shingles < 1 << 18:
                    shingles += len(sets[end][1])
                    end += 1
                keys, owners = keys_of([x for _, x in sets[at:end]], similarity)
                rows = np.empty(len(keys), dtype=_KEYED)
                rows["key"], rows["node"] = keys, np.array([x for x, _ in sets[at:end]], dtype=np.int64)[owners]
                held.append(rows)
                n += len(rows)
                at = end
                if n > HELD_ROWS:
                    yield packed(held)
                    held, n = [], 0
        if n:
            yield packed(held)
        tb.release()

    return run


def _runs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in order of key and node, and the first row and the length of each key."""
    rows = rows[np.lexsort((rows["node"], rows["key"]))]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["node"][1:] != rows["node"][:-1])
    rows = rows[new]
    first = np.flatnonzero(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]])) if len(rows) else np.zeros(0, dtype=np.int64)
    return rows, first, np.diff(np.append(first, len(rows)))


_SHARED = "key bigint, a bigint, b bigint"


def _shared(batches):
    """Reads packed keys sorted by part: for keys of few sets the pairs of these (key null), for crowded keys their rows (b null)."""

    def crowd(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows["key"].view(np.int64)), pa.array(rows["node"]), pa.nulls(len(rows), pa.int64())], names=["key", "a", "b"])

    def split(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of crowded keys, and the others."""
        rows, _, sizes = _runs(rows)
        many = np.repeat(sizes > FEW, sizes)
        return rows[many], rows[~many]

    def paired(rows: np.ndarray) -> pa.RecordBatch:
        rows, first, sizes = _runs(rows)
        a, b = [], []
        for shift in range(1, FEW):
            at = np.flatnonzero(rows["key"][shift:] == rows["key"][:-shift]) if len(rows) > shift else np.zeros(0, dtype=np.int64)
            a.append(rows["node"][at])
            b.append(rows["node"][at + shift])
        both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.nulls(len(both), pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["key", "a", "b"])

    part, held, n, limit, crowded = None, [], 0, HELD_ROWS, np.zeros(0, dtype=np.uint64)

    def finished():
        many, few = split(np.concatenate(held))
        yield crowd(many)
        yield paired(few)

    for batch in batches:
        for own, packed in zip(batch.column("part").to_pylist(), batch.column("rows"), strict=True):
            if own != part:
                if held:
                    yield from finished()
                part, held, n, limit, crowded = own, [], 0, HELD_ROWS, np.zeros(0, dtype=np.uint64)
            rows = np.frombuffer(packed.as_py(), dtype=_KEYED)
            if len(crowded):
                known = tb.is_in(rows["key"], crowded)[1]
                if known.any():
                    yield crowd(rows[known])
                    rows = rows[~known]
            held.append(rows)
            n += len(rows)
            if n > limit:
                # Keys found crowded are sent on at once, so that what is held follows the number of keys.
                many, few = split(np.concatenate(held))
                yield crowd(many)
                crowded = np.union1d(crowded, many["key"])
                held, n = [few], len(few)
                limit = max(HELD_ROWS, 2 * n)
    if held:
        yield from finished()


def _close(p: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """Whether sketches and sizes allow a link."""
    num, den = similarity
    fits = np.minimum(a, b) * den >= np.maximum(a, b) * num
    return fits & (np.bitwise_count(p ^ q).sum(axis=-1, dtype=np.int64) <= most_apart(a + b, similarity))


def _near(similarity: tuple[int, int]):
    """Reads pairs with sizes and sketches, returns those that may link."""

    def run(batches):
        for batch in batches:
            n, m = np.asarray(batch.column("na")), np.asarray(batch.column("nb"))
            keep = np.zeros(batch.num_rows, dtype=bool)
            fits = np.flatnonzero(np.minimum(n, m) * similarity[1] >= np.maximum(n, m) * similarity[0])
            left, right = batch.column("sa"), batch.column("sb")
            for k in fits.tolist():
                p, q = folded([left[k].as_py(), right[k].as_py()])
                keep[k] = int(np.bitwise_count(p ^ q).sum()) <= most_apart(int(n[k] + m[k]), similarity)
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], names=["a", "b"])

    return run


def _by_key(batches):
    """The rows of each key, from rows sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column("key"))
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0].column("key")[0].as_py() != int(keys[i]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


_EDGES = "a bigint, b bigint"


def _edges(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def grown(nodes: np.ndarray, near) -> tuple[list[int], list[int]]:
    """Links that span the components of ``nodes``. near(one, left): which of the places ``left`` link with the place ``one``."""
    left, a, b = np.arange(len(nodes)), [], []
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            one = front.pop()
            hit = near(one, left)
            if hit.any():
                reached, left = left[hit], left[~hit]
                a += [int(nodes[one])] * len(reached)
                b += nodes[reached].tolist()
                front += reached.tolist()
    return a, b


def _crowds(similarity: tuple[int, int]):
    """Reads crowded keys with sizes and sketches, returns links that span what may link."""

    def run(batches):
        for rows in _by_key(batches):
            nodes, n = rows.column("node").to_numpy(), rows.column("n").to_numpy()
            prints = folded(rows.column("sketch").to_pylist())
            yield _edges(*grown(nodes, lambda one, left: _close(prints[left], prints[one], n[left], n[one], similarity)))  # noqa: B023

    return run


def _with_sets(shingle: int):
    """Replaces the text by its shingle set, where that is the one that was named."""

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column("text"), shingle)
            own = np.array([name_of(x) for x in sets], dtype=np.int64) == np.asarray(batch.column("node"))
            at = pa.array(np.flatnonzero(own))
            hashes = pa.array([sets[k].tobytes() for k in np.flatnonzero(own).tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("key", "node", "blocks")), hashes], names=["key", "node", "blocks", "hashes"])
        tb.release()

    return run


def linked_sets(nodes: np.ndarray, sets: list[np.ndarray], similarity: tuple[int, int]) -> tuple[list[int], list[int]]:
    """Links that span the components of the sets that have the stated similarity."""
    num, den = similarity
    sizes = np.array([len(x) for x in sets])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(flat, np.cumsum(sizes)[:-1])
    held = np.zeros(len(names), dtype=np.int64)

    def near(one: int, left: np.ndarray) -> np.ndarray:
        out = np.zeros(len(left), dtype=bool)
        fits = np.flatnonzero((np.minimum(sizes[left], sizes[one]) * den >= np.maximum(sizes[left], sizes[one]) * num))
        if len(fits):
            held[own[one]] = 1
            ends = np.cumsum(sizes[left[fits]])
            shared = np.add.reduceat(held[np.concatenate([own[k] for k in left[fits].tolist()])], np.concatenate([[0], ends[:-1]]))
            held[own[one]] = 0
            out[fits] = den * shared >= num * (sizes[left[fits]] + sizes[one] - shared)
        return out

    return grown(nodes, near)


def _verified(similarity: tuple[int, int]):
    """Reads shingle sets sorted by key and returns links within each key."""

    def run(batches):
        for rows in _by_key(batches):
            nodes, first = np.unique(rows.column("node").to_numpy(), return_index=True)
            column = rows.column("hashes")
            yield _edges(*linked_sets(nodes, [np.frombuffer(column[k].as_py(), dtype=np.uint64) for k in first.tolist()], similarity))

    return run


def _joined(rows: DataFrame, named: DataFrame, key: str, n: int, how: str = "inner") -> DataFrame:
    """``rows`` with the row of ``named``, of ``n`` rows at most, that has their key; a frequent key is dealt out where that is not small."""
    if n <= runtime.BROADCAST_ROWS:
        return rows.join(F.broadcast(named), key, how)
    turns = named.withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(TURNS - 1))))
    return rows.withColumn("_turn", F.pmod(F.xxhash64(*rows.columns), F.lit(TURNS)).cast("int")).join(turns, [key, "_turn"], how).drop("_turn")


def candidates(texts: DataFrame, groups: DataFrame, similarity: tuple[int, int], shingle: int, crowd_rows: int = CROWD_ROWS) -> DataFrame:
    """(a, b): links among sets that span, at least, the components of those with the stated similarity. groups: node, n and sketch of each distinct set."""
    parts = PARTS * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = texts.select("text").mapInArrow(_sent(shingle, similarity, parts), "part bigint, rows binary")
    shared = runtime.materialize(keyed.repartition("part").sortWithinPartitions("part").mapInArrow(_shared, _SHARED), "shared")
    pairs = shared.where(F.col("key").isNull()).select("a", "b").distinct()
    own = groups.select("node", "n", "sketch")
    for c in ("a", "b"):
        pairs = pairs.join(own.withColumnsRenamed({"node": c, "n": f"n{c}", "sketch": f"s{c}"}), c)
    found = pairs.mapInArrow(_near(similarity), _EDGES)
    crowded = shared.where(F.col("key").isNotNull()).select("key", F.col("a").alias("node")).distinct()
    if shared.where(F.col("key").isNotNull()).isEmpty():
        return found
    crowded = runtime.materialize(crowded, "crowded")
    large = crowded.groupBy("key").count().where(F.col("count") > crowd_rows).select("key", F.ceil(F.lit(2.0) * F.col("count") / crowd_rows).cast("bigint").alias("blocks"))
    dealt = crowded.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("bigint")))
    rows = in_block_pairs(dealt, "key", "blocks").join(own, "node").select("key", "node", "n", "sketch")
    return found.union(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_crowds(similarity), _EDGES))


def verified(docs: DataFrame, groups: DataFrame, roots: DataFrame, similarity: tuple[int, int], shingle: int, most: int = GROUP_SHINGLES) -> DataFrame:
    """(a, b): links of the stated similarity that span its components within each component of candidates. groups: node, n and doc_id of each distinct set."""
    members = roots.union(roots.select(F.col("root").alias("node"), "root").distinct()).join(groups.select("node", "n", F.col("doc_id").alias("id")), "node")
    members = runtime.materialize(members, "members", narrow=8)
    large = members.groupBy("root").agg(F.sum("n").alias("n")).where(F.col("n") > most).select("root", F.ceil(F.lit(2.0) * F.col("n") / most).cast("bigint").alias("blocks"))
    dealt = members.join(large, "root", "left").select("id", "node", F.col("root").alias("key"), F.coalesce("blocks", F.lit(1).cast("bigint")).alias("blocks"))
    # Where the candidates are few, the texts are not shuffled. Of several rows with the id those whose set is another are dropped by its name.
    texts = docs.join(runtime.if_small(dealt, members.count()), F.col("doc_id").eqNullSafe(F.col("id")))
    sets = texts.select("key", "node", "blocks", "text").mapInArrow(_with_sets(shingle), "key bigint, node bigint, blocks bigint, hashes binary")
    sets = in_block_pairs(sets, "key", "blocks").select("key", "node", "hashes")
    return sets.repartition("key").sortWithinPartitions("key").mapInArrow(_verified(similarity), _EDGES)


def join(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY, shingle: int = SHINGLE, crowd_rows: int = CROWD_ROWS, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of ``docs``."""
    runtime.ship_package(docs.sparkSession)
    docs = hf.whole_ids(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = runtime.materialize(docs.mapInArrow(_described(shingle), "doc_id bigint, node bigint, n bigint, sketch binary"), "sets")
    grouped = described.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("docs"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    groups = runtime.materialize(grouped, "groups")
    roots = connected_components(candidates(docs, groups, similarity, shingle, crowd_rows))
    roots = runtime.materialize(connected_components(verified(docs, groups, roots, similarity, shingle, group_shingles)), "roots", narrow=8)
    # Sets of one document that link with none need no name.
    rooted = groups.select("node", "doc_id", "docs").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = runtime.materialize(rooted, "rooted", narrow=8)
    named = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.sum("docs").alias("docs")).where("docs > 1").select("root", "component_id")
    named = runtime.materialize(named, "named", narrow=8)
    of_node = runtime.materialize(_joined(rooted.select("node", "root"), named, "root", named.count()).select("node", "component_id", F.lit(True).alias("together")), "of-node", narrow=8)
    found = _joined(described.select("doc_id", "node", "n"), of_node, "node", of_node.count(), "left")
    alone = F.col("together").isNull() | (F.col("n") == 0)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


#: The same result in SQL, from all pairs of documents that share a shingle.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS t FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.c) AS component_id FROM d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
