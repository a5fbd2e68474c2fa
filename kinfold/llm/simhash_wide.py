"""Near copies of a stated similarity by wide SimHash fingerprints: the corpus form of operator 3.

The similarity is the one that SimHash stands for: the cosine of the sets of word shingles, shared shingles over the root
of the product of the sets' sizes (0.8 is a Jaccard similarity of 2/3 for sets of equal size). Texts of that
similarity differ in about 20 of 100 SimHash bits. An exact search at such a distance is out of reach over a large
corpus, so this form takes 512 bits and the steps of operator 3 with a stated recall in place of certainty: bits that go
together are grouped into partitions; a dynamic programme gives each partition its own threshold (not searched, equal, one
bit apart) so that the estimated rows and candidates cost least while a pair at the stated similarity shares a bucket with
probability ``RECALL``; each fingerprint is sent to the bucket of every value within the threshold, and a bucket's members
are filtered by their distance over the first bits. A few bits alone would bring ever more unrelated texts
together as a corpus grows, and more bits need ever more buckets. So the name of a bucket also holds the least of the
text's shingles in an order that belongs to the partition: texts without a common shingle never meet, and the partitions, the rows
of a text and what links are alike at any number of texts.

A fingerprint counts each distinct shingle once, and a small distance only proposes a link: the shingle sets of each
component of candidates are then compared themselves, and what joins documents is the stated similarity, exactly.
A component with more than ``GROUP_SHINGLES`` shingles is cut into blocks of which each two meet.

Equal shingle sets are grouped first, so exact copies count once. Buckets return spanning forests, never all pairs. A bucket
of more than ``BUCKET_ROWS`` members is not held by one task: its members are cut into blocks and each two blocks
meet in a bucket of their own, so all members are compared however many they are.

Defined results are those of ``simhash``: blank and null texts are alike, the smallest id stays, of equal ids one row.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import acos, exp, lgamma, log, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold import runtime
from kinfold.llm import hashed_features as hf
from kinfold.llm import textblocks as tb
from kinfold.llm.simhash import _BYTE_BITS, _BYTE_PLACES, BUCKET_ROWS, PLAN_SAMPLE, SEED
from kinfold.operators.components import connected_components

#: Share of the pairs at the stated similarity that a search finds, by design.
RECALL = 0.99
#: Parts that the members of a component are dealt into where its name is joined to them.
TURNS = 32
#: Times 64 bits of a fingerprint, and those that candidates are filtered by, at any number of texts.
PRINT_WORDS, FILTER_WORDS = 8, 4
BITS = 64 * PRINT_WORDS
#: The filter lets a pair differ in so many standard deviations more bits than expected at the stated similarity.
SLACK = 4
#: The partitions are planned for pairs that differ in so many standard deviations more bits than expected.
MARGIN = 0.75
#: Bits of a partition, and the orders of shingles that partitions share.
WIDTH, ORDERS = 6, 24
#: Cost of checking one candidate against that of sending one row to a bucket.
CHECK_COST = 0.004
#: Shingles of the sets that one task compares, about; larger candidate components are cut into blocks.
GROUP_SHINGLES = 1 << 19

_ROWS = "key bigint, node bigint, print binary"


#: An odd factor for each order of the shingles.
_FACTORS = tb.mix(np.arange(1, ORDERS + 1, dtype=np.uint64)) | np.uint64(1)


@dataclass(frozen=True)
class Plan:
    """The partitions: bits, threshold and order of shingles; and the largest number of bits of the filter that candidates differ in."""

    groups: tuple[tuple[tuple[int, ...], int, int], ...]
    most: int

    @property
    def rows(self) -> int:
        """Rows that a fingerprint is sent in."""
        return sum(1 + t * len(bits) for bits, t, _ in self.groups)


def differing_share(similarity: float) -> float:
    """The expected share of differing bits for two sets with this cosine."""
    return acos(similarity) / pi


def meeting(similarity: float, width: int, apart: int, threshold: int) -> float:
    """The least probability that two texts at the similarity meet in a partition.

    ``width`` of all bits have at most ``threshold`` (0 or 1) of the ``apart`` differing ones; and the least shingle is a common one,
    which has the probability of the Jaccard similarity: with a cosine c no less than c * c, where one set is part of the other.
    """
    choose = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) if 0 <= k <= n else float("-inf")
    return similarity**2 * sum(exp(choose(apart, t) + choose(BITS - apart, width - t) - choose(BITS, width)) for t in range(threshold + 1))


def _bits_of(prints: np.ndarray) -> np.ndarray:
    """Fingerprints (n, words) as rows of bits."""
    return np.unpackbits(prints.view(np.uint8).reshape(len(prints), 8 * prints.shape[1]), axis=1, bitorder="little")


def bit_groups(prints: np.ndarray, width: int) -> list[np.ndarray]:
    """All bits in groups of ``width``: a group takes the bits that correlate most with it."""
    bits = _bits_of(prints).astype(np.float64)
    bits -= bits.mean(axis=0) if len(bits) else 0
    norm = np.sqrt((bits**2).sum(axis=0)) + 1e-9
    near = np.abs((bits / norm).T @ (bits / norm))
    groups, left = [], np.ones(BITS, dtype=bool)
    for _ in range(BITS // width):
        own = [int(np.argmax(left))]
        left[own] = False
        pull = near[own[0]].copy()
        while len(own) < width:
            best = int(np.argmax(np.where(left, pull, -1)))
            own.append(best)
            left[best] = False
            pull += near[best]
        groups.append(np.sort(own))
    return groups


def _values(bits: np.ndarray, group: np.ndarray) -> np.ndarray:
    return bits[:, group].astype(np.uint64) @ (np.uint64(1) << np.arange(len(group), dtype=np.uint64))


def candidate_shares(values: np.ndarray, least: np.ndarray, width: int) -> tuple[float, float]:
    """The share of the pairs of a sample with the same least shingle that agree in a partition, and that agree up to one bit."""
    n = max(len(values) * (len(values) - 1), 1)
    named = (tb.mix(least) << np.uint64(width)) | values
    distinct, counts = np.unique(named, return_counts=True)
    equal, one = float((counts * (counts - 1)).sum()), 0
    for k in range(width if len(distinct) else 0):
        at = np.minimum(np.searchsorted(distinct, distinct ^ np.uint64(1 << k)), len(distinct) - 1)
        hit = distinct[at] == distinct ^ np.uint64(1 << k)
        one += int((counts[hit] * counts[at[hit]]).sum())
    return equal / n, (equal + one) / n


def plan(prints: np.ndarray, least: np.ndarray, texts: int, similarity: float, recall: float = RECALL, width: int = WIDTH) -> Plan:
    """Partitions and thresholds of least estimated cost that find a pair at the similarity with the probability ``recall``.

    prints (n, PRINT_WORDS), least (n, ORDERS): a sample of the fingerprints and least shingles; texts: how many there are. Each choice of a threshold has a
    cost, rows and candidates of one text, and a gain, the log of the probability to miss the pair there; the programme has, for each sum of gains, the least cost.
    """
    share = differing_share(similarity)
    apart = round(BITS * share + MARGIN * (BITS * share * (1 - share)) ** 0.5)
    wanted, gains = -log(1 - recall), [-log(1 - meeting(similarity, width, apart, t)) for t in (0, 1)]
    groups = bit_groups(prints, width)
    if wanted > len(groups) * gains[0]:
        raise ValueError("a lower similarity than the partitions can find with this recall")
    bits = _bits_of(prints)
    steps = 2000
    cells = [int(g / wanted * steps) for g in gains]
    # cheapest[s]: least cost with a sum of gains of s or more cells, by the choices so far.
    cheapest = np.full(steps + 1, np.inf)
    cheapest[0] = 0
    chosen = np.zeros((len(groups), steps + 1), dtype=np.int8)
    for number, group in enumerate(groups):
        shares = candidate_shares(_values(bits, group), least[:, number % ORDERS], width)
        best = cheapest.copy()
        for t in (0, 1):
            # From a sum that is short by no more than this gain, the choice reaches s.
            reached = cheapest[np.maximum(np.arange(steps + 1) - cells[t], 0)] + 1 + t * width + CHECK_COST * texts * shares[t]
            better = reached < best
            best[better], chosen[number][better] = reached[better], t + 1
        cheapest = best
    taken, s = [], steps
    for number in range(len(groups) - 1, -1, -1):
        if c := int(chosen[number][s]):
            taken.append((tuple(int(b) for b in groups[number]), c - 1, number % ORDERS))
            s = max(s - cells[c - 1], 0)
    expected = 64 * FILTER_WORDS * share
    return Plan(tuple(reversed(taken)), int(expected + SLACK * (expected * (1 - share)) ** 0.5))


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``shingle`` words; fewer words are one run, a blank text has none."""
    tokens = text.translate(tb.LOWER).split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: max(1, len(tokens) - shingle + 1)].tolist(), ends[min(shingle, len(tokens)) - 1 :].tolist(), strict=True)
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=np.uint64))


def fingerprint(hashes: np.ndarray, words: int = PRINT_WORDS) -> np.ndarray:
    """``words`` times 64 bits of a shingle set: each bit is set if it is set in over half of the hashes of its word."""
    out = np.zeros(words, dtype=np.uint64)
    if not len(hashes):
        return out
    for k in range(words):
        own = hashes if k == 0 else tb.mix(hashes + np.uint64(k * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        counts = np.bincount((own.view(np.uint8).reshape(-1, 8) + _BYTE_PLACES).ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
        out[k] = int.from_bytes(np.packbits(2 * counts > len(own), axis=1, bitorder="little").tobytes(), "little")
    return out


def least_shingles(hashes: np.ndarray) -> np.ndarray:
    """The least shingle of a set in each of the orders; zeros for an empty set."""
    if not len(hashes):
        return np.zeros(ORDERS, dtype=np.uint64)
    return np.min([(part[:, None] * _FACTORS).min(axis=0) for part in np.array_split(hashes, -(-len(hashes) // 65536))], axis=0)


def _sets_of(column: pa.Array, shingle: int):
    data, offsets = tb.column_bytes(column)
    own = data.tobytes()
    return [shingle_set(own[a:b], shingle) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _with_prints(docs: DataFrame, shingle: int, node: str, size: str, print_: str) -> DataFrame:
    """``docs`` with the hash that names a text's shingle set, the size of the set, and its fingerprint followed by its least shingles, under the given names."""
    at = docs.columns.index("text")

    def add(batches):
        for batch in batches:
            sets = _sets_of(batch.column(at), shingle)
            nodes = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], dtype=np.uint64).view(np.int64)
            prints = pa.array([fingerprint(x).tobytes() + least_shingles(x).tobytes() for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes), pa.array([len(x) for x in sets], pa.int64()), prints], names=[*batch.schema.names, node, size, print_])
        tb.release()

    more = [T.StructField(node, T.LongType()), T.StructField(size, T.LongType()), T.StructField(print_, T.BinaryType())]
    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, *more]))


def _prints_of(column: pa.Array, words: int) -> np.ndarray:
    data, _ = tb.column_bytes(column)
    return np.frombuffer(data.tobytes(), dtype=np.uint64).reshape(-1, words)


def partition_keys(prints: np.ndarray, p: Plan) -> np.ndarray:
    """The keys of every bucket that each fingerprint is sent to, one column each, from fingerprints followed by least shingles.

    A key hashes the partition's number, the value of its bits and the least shingle in its order.
    """
    own = np.ascontiguousarray(prints[:, :PRINT_WORDS])
    bits = _bits_of(own)
    out, at = np.empty((len(prints), p.rows), dtype=np.uint64), 0
    for number, (group, threshold, order) in enumerate(p.groups):
        values = _values(bits, np.array(group))
        for flip in [0] + [1 << k for k in range(len(group))] * threshold:
            tag = np.uint64((number + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
            out[:, at] = tb.mix(tb.mix((values ^ np.uint64(flip)) + tag) + prints[:, PRINT_WORDS + order])
            at += 1
    return out


def _emit(keys: np.ndarray, nodes: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
    size = prints.shape[1] * 8
    offsets = pa.py_buffer((np.arange(len(prints) + 1) * size).astype(np.int32).tobytes())
    packed = pa.Array.from_buffers(pa.binary(), len(prints), [None, offsets, pa.py_buffer(np.ascontiguousarray(prints).tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(nodes), packed], names=["key", "node", "print"])


def _send(p: Plan):
    """Rows for the bucket of every partition."""

    def run(batches):
        for batch in batches:
            prints, nodes = _prints_of(batch.column("print"), PRINT_WORDS + ORDERS), np.asarray(batch.column("node"))
            for part in np.array_split(np.arange(len(prints)), max(1, len(prints) // 4096)):
                keys = partition_keys(prints[part], p)
                yield _emit(keys.ravel(), np.repeat(nodes[part], p.rows), np.repeat(prints[part, :FILTER_WORDS], p.rows, axis=0))

    return run


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def forest(nodes: np.ndarray, prints: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """Links that span the components of a bucket, grown from one member to the next unreached ones."""
    left, a, b = np.arange(len(nodes)), [], []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            one = front.pop()
            near = _distance(prints[left], prints[one]) <= most
            if near.any():
                reached, left = left[near], left[~near]
                a += [int(nodes[one])] * len(reached)
                b += nodes[reached].tolist()
                front += reached.tolist()
    return a, b


def _links(p: Plan):
    """Reads rows sorted by key and returns links within each key."""

    def links_of(keys, nodes, prints):
        a, b = [], []
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(first, len(keys)))
        small = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= 32), sizes))
        k, n, x = keys[small], nodes[small], prints[small]
        for shift in range(1, min(32, len(k))):
            at = np.flatnonzero(k[shift:] == k[:-shift])
            if not len(at):
                break
            at = at[_distance(x[at], x[at + shift]) <= p.most]
            a += n[at].tolist()
            b += n[at + shift].tolist()
        for at, size in zip(first[sizes > 32], sizes[sizes > 32], strict=True):
            u, v = forest(nodes[at : at + size], prints[at : at + size], p.most)
            a += u
            b += v
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            own = np.asarray(batch.column("key")), np.asarray(batch.column("node")), _prints_of(batch.column("print"), FILTER_WORDS)
            held = own if held is None else tuple(np.concatenate([x, y]) for x, y in zip(held, own, strict=True))
            # The last key may go on in the next batch; its bucket is bounded.
            done = int(np.flatnonzero(np.concatenate([[True], held[0][1:] != held[0][:-1]]))[-1]) if len(held[0]) else 0
            if done:
                yield links_of(*(x[:done] for x in held))
                held = tuple(x[done:] for x in held)
        if held is not None and len(held[0]):
            yield links_of(*held)

    return run


_EDGES = "a bigint, b bigint"


def _in_buckets(rows: DataFrame, p: Plan) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_links(p), _EDGES)


def in_block_pairs(rows: DataFrame, key: str, blocks: str) -> DataFrame:
    """``rows`` (node bigint, and these columns) dealt anew: those of a key are cut into ``blocks`` parts, and each two parts meet under a key of their own.

    Any two rows of a key meet, so nothing is left uncompared however crowded the key is. Rows of one block keep to themselves.
    """
    own, other = F.pmod(F.xxhash64("node"), F.col(blocks)), F.col("_other")
    dealt = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(blocks) - 1)))
    dealt = dealt.where((F.col(blocks) == 1) | (other != F.col("_own")))
    pair = F.xxhash64(key, F.least("_own", other), F.greatest("_own", other))
    return dealt.withColumn(key, F.when(F.col(blocks) > 1, pair).otherwise(F.col(key))).drop("_own", "_other", blocks)


def links(prints: DataFrame, p: Plan, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): links among distinct texts (node bigint, print binary: fingerprint and least shingles) that the partitions bring together."""
    rows = prints.select("node", "print").mapInArrow(_send(p), _ROWS)
    hot = runtime.materialize(rows.groupBy("key").count().where(F.col("count") > bucket_rows), "hot")
    if hot.isEmpty():
        return _in_buckets(rows, p)
    found = _in_buckets(rows.join(hot, "key", "left_anti").select("key", "node", "print"), p)
    # Two blocks together are about as many rows as a bucket may have.
    blocks = F.ceil(F.lit(2.0) * F.col("count") / bucket_rows).cast("bigint")
    crowded = rows.join(hot.select("key", blocks.alias("blocks")), "key").select("key", "node", "print", "blocks")
    return found.union(_in_buckets(in_block_pairs(crowded, "key", "blocks").select("key", "node", "print"), p))


def similar_forest(nodes: np.ndarray, flat: np.ndarray, sizes: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """Links that span the components of sets whose cosine is ``similarity`` at least; ``flat`` has the sets end to end."""
    names, codes = np.unique(flat, return_inverse=True)
    ends = np.cumsum(sizes)
    held, left, a, b = np.zeros(len(names), dtype=np.int64), np.arange(len(nodes)), [], []
    own = [codes[i:j] for i, j in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
    while len(left) > 1:
        front, left, codes = [left[0]], left[1:], codes[sizes[left[0]] :]
        while front and len(left):
            one = front.pop()
            held[own[one]] = 1
            ends = np.cumsum(sizes[left])
            shared = np.diff(np.concatenate([[0], np.cumsum(held[codes])])[np.concatenate([[0], ends])])
            held[own[one]] = 0
            near = (shared > 0) & (shared >= similarity * np.sqrt(sizes[left] * float(sizes[one])) - 1e-9)
            if near.any():
                reached = left[near]
                codes, left = codes[np.repeat(~near, sizes[left])], left[~near]
                a += [int(nodes[one])] * len(reached)
                b += nodes[reached].tolist()
                front += reached.tolist()
    return a, b


def _with_sets(shingle: int):
    """Replaces the text by its shingle set."""

    def run(batches):
        for batch in batches:
            sets = pa.array([x.tobytes() for x in _sets_of(batch.column("text"), shingle)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("key", "node", "blocks")] + [sets], names=["key", "node", "blocks", "hashes"])

    return run


def _verified(similarity: float):
    """Reads shingle sets sorted by key and returns links within each key."""

    def links_of(keys, nodes, sets):
        a, b = [], []
        cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            u, v = similar_forest(nodes[i:j], np.concatenate(sets[i:j]), np.array([len(x) for x in sets[i:j]]), similarity)
            a += u
            b += v
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches):
        keys, nodes, sets = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), []
        for batch in batches:
            keys, nodes = np.concatenate([keys, np.asarray(batch.column("key"))]), np.concatenate([nodes, np.asarray(batch.column("node"))])
            data, offsets = tb.column_bytes(batch.column("hashes"))
            flat = np.frombuffer(data.tobytes(), dtype=np.uint64)
            sets += [flat[i:j] for i, j in zip((offsets[:-1] // 8).tolist(), (offsets[1:] // 8).tolist(), strict=True)]
            # The last key may go on in the next batch; its shingles are bounded.
            done = int(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[-1]) if len(keys) else 0
            if done:
                yield links_of(keys[:done], nodes[:done], sets[:done])
                keys, nodes, sets = keys[done:], nodes[done:], sets[done:]
        if len(keys):
            yield links_of(keys, nodes, sets)

    return run


def verified_links(held: DataFrame, row: str, groups: DataFrame, candidates: DataFrame, similarity: float, shingle: int, most: int = GROUP_SHINGLES) -> DataFrame:
    """(a, b): links of the stated similarity that span the components of all such pairs within each candidate component.

    held: the documents, numbered in the column ``row``; groups: node, size and first place of each distinct shingle set; candidates: (node, root).
    """
    members = candidates.union(candidates.select(F.col("root").alias("node"), "root").distinct()).join(groups.select("node", "size", F.col("first.row").alias("at")), "node")
    members = runtime.materialize(members, "members", narrow=8)
    large = members.groupBy("root").agg(F.sum("size").alias("size")).where(F.col("size") > most)
    large = large.select("root", F.ceil(F.lit(2.0) * F.col("size") / most).cast("bigint").alias("blocks"))
    dealt = members.join(large, "root", "left").select("at", "node", F.col("root").alias("key"), F.coalesce("blocks", F.lit(1).cast("bigint")).alias("blocks"))
    texts = held.select(F.col(row).alias("at"), "text")
    # Where the candidates are few, the texts are not shuffled.
    sets = texts.join(runtime.if_small(dealt, members.count()), "at").mapInArrow(_with_sets(shingle), "key bigint, node bigint, blocks bigint, hashes binary")
    sets = in_block_pairs(sets, "key", "blocks").select("key", "node", "hashes")
    return sets.repartition("key").sortWithinPartitions("key").mapInArrow(_verified(similarity), _EDGES)


def planned(groups: DataFrame, similarity: float) -> Plan:
    """The plan for the distinct fingerprints ``groups`` (node, print), from a bounded sample of them."""
    total = groups.count()
    u = hf.uniform(F.col("node"))
    sample = groups.where(u < PLAN_SAMPLE / max(total, 1)).orderBy(u, "node").limit(PLAN_SAMPLE).select("print").collect()
    own = np.array([np.frombuffer(r["print"], dtype=np.uint64) for r in sample], dtype=np.uint64).reshape(-1, PRINT_WORDS + ORDERS)
    return plan(np.ascontiguousarray(own[:, :PRINT_WORDS]), own[:, PRINT_WORDS:], total, similarity)


def components(held: DataFrame, row: str, found: DataFrame, similarity: float, shingle: int, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, int]:
    """(node, first): for each distinct shingle set of ``found`` (node, size, print, place) the first place of its component; and the number of components."""
    groups = runtime.materialize(found.groupBy("node").agg(F.min("place").alias("first"), F.min("size").alias("size"), F.min("print").alias("print")), "prints")
    candidates = connected_components(links(groups, planned(groups, similarity), bucket_rows))
    roots = connected_components(verified_links(held, row, groups, candidates, similarity, shingle))
    # The members of a large component are dealt out in turns; a component of one has one turn.
    turn = F.when(F.col("root").isNotNull(), F.pmod("node", F.lit(TURNS))).otherwise(F.lit(0)).cast("int")
    rooted = groups.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"), turn.alias("turn"))
    rooted = runtime.materialize(rooted, "rooted", narrow=4)
    named = rooted.groupBy("root").agg(F.min("first").alias("first"), F.count("*").alias("n"))
    named = named.select("root", "first", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > 1, F.lit(TURNS - 1)).otherwise(F.lit(0)))).alias("turn"))
    kept = rooted.where("node = root").count()
    return rooted.select("node", "root", "turn").join(named, ["root", "turn"]).select("node", "first"), kept


def keep_one(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows of ``docs`` without those that another row of their component stands for."""
    spark = docs.sparkSession
    runtime.ship_package(spark)
    row, node, size, print_ = (runtime.spare_name(docs, n) for n in ("near_row", "near_node", "near_size", "near_print"))
    held = runtime.materialize(_with_prints(docs, shingle, node, size, print_).withColumn(row, F.monotonically_increasing_id()), "near")
    # Null ids come last: a false orders before a true.
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    found = held.select(F.col(node).alias("node"), F.col(size).alias("size"), F.col(print_).alias("print"), place.alias("place"))
    named, kept = components(held, row, found, similarity, shingle, bucket_rows)
    placed = found.select("node", "place").join(named, "node")
    gone = placed.where(F.col("place.row") != F.col("first.row")).select(F.col("place.row").alias(row))
    # Where few rows go, the texts are not shuffled.
    return held.join(runtime.if_small(gone, held.count() - kept), row, "left_anti").select(*docs.columns)
