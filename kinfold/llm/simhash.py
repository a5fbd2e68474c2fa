"""Operator 3, SimHash near-duplicates: generalised pigeonhole search over 64-bit fingerprints.

Fingerprints of whole texts are grouped first, so copies count once however many there are. The bits
are then cut into partitions of correlated bits, and a dynamic programme gives each partition its own
threshold: the thresholds plus one add up to the search distance plus one, so two fingerprints that
link agree within the threshold of at least one partition. The number of partitions and the thresholds
are those of least estimated cost, from a bounded sample of fingerprints; whatever is chosen, the result
is exact. Each fingerprint is sent to the bucket of every value within the threshold of its own, and each
bucket checks its members and returns a spanning forest of the links that it finds, never all pairs.

A bucket of more than ``BUCKET_ROWS`` members is not held by one task: its members are cut into blocks of which each
two meet in a bucket of their own, so a member is sent once for each block, and all are compared however many they are.

Defined results: null, empty and blank texts have fingerprint zero and link like any other. Fewer words
than a shingle are one shingle. Repeated rows keep their number. The smallest non-null doc_id names the
component. Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold import runtime
from kinfold.llm import hashed_features as hf
from kinfold.llm import textblocks as tb
from kinfold.operators.components import connected_components

BITS = 64
SEED = 42
#: Members of a bucket that one task compares; larger buckets go the other way.
BUCKET_ROWS = 16384
#: Fingerprints that the plan is estimated from, at most.
PLAN_SAMPLE = 3000
#: Cost of checking one candidate against that of sending one row to a bucket.
CHECK_COST = 0.002

_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE_PLACES = np.arange(8) * 256
_ONE = np.uint64(1)


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """The fingerprint of one text, given as UTF-8."""
    words = text.translate(tb.LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)], dtype=np.uint64)
    counts = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _BYTE_PLACES).ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int.from_bytes(np.packbits(2 * counts > len(hashes), axis=1, bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, shingle: int = 4, name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint of its text as a bigint column (the 64 bits, signed)."""
    runtime.ship_package(docs.sparkSession)
    at = docs.columns.index("text")

    def add(batches):
        for batch in batches:
            data, offsets = tb.column_bytes(batch.column(at))
            own = data.tobytes()
            prints = np.array([fingerprint(own[a:b], shingle) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints.view(np.int64))], names=[*batch.schema.names, name])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def ball(width: int, radius: int) -> int:
    return sum(comb(width, k) for k in range(radius + 1))


def bit_groups(prints: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in ``parts`` groups of nearly equal size; each group takes the bits that correlate most with it."""
    bits = ((prints[:, None] >> np.arange(BITS, dtype=np.uint64)) & _ONE).astype(np.float64)
    bits -= bits.mean(axis=0)
    norm = np.sqrt((bits**2).sum(axis=0)) + 1e-9
    near = np.abs((bits / norm).T @ (bits / norm))
    np.fill_diagonal(near, 0)
    left, groups = set(range(BITS)), []
    for size in [len(x) for x in np.array_split(np.arange(BITS), parts)]:
        own = [max(sorted(left), key=lambda b: near[b, sorted(left)].sum())]
        left.remove(own[0])
        while len(own) < size:
            best = max(sorted(left), key=lambda b: near[b, own].sum())
            own.append(best)
            left.remove(best)
        groups.append(sorted(own))
    return groups


def mask_of(bits: list[int]) -> np.uint64:
    return np.uint64(sum(1 << b for b in bits))


def plan(prints: np.ndarray, total: int, distance: int) -> list[tuple[list[int], int]]:
    """Groups of bits with their thresholds (-1: not searched), of least estimated cost for ``total`` fingerprints."""
    best: tuple[float, list] | None = None
    apart = prints[:, None] ^ prints[None, :] if len(prints) else np.zeros((0, 0), dtype=np.uint64)
    pairs = max(len(prints) * (len(prints) - 1), 1)
    for parts in range(2, distance + 2):
        groups = bit_groups(prints, parts) if len(prints) > 1 else [x.tolist() for x in np.array_split(np.arange(BITS), parts)]
        most = distance + 1 - parts
        cost = []
        for bits in groups:
            seen = np.bincount(np.bitwise_count(apart & mask_of(bits)).ravel(), minlength=BITS + 1).astype(np.float64)
            seen[0] -= len(prints)
            share = np.cumsum(seen) / pairs
            # A share below what uniform bits would give is sampling noise.
            cost.append([0.0] + [total * ball(len(bits), t) + CHECK_COST * total * total * max(share[t], ball(len(bits), t) / 2.0 ** len(bits)) for t in range(most + 1)])
        # reach[s]: least cost with the thresholds plus one of the groups so far summing to s.
        reach: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for own in cost:
            reach_next: dict[int, tuple[float, list[int]]] = {}
            for s, (c, chosen) in reach.items():
                for t, x in enumerate(own):
                    if s + t <= distance + 1 and (s + t not in reach_next or c + x < reach_next[s + t][0]):
                        reach_next[s + t] = (c + x, [*chosen, t - 1])
            reach = reach_next
        if distance + 1 in reach and (best is None or reach[distance + 1][0] < best[0]):
            best = reach[distance + 1][0], list(zip(groups, reach[distance + 1][1], strict=True))
    return best[1]


def flips(bits: list[int], radius: int) -> np.ndarray:
    """All masks that flip at most ``radius`` of the bits, the empty one first."""
    return np.array([sum(1 << b for b in chosen) for k in range(radius + 1) for chosen in combinations(bits, k)], dtype=np.uint64)


_KEYED = "key bigint, fp bigint"


def _emit(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(prints.view(np.int64))], names=["key", "fp"])


def _bucket_rows(groups: list[tuple[list[int], int]]):
    """Sends each fingerprint to its buckets. A key hashes the group's number with the value of its bits."""

    def send(batches):
        for batch in batches:
            prints = np.asarray(batch.column(0)).view(np.uint64)
            for number, (bits, threshold) in enumerate(groups):
                if threshold < 0:
                    continue
                tag = np.uint64((number + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
                for masks in np.array_split(flips(bits, threshold), max(1, ball(len(bits), threshold) // 64)):
                    values = ((prints & mask_of(bits))[:, None] ^ masks[None, :]).ravel()
                    yield _emit(tb.mix(values + tag), np.repeat(prints, len(masks)))

    return send


def links_in_bucket(prints: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among distinct fingerprints, grown from one to the next unreached ones."""
    left, a, b = prints, [], []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            one = front.pop()
            near = np.bitwise_count(left ^ one) <= distance
            if near.any():
                reached = left[near]
                left = left[~near]
                a += [one] * len(reached)
                b += reached.tolist()
                front += list(reached)
    return a, b


def _links(distance: int):
    """Reads rows sorted by key and returns links within each key."""

    def pairs_of(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        a, b = [], []
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(first, len(keys)))
        size_at = np.repeat(sizes, sizes)
        small = np.flatnonzero((size_at > 1) & (size_at <= 32))
        k, p = keys[small], prints[small]
        for shift in range(1, min(32, len(k))):
            same = k[shift:] == k[:-shift]
            if not same.any():
                break
            hit = same & (np.bitwise_count(p[shift:] ^ p[:-shift]) <= distance)
            a.append(p[:-shift][hit])
            b.append(p[shift:][hit])
        for at, size in zip(first[sizes > 32], sizes[sizes > 32], strict=True):
            x, y = links_in_bucket(np.unique(prints[at : at + size]), distance)
            a.append(np.array(x, dtype=np.uint64))
            b.append(np.array(y, dtype=np.uint64))
        a, b = (np.concatenate(x) if x else np.zeros(0, dtype=np.uint64) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.uint64).view(np.int64)) for x in (a, b)], names=["a", "b"])

    def run(batches):
        keys, prints = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
        for batch in batches:
            keys = np.concatenate([keys, np.asarray(batch.column(0)).view(np.uint64)])
            prints = np.concatenate([prints, np.asarray(batch.column(1)).view(np.uint64)])
            # The last key may go on in the next batch; its bucket is bounded.
            done = int(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[-1]) if len(keys) else 0
            if done:
                yield pairs_of(keys[:done], prints[:done])
                keys, prints = keys[done:], prints[done:]
        if len(keys):
            yield pairs_of(keys, prints)

    return run


def links(prints: DataFrame, distance: int = 4, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): links among the distinct fingerprints ``prints`` (fp bigint) whose components are those of all links."""
    from kinfold.llm.simhash_wide import in_block_pairs

    spark = prints.sparkSession
    runtime.ship_package(spark)
    total = prints.count()
    u = hf.uniform(F.col("fp"))
    sample = prints.where(u < PLAN_SAMPLE / max(total, 1)).orderBy(u, "fp").limit(PLAN_SAMPLE).collect()
    groups = plan(np.array([r["fp"] for r in sample], dtype=np.int64).view(np.uint64), total, distance)
    rows = prints.select("fp").mapInArrow(_bucket_rows(groups), _KEYED)
    # With more than one block a bucket is crowded; two blocks together are about as many rows as a bucket may have.
    blocks = F.ceil(F.lit(2.0) * F.col("count") / bucket_rows).cast("bigint")
    hot = runtime.materialize(rows.groupBy("key").count().where(F.col("count") > bucket_rows).select("key", blocks.alias("blocks")), "hot")
    met = lambda keyed: keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_links(distance), "a bigint, b bigint")
    if hot.isEmpty():
        return met(rows)
    crowded = in_block_pairs(rows.withColumnRenamed("fp", "node").join(hot, "key").select("key", "node", "blocks"), "key", "blocks")
    return met(rows.join(hot, "key", "left_anti").select("key", "fp")).union(met(crowded.select("key", F.col("node").alias("fp"))))


def components(prints: DataFrame, distance: int = 4, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of ``prints`` (doc_id, fp)."""
    groups = runtime.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    roots = connected_components(links(groups.select("fp"), distance, bucket_rows))
    rooted = groups.join(roots.withColumnsRenamed({"node": "fp"}), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = runtime.materialize(rooted, "rooted", narrow=4)
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4) -> DataFrame:
    """doc_id, fp and component_id for each row of ``docs``."""
    prints = runtime.materialize(with_fingerprints(hf.whole_ids(docs).select("doc_id", "text"), shingle).select("doc_id", "fp"), "fingerprints")
    return prints.join(components(prints, distance), "fp")


def keep_one(docs: DataFrame, distance: int = 4, shingle: int = 4) -> DataFrame:
    """The rows of ``docs`` without those that another row of their component stands for: the smallest doc_id stays, of equal ids one row."""
    row, fp = runtime.spare_name(docs, "near_row"), runtime.spare_name(docs, "near_fp")
    held = runtime.materialize(with_fingerprints(docs, shingle, fp).withColumn(row, F.monotonically_increasing_id()), "near")
    found = held.select("doc_id", F.col(fp).alias("fp"), F.col(row).alias("row"))
    placed = found.join(components(found.select("doc_id", "fp"), distance), "fp")
    # Null ids come last: the struct orders a null before any id.
    stays = placed.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")))["row"].alias("row"))
    gone = found.select("row").join(stays.select("row"), "row", "left_anti").withColumnRenamed("row", row)
    return held.join(gone, row, "left_anti").select(*docs.columns)
