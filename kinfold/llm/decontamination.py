"""Operator 6, benchmark decontamination: Wu-Manber multi-pattern search over words.

The patterns are the distinct windows of ``width`` consecutive benchmark words; an item of fewer words is
one shorter pattern. Patterns of one length are searched together. Their last two words are hashed into
a shift table: where no pattern has the two words that end at a position, the search skips ahead as far
as no pattern can end; where a pattern ends with them, the hash of its last words selects the few test
strings, and these are compared word by word and then byte by byte. Many cursors walk through many texts
at once, so the shifts are numpy operations over all of them.

The benchmark is taken in blocks of about ``PATTERNS`` windows, a long item in several segments, one pass over the texts for
each. A pass writes the covered words and found items of those documents that have any, under a hash of id and text, and these are put together
at the end. So the tables of one block only are held at a time, on the driver as on the executors, no text is written, and every item is
searched in every document. A benchmark of one block, the common case, is one pass without a shuffle.

Defined results: null texts have no words. Items without words or id find nothing; rows of a repeated
item_id are one item; the same passage in several items counts for each. Repeated documents are judged
row by row. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold import runtime
from kinfold.llm import hashed_features as hf
from kinfold.llm import textblocks as tb

WIDTH = 10
#: Windows of one block of the benchmark: some 50 MB on an executor, and a shift table of 16 to 32 MB.
PATTERNS = 250_000
#: Words of the block that the shift table looks at, and those that select test strings.
BLOCK_WORDS, SUFFIX_WORDS = 2, 4
#: Window starts that one cursor walks through.
RUN = 256

#: Word bytes: digits, letters after lower-casing, and all beyond ASCII.
IS_GAP = np.ones(256, dtype=bool)
IS_GAP[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = False

#: Bits of a slot in the shift table of a block, at least and at most, and slots for each word pair of its windows.
LEAST_BITS, MOST_BITS, SLOTS_A_PAIR = 12, 27, 8
_K = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    data = tb.translate(np.frombuffer(text.encode(), dtype=np.uint8), tb.LOWER)
    starts, ends, _ = tb.word_bounds(data, np.array([0, len(data)]), IS_GAP)
    own = data.tobytes()
    return [own[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _chain(ids: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
    """A hash of the ``count`` word ids that end at each position of ``at``."""
    h = np.zeros(len(at), dtype=np.uint64)
    for k in range(count - 1, -1, -1):
        h = tb.mix((h + ids[at - k].astype(np.uint64)) * _K)
    return h


@dataclass
class PatternTable:
    """Patterns of one length: word ids, their bytes, the shift table and the buckets by suffix hash."""

    length: int
    bits: int
    ids: np.ndarray
    texts: list[bytes]
    items: list[list[str]]
    shift: np.ndarray
    suffixes: np.ndarray
    bounds: np.ndarray


@dataclass
class Matcher:
    known: np.ndarray
    maybe: np.ndarray
    tables: list[PatternTable]

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """1 and up for a benchmark word, 0 for any other."""
        ids = np.zeros(len(hashes), dtype=np.int32)
        likely = np.flatnonzero(self.maybe[(hashes >> np.uint64(48)).astype(np.int64)])
        if len(likely):
            at = np.minimum(np.searchsorted(self.known, hashes[likely]), len(self.known) - 1)
            ids[likely] = np.where(self.known[at] == hashes[likely], at + 1, 0)
        return ids


def build(items: list[tuple[str, list[bytes]]], width: int = WIDTH) -> Matcher:
    """The search tables of some items (id, words)."""
    owners: dict[tuple[bytes, ...], set[str]] = {}
    for name, words in items:
        for i in range(max(1, len(words) - width + 1) if words else 0):
            owners.setdefault(tuple(words[i : i + width]), set()).add(name)
    vocabulary = sorted({w for p in owners for w in p})
    joined = np.frombuffer(b"".join(vocabulary), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in vocabulary]).astype(np.int64)
    hashes = tb.span_hashes(joined, ends - np.array([len(w) for w in vocabulary], dtype=np.int64), ends)
    known = np.sort(hashes)
    number = dict(zip(vocabulary, (np.searchsorted(known, hashes) + 1).tolist(), strict=True))
    maybe = np.zeros(1 << 16, dtype=bool)
    maybe[(known >> np.uint64(48)).astype(np.int64)] = True
    tables = []
    for length in sorted({len(p) for p in owners}):
        own = sorted(p for p in owners if len(p) == length)
        ids = np.array([[number[w] for w in p] for p in own], dtype=np.int32)
        block = min(BLOCK_WORDS, length)
        # Few slots hold two pairs of words, so a pair that no window has mostly shifts fully, however many windows there are.
        bits = min(max(LEAST_BITS, int(SLOTS_A_PAIR * len(own) * (length - block + 1) - 1).bit_length()), MOST_BITS)
        shift = np.full(1 << bits, length - block + 1, dtype=np.uint8 if length < 256 else np.int32)
        for end in range(block - 1, length):
            slot = (_chain_rows(ids[:, : end + 1], block) >> np.uint64(64 - bits)).astype(np.int64)
            # Later ends have smaller shifts.
            shift[slot] = length - 1 - end
        suffix = _chain_rows(ids, min(SUFFIX_WORDS, length))
        order = np.argsort(suffix, kind="stable")
        suffixes, first = np.unique(suffix[order], return_index=True)
        own = [own[i] for i in order]
        tables.append(PatternTable(length, bits, ids[order], [b" ".join(p) for p in own], [sorted(owners[p]) for p in own], shift, suffixes, np.append(first, len(own))))
    return Matcher(known, maybe, tables)


def _chain_rows(ids: np.ndarray, count: int) -> np.ndarray:
    flat = ids.ravel()
    return _chain(flat, np.arange(1, len(ids) + 1) * ids.shape[1] - 1, count)


def shifts(table: PatternTable, ids: np.ndarray, last: np.ndarray) -> np.ndarray:
    """How far a window that ends with the word ``last`` may move on; 0 where it may be one of the patterns.

    No window reaches over a word that the benchmark lacks.
    """
    block = min(BLOCK_WORDS, table.length)
    skip = table.shift[(_chain(ids, last, block) >> np.uint64(64 - table.bits)).astype(np.int64)].astype(np.int64)
    for k in range(block - 1, -1, -1):
        skip = np.where(ids[last - k] == 0, table.length - k, skip)
    return skip


def occurrences(table: PatternTable, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pattern numbers and start words where the ids agree; ``first`` bounds the words of each row."""
    m, block = table.length, min(BLOCK_WORDS, table.length)
    stop = np.maximum(first[1:] - m + 1, first[:-1])
    runs = -(-(stop - first[:-1]) // RUN)
    row = np.repeat(np.arange(len(runs)), runs)
    at = first[:-1][row] + RUN * (np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs))
    limit = np.minimum(at + RUN, stop[row])
    found = []
    while len(at):
        skip = shifts(table, ids, at + m - 1)
        found.append(at[skip == 0])
        at = at + np.maximum(skip, 1)
        live = at < limit
        at, limit = at[live], limit[live]
    starts = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
    if not len(starts):
        return starts, starts
    suffix = _chain(ids, starts + m - 1, min(SUFFIX_WORDS, m))
    slot = np.minimum(np.searchsorted(table.suffixes, suffix), len(table.suffixes) - 1)
    hit = table.suffixes[slot] == suffix
    starts, slot = starts[hit], slot[hit]
    sizes = table.bounds[slot + 1] - table.bounds[slot]
    which = np.repeat(table.bounds[slot], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    starts = np.repeat(starts, sizes)
    for k in range(m):
        same = ids[starts + k] == table.ids[which, k]
        starts, which = starts[same], which[same]
    return which, starts


def scan(matcher: Matcher, column: pa.Array):
    """For each text: the number of words, a boolean array of the covered ones (or None), and the set of items found."""
    all_data, all_offsets = tb.column_bytes(column)
    for i, j in tb.pieces(all_offsets):
        data, offsets = tb.piece_of(all_data, all_offsets, i, j)
        data = tb.translate(data, tb.LOWER)
        begins, ends, first = tb.word_bounds(data, offsets, IS_GAP)
        ids = matcher.word_ids(tb.span_hashes(data, begins, ends)) if len(matcher.known) else None
        covered, items = {}, {}
        for table in matcher.tables if ids is not None and len(ids) else []:
            which, starts = occurrences(table, ids, first)
            rows = np.searchsorted(first, starts, side="right") - 1
            for p, s, row in zip(which.tolist(), starts.tolist(), rows.tolist(), strict=True):
                # Ids come from hashes; the bytes decide.
                if b" ".join(data[begins[k] : ends[k]].tobytes() for k in range(s, s + table.length)) == table.texts[p]:
                    if row not in covered:
                        covered[row], items[row] = np.zeros(first[row + 1] - first[row], dtype=bool), set()
                    covered[row][s - first[row] : s - first[row] + table.length] = True
                    items[row].update(table.items[p])
        for row in range(j - i):
            yield int(first[row + 1] - first[row]), covered.get(row), items.get(row, set())


def segments(benchmark: DataFrame, width: int, patterns: int) -> DataFrame:
    """(item, words, n): the items' words, joined by blanks, in overlapping runs of at most ``patterns`` windows each, with their number."""
    usable = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item"), "text")

    def cut(batches):
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                for i in range(0, max(len(words) - width + 1, 1) if words else 0, patterns):
                    run = words[i : i + patterns + width - 1]
                    rows.append({"item": item, "words": b" ".join(run).decode(), "n": max(len(run) - width + 1, 1)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("item", pa.string()), ("words", pa.string()), ("n", pa.int64())]))

    return usable.mapInArrow(cut, "item string, words string, n bigint")


def blocks(benchmark: DataFrame, width: int = WIDTH, patterns: int = PATTERNS) -> list[DataFrame]:
    """The benchmark's segments in tables of about ``patterns`` windows each, written once; one table at least."""
    spark = benchmark.sparkSession
    runtime.ship_package(spark)
    held = runtime.materialize(segments(benchmark, width, max(1, patterns // 8)), "segments")
    total = held.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(1, -(-int(total) // patterns))
    part = F.pmod(F.xxhash64("item", "words"), F.lit(parts))
    return [held.where(part == k) for k in range(parts)]


def matcher_of(block: DataFrame, width: int):
    """The search tables of one block, broadcast."""
    rows = block.select("item", "words").collect()
    return block.sparkSession.sparkContext.broadcast(build([(r["item"], r["words"].encode().split(b" ")) for r in rows], width))


_SCHEMA = "doc_id {key}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, patterns: int = PATTERNS) -> DataFrame:
    """One row for each document: its words, those inside any occurrence of a window, and the items found.

    Of each block of the benchmark but a single one the hits alone are written, under a hash of the document's id and text, so no text is written however many
    blocks there are; one matcher is alive at a time.
    """
    key = hf.whole_ids(docs).schema["doc_id"].dataType.simpleString()
    docs, found = docs.select("doc_id", "text"), blocks(benchmark, width, patterns)
    if len(found) == 1:
        return docs.mapInArrow(_judged(matcher_of(found[0], width)), _SCHEMA.format(key=key))
    hits = runtime.materialize(_united(_hits(docs, found, width)), "united", narrow=8)
    words = docs.mapInArrow(_words, f"doc_id {key}, key binary, n_words bigint")
    judged = words.join(runtime.if_small(hits, hits.count()), "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return judged.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"), F.coalesce("items_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def row_key(doc_id: int | None, text: str | None) -> bytes:
    """Names a row by its id and text; equal rows have equal hits."""
    return hashlib.blake2b(f"{doc_id}\n{text or ''}".encode(), digest_size=16).digest()


def _keys(batch: pa.RecordBatch) -> list[bytes]:
    return [row_key(i, t) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)]


def _hits(docs: DataFrame, found: list[DataFrame], width: int) -> list[DataFrame]:
    """For each block (key, hit, items) of the documents in which a window of it occurs."""

    def search(held):
        def run(batches):
            for batch in batches:
                rows = [(k, np.packbits(c).tobytes(), sorted(items)) for k, (_, c, items) in enumerate(scan(held.value, batch.column("text"))) if c is not None]
                # Few documents have hits, so few are hashed.
                keys = _keys(batch.take(pa.array([k for k, _, _ in rows], pa.int64())))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([x for _, x, _ in rows], pa.binary()), pa.array([x for _, _, x in rows], pa.list_(pa.string()))], names=["key", "hit", "items"])

        return run

    out = []
    for block in found:
        held = matcher_of(block, width)
        # Equal rows have the same hits, so one of them stands for all.
        out.append(runtime.materialize(docs.mapInArrow(search(held), "key binary, hit binary, items array<string>").dropDuplicates(["key"]), "hits", narrow=8))
        held.destroy()
    return out


def _united(hits: list[DataFrame]) -> DataFrame:
    """(key, n_hit, n_items, items_sha256): the hits of all blocks of a document together."""
    every = hits[0]
    for more in hits[1:]:
        every = every.union(more)
    # No more than one entry for each block.
    grouped = every.groupBy("key").agg(F.collect_list("hit").alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def count(batches):
        for batch in batches:
            covered = [int(np.bitwise_count(np.bitwise_or.reduce([np.frombuffer(x, dtype=np.uint8) for x in own])).sum()) for own in batch.column("hit").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(covered, pa.int64()), batch.column("items")], names=["key", "n_hit", "items"])

    counted = grouped.mapInArrow(count, "key binary, n_hit bigint, items array<string>")
    return counted.select("key", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))


def _words(batches):
    """The key of each row, and how many words it has."""
    for batch in batches:
        counts = [n for n, _, _ in scan(Matcher(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool), []), batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_keys(batch), pa.binary()), pa.array(counts, pa.int64())], names=["doc_id", "key", "n_words"])


def _judged(held):
    def run(batches):
        for batch in batches:
            out = [(words, covered, sorted(items)) for words, covered, items in scan(held.value, batch.column("text"))]
            hits = np.array([0 if c is None else int(c.sum()) for _, c, _ in out], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([w for w, _, _ in out], pa.int64()),
                    pa.array(hits),
                    pa.array([len(x) for _, _, x in out], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for _, _, x in out], pa.string()),
                    pa.array(hits > 0),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, patterns: int = PATTERNS) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, with all their columns."""
    found = blocks(benchmark, width, patterns)
    if len(found) == 1:
        held = matcher_of(found[0], width)

        def keep(batches):
            for batch in batches:
                yield batch.filter(pa.array([covered is None for _, covered, _ in scan(held.value, batch.column("text"))], pa.bool_()))
            tb.release()

        return docs.mapInArrow(keep, docs.schema)
    hits = _hits(docs.select("doc_id", "text"), found, width)
    gone = hits[0].select("key")
    for more in hits[1:]:
        gone = gone.union(more.select("key"))
    key = runtime.spare_name(docs, "text_key")
    gone = runtime.materialize(gone.distinct().withColumnRenamed("key", key), "gone", narrow=8)

    def named(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_keys(batch), pa.binary())], names=[*batch.schema.names, key])

    rows = docs.mapInArrow(named, T.StructType([*docs.schema.fields, T.StructField(key, T.BinaryType())]))
    # Where few documents go, the texts are not shuffled.
    return rows.join(runtime.if_small(gone, gone.count()), key, "left_anti").select(*docs.columns)


#: The same result in SQL: every window of every document against every window of every item.
SQL = r"""
WITH letters AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, letters),
b AS (SELECT item_id, regexp_extract_all(translate(text, u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, letters WHERE text IS NOT NULL AND item_id IS NOT NULL),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
x AS (SELECT row_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT row_id, w, n, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS i FROM d, sizes)),
h AS (SELECT row_id, x.n, i, item_id FROM x JOIN p ON x.n = p.n AND x.s = p.s),
c AS (SELECT row_id, count(DISTINCT pos) AS n_hit FROM (SELECT row_id, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT row_id, n, i FROM h)) GROUP BY row_id),
t AS (SELECT row_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT cast(item_id AS VARCHAR), ',' ORDER BY cast(item_id AS VARCHAR)) AS items FROM h GROUP BY row_id)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit, cast(coalesce(n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (row_id) LEFT JOIN t USING (row_id)
"""
