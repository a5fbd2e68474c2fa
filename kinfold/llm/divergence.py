"""Operator 11, source divergence audit: how far the terms of each source of a language lie from those of its other sources.

A term is a run of ASCII letters and characters beyond ASCII, with A-Z lower-cased. A language keeps the terms of at least
``LEAST_DOCS`` of its documents. A group (language, source) gives a kept term the share p = 1 + floor(10^9 (count + 1) / (N + V)); the divergence
of p from q is floor((p - q)^2 / q), in whole numbers. The ``pair`` part sums it over all kept terms for each two sources of a
language, in both directions; the ``term`` part names the terms of a group that its language as a whole uses less.

Tasks count whole texts and send each term once, with its counts by source packed together; sorted by term, these stream through a
reducer that keeps one posting list per term, at most one entry for each source. Nothing else of the corpus is shuffled: what follows works on
posting lists. Sums over pairs of sources are split into tiles, two blocks of up to ``TILE_SOURCES`` sources and a part of the terms. In a tile

* a heavy term, in over a quarter of the language's sources, is a row of a dense matrix of shares, and all pairs are summed over its columns;
* a light term adds what its postings change against a term that neither source has: for each posting alone, by its share and every other source
  (equal shares are counted once), and for each pair of postings a correction. These lists are short, so the pairs are few.

The share of terms that occur in neither source is added once for each two sources. All sums are exact.

Groups, blocks and parts are dealt by hash, so a source with a third of all rows is one entry of each list like any other. A tile holds
its groups, one matrix of ``TILE_TERMS`` rows, and the term candidates of ``TOP`` ranks.

Defined results: null text, language and source read as empty text. A group without terms, or a language that keeps none, has pairs of value 0 and no terms. Repeated rows
count as documents. Languages with one source have no pairs. An empty table gives no rows. Other columns are not read, and ids are not used.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold import runtime
from kinfold.llm import textblocks as tb

#: Fixed values of the contract.
LEAST_DOCS, SCALE, TOP = 3, 10**9, 200
#: Sources of a block and terms of a dense matrix; terms that a tile is dealt, at least.
TILE_SOURCES, TILE_TERMS, PART_TERMS = 256, 2048, 8192
#: Counts that a task holds before it sends them.
HELD_COUNTS = 500_000
#: Bytes of a text that are taken apart at once.
CHUNK = 1 << 20
#: Pairs of postings that are worked on at once.
PAIRS_AT_ONCE = 1 << 21

#: A-Z to a-z, and blanks for all that no term has.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ENTRY = np.dtype([("source", "<i8"), ("n", "<i8")])


def term_chunks(text: bytes):
    """The terms of a text, about ``CHUNK`` bytes at a time."""
    flat, at = text.translate(_TERMS), 0
    while at < len(flat):
        end = at + CHUNK
        if end < len(flat):
            end = flat.find(b" ", end)
            end = len(flat) if end < 0 else end
        yield flat[at:end].split()
        at = end


def _packed(entries: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Entries end to end as one binary value for each run of ``sizes``."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * _ENTRY.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(entries.tobytes())]).cast(pa.binary())


def _entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a column of packed lists, and the length of each list."""
    data, offsets = tb.column_bytes(column)
    return np.frombuffer(data.tobytes(), dtype=_ENTRY), np.diff(offsets) // _ENTRY.itemsize


def _counted(batches):
    """Reads lang, source (a number) and text; sends each term of a language with its documents and its counts by source."""
    counts: dict[tuple[str, int], Counter] = {}
    docs: dict[str, Counter] = {}

    def rows():
        for lang, found in docs.items():
            place = {t: i for i, t in enumerate(found)}
            flat = []
            for (of, source), own in counts.items():
                if of == lang and own:
                    part = np.empty(len(own), dtype=[("term", "<i8"), *_ENTRY.descr])
                    part["term"], part["source"], part["n"] = np.fromiter(map(place.__getitem__, own), np.int64, len(own)), source, np.fromiter(own.values(), np.int64, len(own))
                    flat.append(part)
            flat = np.concatenate(flat)
            flat = flat[np.lexsort((flat["source"], flat["term"]))]
            sizes = np.bincount(flat["term"], minlength=len(place))
            entries = np.empty(len(flat), dtype=_ENTRY)
            entries["source"], entries["n"] = flat["source"], flat["n"]
            terms, n_docs, ends = list(found), np.fromiter(found.values(), np.int64, len(found)), np.concatenate([[0], np.cumsum(sizes)])
            for i in range(0, len(terms), 20_000):
                j = min(i + 20_000, len(terms))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * (j - i), pa.string()), pa.array(terms[i:j], pa.binary()), pa.array(n_docs[i:j]), _packed(entries[ends[i] : ends[j]], sizes[i:j])], names=["lang", "term", "docs", "posts"]
                )

    held = 0
    for batch in batches:
        data, offsets = tb.column_bytes(batch.column("text"))
        own = data.tobytes()
        for lang, source, i, j in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            tally, seen = counts.setdefault((lang, source), Counter()), set()
            before = len(tally)
            for terms in term_chunks(own[i:j]):
                tally.update(terms)
                seen.update(terms)
            if seen:
                docs.setdefault(lang, Counter()).update(seen)
            held += len(tally) - before
            if held > HELD_COUNTS:
                yield from rows()
                counts, docs, held = {}, {}, 0
    yield from rows()
    counts.clear()
    docs.clear()
    tb.release()


def _summed(terms: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of the same term and source added up, in the order of both."""
    order = np.lexsort((entries["source"], terms))
    terms, entries = terms[order], entries[order]
    first = np.flatnonzero(np.concatenate([[True], (terms[1:] != terms[:-1]) | (entries["source"][1:] != entries["source"][:-1])])) if len(terms) else np.zeros(0, dtype=np.int64)
    out = entries[first].copy()
    out["n"] = np.add.reduceat(entries["n"], first) if len(first) else 0
    return terms[first], out


def _merged(least: int):
    """Reads the rows of ``_counted`` sorted by language and term; one row for each kept term."""

    def send(langs, terms, docs, number, entries):
        sizes = np.bincount(number, minlength=len(terms))
        totals = np.zeros(len(terms), dtype=np.int64)
        np.add.at(totals, number, entries["n"])
        kept = np.flatnonzero(docs >= least)
        chosen = entries[(docs >= least)[number]]
        return pa.RecordBatch.from_arrays(
            [langs.take(pa.array(kept)), terms.take(pa.array(kept)), pa.array(totals[kept]), pa.array(sizes[kept]), _packed(chosen, sizes[kept])], names=["lang", "term", "total", "k", "posts"]
        )

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            if held is not None:
                part = pa.concat_tables([held, part])
            part = part.combine_chunks()
            langs, terms = part.column("lang").chunk(0), part.column("term").chunk(0)
            n = len(langs)
            new = np.ones(n, dtype=bool)
            if n > 1:
                new[1:] = np.asarray(pa.compute.or_(pa.compute.not_equal(langs[1:], langs[:-1]), pa.compute.not_equal(terms[1:], terms[:-1])))
            first = np.flatnonzero(new)
            docs = np.add.reduceat(np.asarray(part.column("docs").chunk(0)), first)
            entries, sizes = _entries(part.column("posts").chunk(0))
            number, entries = _summed(np.repeat(np.cumsum(new) - 1, sizes), entries)
            # The last term may go on in the next batch; what is held of it has one entry for each source.
            last, at = len(first) - 1, pa.array(first)
            done = number < last
            if last:
                yield send(langs.take(at[:-1]), terms.take(at[:-1]), docs[:-1], number[done], entries[done])
            own = entries[~done]
            held = pa.table([langs.take(at[-1:]), terms.take(at[-1:]), pa.array(docs[-1:]), _packed(own, np.array([len(own)]))], names=["lang", "term", "docs", "posts"])
        if held is not None:
            own, _ = _entries(held.column("posts").chunk(0))
            yield send(held.column("lang").chunk(0), held.column("term").chunk(0), np.asarray(held.column("docs").chunk(0)), np.zeros(len(own), dtype=np.int64), own)

    return run


def _source_sums(batches):
    """The counts of kept terms by language and source."""
    for batch in batches:
        entries, sizes = _entries(batch.column("posts"))
        langs = batch.column("lang").dictionary_encode()
        which, own = _summed(np.repeat(np.asarray(langs.indices), sizes), entries)
        yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(which)), pa.array(own["source"]), pa.array(own["n"])], names=["lang", "source", "n"])


def shares(n: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """p for counts ``n`` where N + V is ``total``; exact also where the product has more than 64 bits."""
    if len(n) and int(np.max(n)) >= 9 * 10**9:
        return (1 + SCALE * (n.astype(object) + 1) // np.asarray(total).astype(object)).astype(np.int64)
    return 1 + SCALE * (n + 1) // total


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class _Tile:
    """Sums over the terms of one tile. Sources are sorted by number; ``left`` and ``right`` are the places of its two blocks, equal ones in a tile on the diagonal."""

    def __init__(self, sources: np.ndarray, sums: np.ndarray, blocks: np.ndarray, a: int, b: int, kept: int, whole: int, many: int) -> None:
        order = np.argsort(sources)
        self.sources, self.blocks, self.diagonal = sources[order], blocks[order], a == b
        self.sizes = sums[order] + kept
        self.kept, self.whole, self.many = kept, whole + kept, many
        # Without kept terms nothing is divided by.
        self.none = shares(np.zeros(len(sources), dtype=np.int64), np.maximum(self.sizes, 1))
        self.left, self.right = np.flatnonzero(self.blocks == a), np.flatnonzero(self.blocks == b)
        self.out = np.zeros((len(sources), len(sources)), dtype=np.int64)
        self.single: list[np.ndarray] = []
        self.base = apart(self.none[:, None], self.none[None, :])

    def wanted(self) -> np.ndarray:
        """Which ordered pairs this tile is to answer for."""
        x, y = np.zeros(len(self.sources), dtype=bool), np.zeros(len(self.sources), dtype=bool)
        x[self.left], y[self.right] = True, True
        return ((x[:, None] & y[None, :]) | (y[:, None] & x[None, :])) & ~np.eye(len(self.sources), dtype=bool)

    def add(self, lists: np.ndarray, entries: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Adds terms, given by entries with the number of the list each is from; ``k``: sources that each list's term has in all. Returns the entries' shares."""
        at = np.searchsorted(self.sources, entries["source"])
        p = shares(entries["n"], self.sizes[at])
        heavy = 4 * k > self.many
        self._dense(lists[heavy[lists]], at[heavy[lists]], p[heavy[lists]])
        light = ~heavy[lists]
        self._sparse(lists[light], at[light], p[light])
        return p

    def _dense(self, lists: np.ndarray, at: np.ndarray, p: np.ndarray) -> None:
        names, row = np.unique(lists, return_inverse=True)
        for i in range(0, len(names), TILE_TERMS):
            inside = (row >= i) & (row < i + TILE_TERMS)
            tile = np.repeat(self.none[None, :], min(TILE_TERMS, len(names) - i), axis=0)
            tile[row[inside] - i, at[inside]] = p[inside]
            columns = np.ascontiguousarray(tile.T)
            for g in self.left:
                self.out[g, self.right] += apart(columns[g], columns[self.right]).sum(axis=1)
            if not self.diagonal:
                for g in self.right:
                    self.out[g, self.left] += apart(columns[g], columns[self.left]).sum(axis=1)
            self.out -= self.base * len(tile)

    def _sparse(self, lists: np.ndarray, at: np.ndarray, p: np.ndarray) -> None:
        if not len(lists):
            return
        self.single.append(np.stack([at, p]))
        if sum(x.shape[1] for x in self.single) > PAIRS_AT_ONCE:
            self._fold()
        first = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]]))
        sizes = np.diff(np.append(first, len(lists)))
        many, start = np.repeat(sizes, sizes), np.repeat(first, sizes)
        ends = np.cumsum(many)
        i = 0
        while i < len(lists):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS_AT_ONCE, side="right")))
            x = np.repeat(np.arange(i, j), many[i:j])
            y = np.arange(len(x)) - np.repeat(np.cumsum(many[i:j]) - many[i:j], many[i:j]) + np.repeat(start[i:j], many[i:j])
            apart_ones = (x != y) if self.diagonal else (self.blocks[at[x]] != self.blocks[at[y]])
            x, y = x[apart_ones], y[apart_ones]
            u, v = at[x], at[y]
            value = apart(p[x], p[y]) - apart(p[x], self.none[v]) - apart(self.none[u], p[y]) + self.base[u, v]
            np.add.at(self.out, (u, v), value)
            i = j

    def _fold(self) -> None:
        """What single postings change against every source that lacks the term; equal shares of a source are worked on once."""
        if not self.single:
            return
        at, p = np.concatenate(self.single, axis=1)
        order = np.lexsort((p, at))
        at, p = at[order], p[order]
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (p[1:] != p[:-1])]))
        times = np.diff(np.append(first, len(at)))
        at, p = at[first], p[first]
        for i in range(0, len(at), 4096):
            g, q, w = at[i : i + 4096], p[i : i + 4096, None], times[i : i + 4096, None]
            np.add.at(self.out, g, w * (apart(q, self.none[None, :]) - self.base[g]))
            np.add.at(self.out.T, g, w * (apart(self.none[None, :], q) - self.base[:, g].T))
        self.single = []

    def pairs(self, first_part: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Source, other source and sum; the share of terms that neither has is added in one part of the terms."""
        self._fold()
        if first_part:
            self.out += self.base * self.kept
        u, v = np.nonzero(self.wanted())
        return self.sources[u], self.sources[v], self.out[u, v]


def _best(at: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which entries are among the ``TOP`` largest values of their source, ties of the last one included."""
    order = np.lexsort((-value, at))
    first = np.flatnonzero(np.concatenate([[True], at[order][1:] != at[order][:-1]])) if len(at) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(first, len(at)))
    least = value[order][first + np.minimum(sizes, TOP) - 1]
    out = np.zeros(len(at), dtype=bool)
    out[order] = value[order] >= np.repeat(least, sizes)
    return out


_PARTIAL = "lang string, source bigint, other bigint, term binary, value bigint"


def _audited(batches):
    """Reads tiles sorted by language, blocks and part, groups before terms; returns sums of pairs (other given) and the largest values of terms (term given)."""

    def closed(key, tile, found):
        lang, _, _, part = key
        u, v, sums = tile.pairs(part == 0)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u), pa.array(v), pa.nulls(len(u), pa.binary()), pa.array(sums)], names=["lang", "source", "other", "term", "value"])
        if found:
            at, value, terms = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]), pa.concat_arrays([x[2] for x in found])
            best = np.flatnonzero(_best(at, value))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(best), pa.string()), pa.array(tile.sources[at[best]]), pa.nulls(len(best), pa.int64()), terms.take(pa.array(best)), pa.array(value[best])], names=["lang", "source", "other", "term", "value"])

    key = tile = None
    groups: list[pa.RecordBatch] = []
    found: list = []
    for batch in batches:
        n = batch.num_rows
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("lang", "a", "b", "part", "kind")), strict=True))
        i = 0
        while i < n:
            j = i + 1
            while j < n and keys[j] == keys[i]:
                j += 1
            part, own, kind = batch.slice(i, j - i), keys[i][:4], keys[i][4]
            if own != key:
                if key is not None:
                    yield from closed(key, tile or _tile_of(key, groups), found)
                key, tile, groups, found = own, None, [], []
            if kind == 0:
                groups.append(part)
            else:
                tile = tile or _tile_of(key, groups)
                entries, sizes = _entries(part.column("posts"))
                lists = np.repeat(np.arange(len(sizes)), sizes)
                p = tile.add(lists, entries, np.asarray(part.column("k")))
                if tile.diagonal:
                    q = shares(np.asarray(part.column("total")), tile.whole)[lists]
                    at = np.searchsorted(tile.sources, entries["source"])
                    more = np.flatnonzero(p > q)
                    value = apart(p[more], q[more])
                    best = _best(at[more], value)
                    found.append((at[more][best], value[best], part.column("term").take(pa.array(lists[more][best]))))
                    if len(found) > 16:
                        at, value, terms = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]), pa.concat_arrays([x[2] for x in found])
                        best = _best(at, value)
                        found = [(at[best], value[best], terms.filter(pa.array(best)))]
            i = j
    if key is not None:
        yield from closed(key, tile or _tile_of(key, groups), found)
    tb.release()


def _tile_of(key: tuple, groups: list[pa.RecordBatch]) -> _Tile:
    rows = pa.Table.from_batches(groups).to_pydict()
    return _Tile(*(np.array(rows[c], dtype=np.int64) for c in ("source", "n", "block")), key[1], key[2], rows["kept"][0], rows["total"][0], rows["many"][0])


def _dealt(batches):
    """Each posting list to the tiles of its part: restricted to their sources where there are several blocks."""
    for batch in batches:
        blocks = np.asarray(batch.column("blocks"))
        alone = np.flatnonzero(blocks == 1)
        names = ["lang", "a", "b", "part", "kind", "term", "total", "k", "posts"]
        if len(alone):
            own = batch.take(pa.array(alone))
            zero = pa.array(np.zeros(len(alone), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([own.column("lang"), zero, zero, own.column("part"), pa.array(np.ones(len(alone), dtype=np.int32)), own.column("term"), own.column("total"), own.column("k"), own.column("posts")], names=names)
        for row in np.flatnonzero(blocks > 1).tolist():
            one = batch.slice(row, 1)
            entries, _ = _entries(one.column("posts"))
            block = entries["source"] % blocks[row]
            pairs, lists = [], []
            there = np.unique(block).tolist()
            for a in there:
                for b in range(int(blocks[row])):
                    # A pair of blocks that both have the term is dealt once.
                    if b in there and b < a:
                        continue
                    pairs.append((min(a, b), max(a, b)))
                    lists.append(entries[(block == a) | (block == b)])
            m = len(pairs)
            same = lambda c, one=one, m=m: pa.concat_arrays([one.column(c)] * m)
            yield pa.RecordBatch.from_arrays(
                [same("lang"), pa.array([x for x, _ in pairs], pa.int64()), pa.array([x for _, x in pairs], pa.int64()), same("part"), pa.array([1] * m, pa.int32()), same("term"), same("total"), same("k"), _packed(np.concatenate(lists), np.array([len(x) for x in lists]))],
                names=names,
            )


def source_number(sources: DataFrame) -> Column:
    """A number for each source of the column ``source``, a hash of its name, with a seed for which no two of ``sources`` are alike."""
    distinct = sources.select("source").distinct()
    for seed in range(16):
        number = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "source"), 1)
        row = distinct.agg(F.count("*").alias("n"), F.countDistinct(number).alias("m")).first()
        if row["n"] == row["m"]:
            return number
    raise ValueError("no seed tells all sources apart")


def audit(docs: DataFrame, least: int = LEAST_DOCS, tile_sources: int = TILE_SOURCES) -> DataFrame:
    """lang, source, part, item, value and rank."""
    spark = docs.sparkSession
    runtime.ship_package(spark)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").alias("text"))
    seen = runtime.materialize(rows.groupBy("lang", "source").agg(F.count("*").alias("rows")), "groups", narrow=8)
    # The number depends on the name alone, so no table is joined to the texts.
    number = source_number(seen)
    named = runtime.materialize(seen.select("lang", F.col("source").alias("name"), number.alias("source")), "named", narrow=8)
    counted = rows.select("lang", number.alias("source"), "text").mapInArrow(_counted, "lang string, term binary, docs bigint, posts binary")
    merged = counted.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_merged(least), "lang string, term binary, total bigint, k bigint, posts binary")
    kept = runtime.materialize(merged, "postings")

    sums = kept.select("lang", "posts").mapInArrow(_source_sums, "lang string, source bigint, n bigint").groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("total"))
    langs = named.groupBy("lang").agg(F.count("*").alias("many")).join(langs, "lang", "left").fillna(0, ["kept", "total"])
    blocks = F.ceil(F.col("many") / tile_sources).cast("bigint")
    # With more sources a part has more terms, so that sums of pairs stay below the postings they come from.
    part_terms = F.greatest(F.lit(PART_TERMS), F.least("many", F.lit(tile_sources)) * F.least("many", F.lit(tile_sources)))
    langs = runtime.materialize(langs.withColumns({"blocks": blocks, "parts": F.greatest(F.ceil(F.col("kept") / part_terms), F.lit(1)).cast("bigint")}), "langs", narrow=0)
    n_langs = langs.count()

    placed = named.join(sums, ["lang", "source"], "left").fillna(0, ["n"]).join(runtime.if_small(langs, n_langs), "lang")
    block, other = F.pmod("source", "blocks"), F.col("other")
    tiles = placed.select("lang", "source", "n", "kept", "total", "many", "parts", block.alias("block"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
    tiles = tiles.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    tiles = tiles.select("lang", F.least("block", other).alias("a"), F.greatest("block", other).alias("b"), "part", F.lit(0).alias("kind"), null("binary", "term"), "total", null("bigint", "k"), null("binary", "posts"), "source", "n", "block", "kept", "many")

    lists = kept.join(runtime.if_small(langs.select("lang", "blocks", "parts"), n_langs), "lang").select("*", F.pmod(F.xxhash64("term"), "parts").alias("part"))
    lists = lists.select("lang", "term", "total", "k", "posts", "blocks", "part").mapInArrow(_dealt, "lang string, a bigint, b bigint, part bigint, kind int, term binary, total bigint, k bigint, posts binary")
    blank = [null("bigint", c) for c in ("source", "n", "block", "kept", "many")]
    keys = ["lang", "a", "b", "part"]
    dealt = tiles.union(lists.select(*tiles.columns[:9], *blank)).repartition(*keys).sortWithinPartitions(*keys, "kind")
    found = runtime.materialize(dealt.mapInArrow(_audited, _PARTIAL), "audit")

    few = named.count()
    mine = runtime.if_small(named.select("lang", "source", "name"), few)
    theirs = runtime.if_small(named.select("lang", F.col("source").alias("other"), F.col("name").alias("item")), few)
    pairs = found.where(F.col("term").isNull()).groupBy("lang", "source", "other").agg(F.sum("value").alias("value")).join(theirs, ["lang", "other"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    terms = found.where(F.col("term").isNotNull()).select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item")))
    ranked = pairs.withColumn("rank", rank).union(terms.withColumn("rank", rank).where(F.col("rank") <= TOP))
    return ranked.join(mine, ["lang", "source"]).select("lang", F.col("name").alias("source"), "part", "item", "value", "rank")


#: The same result in SQL.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v, sum(total) AS total FROM kept GROUP BY lang),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(s.n, 0) + v.v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (k.total + 1)) // (v.total + v.v)::HUGEINT AS q
 FROM g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, cast(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
 LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, cast(((p - q) * (p - q)) // q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, cast(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""
