"""Operator 12, Merkle dataset manifest: a tree of hashes over the rows of each source, and one over the sources.

A leaf is the SHA-256 of its row's columns, each as ``-`` for null or as its UTF-8 byte count, a colon and its value. The leaves of a
source ascend by id; every three consecutive nodes of a level (the last ones may be fewer, even one) become their hash until one
is left, the subroot. The subroots, in the order of the sources with null first, become the root in the same way. Digests are hashed as hex text.

The nodes lie in an external store, Parquet partitioned by level. Leaves are put in order by ranges and numbered; a task then takes runs of
``3**STOREY`` consecutive leaves, streams through them in order and writes the ``STOREY`` levels above, each from the
one below. The nodes on top of these runs are the leaves of the next storey: no task ever holds a level, and each storey is 729
times smaller than the one below. A proof lists, from the leaf up, the other nodes of each run. Proofs are read off the store by
coordinate, from the top storey down: the rows of a run, the nodes stored above them and the proof of the run's top come sorted into
one task and are merged. Rows move once for numbering and once for each of these two steps, as digests, never as texts.

Defined results: null columns count as ``-``; rows of one id are ordered by their leaves, and a null id comes first; equal rows
have equal leaves and proofs of their own places. A lone leaf is its source's subroot, and a lone source's subroot is the root; the proof of
a lone leaf is the hash of nothing. An empty table has no rows and no root. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold import runtime
from kinfold.llm import hashed_features as hf
from kinfold.operators.ranking import ranked, running_sums

FAN_OUT = 3
#: Levels that one task builds above a run of leaves, and the leaves of such a run.
STOREY = 6
RUN = FAN_OUT**STOREY
#: The number of the tree over the subroots; the trees of sources are numbered from 0.
TOP = -1
#: The columns of a leaf, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: More levels than any table has.
MOST_LEVELS = 38

#: A node of the store: its tree, its place in its level, the nodes of the tree on this level, its digest.
NODE = "tree bigint, idx bigint, n bigint, digest binary"


def field(column: Column) -> Column:
    text = column.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*columns: Column) -> Column:
    """The 32 bytes of a leaf's digest."""
    return F.unhex(F.sha2(F.concat(*(field(c) for c in columns)), 256))


def parent(children: list[bytes]) -> bytes:
    return sha256(b"".join(c.hex().encode() for c in children)).digest()


def height(n: Column) -> Column:
    """Levels above the leaves of a tree with ``n`` of them."""
    out = F.lit(0)
    for k in range(MOST_LEVELS):
        out = out + (n > F.lit(FAN_OUT**k)).cast("int")
    return out


def numbered(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``leaves`` (source, doc_id, digest and others) with tree, idx and n; and the trees: source, tree, n."""
    counts = runtime.materialize(leaves.groupBy("source").agg(F.count("*").alias("n")), "sources", narrow=8)
    trees = running_sums(counts, F.col("source").asc_nulls_first(), tree=F.lit(1).cast("bigint"), first=F.col("n"))
    trees = runtime.materialize(trees.select(F.col("source").alias("of"), F.col("tree").cast("bigint").alias("tree"), F.col("first").cast("bigint").alias("first"), "n"), "trees", narrow=8)
    # Rows are numbered, so those of one id and digest can lie in several ranges.
    held = runtime.materialize(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    placed = ranked(held, F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("row"))
    joined = placed.join(runtime.if_small(trees, trees.count()), F.col("source").eqNullSafe(F.col("of")))
    return joined.withColumn("idx", F.col("place") - F.col("first")).drop("of", "first", "place", "row"), trees.select(F.col("of").alias("source"), "tree", "n")


def _groups(batches, *names: str) -> Iterator[dict[str, list]]:
    """The rows that agree in ``names``, from rows sorted by them, as one dict of lists each; a group may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [np.asarray(batch.column(batch.schema.get_field_index(n))) for n in names]
        cuts = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(i, j - i)
            if held and any(held[0].column(held[0].schema.get_field_index(n))[0] != part.column(part.schema.get_field_index(n))[0] for n in names):
                yield pa.Table.from_batches(held).to_pydict()
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held).to_pydict()


def _raise_storey(base: int):
    """From the nodes of level ``base`` those of the next ``STOREY`` levels."""

    def run(batches):
        for rows in _groups(batches, "tree", "run"):
            below, n, at = rows["digest"], rows["n"][0], rows["idx"][0]
            level = base
            while n > 1 and level < base + STOREY:
                below = [parent(below[i : i + FAN_OUT]) for i in range(0, len(below), FAN_OUT)]
                n, at, level = -(-n // FAN_OUT), at // FAN_OUT, level + 1
                k = len(below)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rows["tree"][0]] * k, pa.int64()), pa.array(range(at, at + k), pa.int64()), pa.array([n] * k, pa.int64()), pa.array(below, pa.binary()), pa.array([level] * k, pa.int32())],
                    names=["tree", "idx", "n", "digest", "level"],
                )

    return run


def build(leaves: DataFrame, path: str) -> int:
    """Writes the trees over ``leaves`` (tree, idx, n, digest) into the store at ``path``; returns how many storeys they have."""
    spark = leaves.sparkSession
    runtime.ship_package(spark)
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
    most = leaves.agg(F.max("n")).first()[0] or 0
    storeys, base = 0, leaves.select("tree", "idx", "n", "digest")
    while most > 1:
        level = storeys * STOREY
        dealt = base.where("n > 1").withColumn("run", F.floor(F.col("idx") / RUN)).repartition("tree", "run").sortWithinPartitions("tree", "run", "idx")
        dealt.mapInArrow(_raise_storey(level), f"{NODE}, level int").coalesce(files).write.partitionBy("level").mode("append").parquet(path)
        storeys, most = storeys + 1, -(-most // RUN)
        base = stored(spark, path).where(F.col("level") == level + STOREY).drop("level")
    return storeys


def stored(spark, path: str) -> DataFrame:
    return spark.read.schema(f"{NODE}, level int").parquet(path)


def siblings(levels: list[list[bytes]], at: int, above: bytes) -> bytes:
    """The path of the node at place ``at`` of ``levels[0]``: for each level the number of nodes before it in its run, that of all others, and these; then what lies above."""
    out = bytearray()
    for nodes in levels:
        first = at // FAN_OUT * FAN_OUT
        others = nodes[first : first + FAN_OUT]
        own = others.pop(at - first)
        assert own is not None
        out += bytes((at - first, len(others))) + b"".join(others)
        at //= FAN_OUT
    return bytes(out) + above


def steps(path: bytes) -> Iterator[tuple[int, str]]:
    """Of each level of a path, how many nodes stand before, and the others as hex text."""
    at = 0
    while at < len(path):
        end = at + 2 + 32 * path[at + 1]
        yield path[at], path[at + 2 : end].hex()
        at = end


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf and the nodes of its path lead to."""
    for before, others in steps(path):
        digest = sha256((others[: 64 * before] + digest.hex() + others[64 * before :]).encode()).digest()
    return digest


def proof_digest(path: bytes) -> bytes:
    return sha256("".join(others for _, others in steps(path)).encode()).digest()


#: What comes into a run: its leaves (or nodes of the storey's base), the nodes above them, and one row with the path of its top.
_MERGED = "tree, run, level, idx, digest, n, above"


def _levels_of(rows: dict[str, list], base: int) -> tuple[list[list[bytes]], bytes, int]:
    """The levels of a run from its base on, as far as they have runs of their own; the path above; and where the base's rows begin."""
    levels: dict[int, list[bytes]] = {}
    first, above, n = None, b"", 1
    for k, (level, digest) in enumerate(zip(rows["level"], rows["digest"], strict=True)):
        if level == MOST_LEVELS:
            above = rows["above"][k]
            continue
        if level == base and first is None:
            first, n = k, rows["n"][k]
        levels.setdefault(level, []).append(digest)
    found = []
    for level in range(base, base + STOREY):
        if n == 1:
            break
        found.append(levels[level])
        n = -(-n // FAN_OUT)
    return found, above, first


def _paths(base: int):
    """The path of each node of the base."""

    def run(batches):
        for rows in _groups(batches, "tree", "run"):
            levels, above, first = _levels_of(rows, base)
            if first is None:
                continue
            idx = rows["idx"][first:]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["tree"][first:], pa.int64()), pa.array(idx, pa.int64()), pa.array([siblings(levels, i % RUN, above) for i in idx], pa.binary())], names=["tree", "idx", "above"]
            )

    return run


def _merged(base_rows: DataFrame, base: int, nodes: DataFrame, above: DataFrame, *more: str) -> DataFrame:
    """The base's rows, the stored nodes up to the next storey and the paths of the tops, sorted by run, path and upper levels first."""
    extra = [(c, base_rows.schema[c].dataType) for c in more]
    blank = [F.lit(None).cast(t).alias(c) for c, t in extra]
    own = base_rows.select("tree", F.floor(F.col("idx") / RUN).alias("run"), F.lit(base).alias("level"), "idx", "digest", "n", F.lit(None).cast("binary").alias("above"), *more)
    level = F.col("level") - base
    span = F.lit(RUN)
    for k in range(1, STOREY):
        span = F.when(level == k, F.lit(FAN_OUT ** (STOREY - k))).otherwise(span)
    inner = nodes.where((level > 0) & (level < STOREY)).select("tree", F.floor(F.col("idx") / span).alias("run"), "level", "idx", "digest", "n", F.lit(None).cast("binary").alias("above"), *blank)
    tops = above.select("tree", F.col("idx").alias("run"), F.lit(MOST_LEVELS).alias("level"), "idx", F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("bigint").alias("n"), "above", *blank)
    rows = own.union(inner).union(tops)
    return rows.repartition("tree", "run").sortWithinPartitions("tree", "run", F.col("level").desc(), "idx")


def tops(leaves: DataFrame, path: str, storeys: int, roots: DataFrame) -> DataFrame:
    """(tree, idx, above): the path that lies above each run of the lowest storey. roots: (tree, n, above), the path above each tree's own root."""
    nodes = stored(leaves.sparkSession, path)
    last = F.greatest(F.floor((height(F.col("n")) - 1) / STOREY), F.lit(0))
    entry = roots.select("tree", "above", last.alias("storey"))
    found = None
    for storey in range(max(storeys, 1) - 1, -1, -1):
        own = entry.where(F.col("storey") == storey).select("tree", F.lit(0).cast("bigint").alias("idx"), "above")
        found = own if found is None else own.union(found)
        if storey:
            base = storey * STOREY
            rows = nodes.where(F.col("level") == base).drop("level")
            # A tree of one node on this level has its root there, and the run below already has its path.
            found = runtime.materialize(_merged(rows.where("n > 1"), base, nodes, found).mapInArrow(_paths(base), "tree bigint, idx bigint, above binary"), "paths", narrow=8)
    return found


def subroots(leaves: DataFrame, path: str, storeys: int) -> DataFrame:
    """(tree, digest): the topmost node of each tree."""
    alone = leaves.where("n = 1").select("tree", "digest")
    return alone.union(stored(leaves.sparkSession, path).where("n = 1").select("tree", "digest")) if storeys else alone


def _judged(root: bytes):
    """For each leaf its proof's hash, and the root that its other digest leads to."""

    def run(batches):
        for rows in _groups(batches, "tree", "run"):
            levels, above, first = _levels_of(rows, 0)
            if first is None:
                continue
            proofs, folded = [], []
            for i, own, other in zip(rows["idx"][first:], rows["digest"][first:], rows["altered"][first:], strict=True):
                path = siblings(levels, i % RUN, above)
                proofs.append(proof_digest(path).hex())
                folded.append(fold(own if other is None else other, path))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows["doc_id"][first:], pa.int64()),
                    pa.array(rows["tree"][first:], pa.int64()),
                    pa.array([x.hex() for x in rows["digest"][first:]], pa.string()),
                    pa.array(proofs, pa.string()),
                    pa.array([x.hex() for x in folded], pa.string()),
                    pa.array([x == root for x in folded], pa.bool_()),
                ],
                names=["doc_id", "tree", "leaf", "proof_sha256", "folded_root", "verified"],
            )

    return run


def manifest(leaves: DataFrame, path: str) -> tuple[DataFrame, DataFrame, bytes | None]:
    """Builds the store at ``path``. Returns the numbered leaves, the trees (source, tree, n, subroot, above: the path above their subroot), and the root."""
    spark = leaves.sparkSession
    placed, trees = numbered(leaves)
    placed = runtime.materialize(placed, "placed")
    sources = trees.count()
    if not sources:
        return placed, trees.select("source", "tree", "n", F.lit(None).cast("binary").alias("subroot"), F.lit(None).cast("binary").alias("above")), None
    storeys = build(placed, f"{path}/sources")
    roots = runtime.materialize(trees.join(runtime.if_small(subroots(placed, f"{path}/sources", storeys).withColumnRenamed("digest", "subroot"), sources), "tree"), "subroots", narrow=8)
    upper = roots.select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("idx"), F.lit(sources).cast("bigint").alias("n"), F.col("subroot").alias("digest"))
    high = build(upper, f"{path}/root")
    root = bytes(subroots(upper, f"{path}/root", high).first()["digest"])
    if not high:
        return placed, roots.withColumn("above", F.lit(b"")), root
    start = spark.createDataFrame([(TOP, sources, b"")], "tree bigint, n bigint, above binary")
    paths = _merged(upper, 0, stored(spark, f"{path}/root"), tops(upper, f"{path}/root", high, start)).mapInArrow(_paths(0), "tree bigint, idx bigint, above binary")
    paths = paths.select(F.col("idx").alias("tree"), "above")
    return placed, runtime.materialize(roots.join(runtime.if_small(paths, sources), "tree"), "manifest", narrow=8), root


def proofs(docs: DataFrame, altered: Column | None = None, path: str | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for each row of ``docs``.

    altered: the text that a row is checked with in place of its own, null for its own; a null text can't be altered. The store is left at ``path``.
    """
    spark = docs.sparkSession
    runtime.ship_package(spark)
    docs = hf.whole_ids(docs)
    own = [F.col(c) for c in COLUMNS]
    other = F.lit(None).cast("string") if altered is None else altered
    changed = F.when(other.isNotNull() & F.col("text").isNotNull() & (other != F.col("text")), leaf(*own[:-1], other))
    leaves = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", leaf(*own).alias("digest"), changed.alias("altered"))
    path = path or runtime.scratch_path(spark, "merkle")
    placed, trees, root = manifest(leaves, path)
    if root is None:
        return placed.select("doc_id", *(F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), F.lit(False).alias("verified"))
    most = placed.agg(F.max("n")).first()[0]
    storeys = 0
    while RUN**storeys < most:
        storeys += 1
    nodes = stored(spark, f"{path}/sources") if storeys else spark.createDataFrame([], f"{NODE}, level int")
    above = tops(placed, f"{path}/sources", storeys, trees) if storeys else trees.select("tree", F.lit(0).cast("bigint").alias("idx"), "above")
    merged = _merged(placed, 0, nodes, above, "doc_id", "altered")
    found = merged.mapInArrow(_judged(root), "doc_id bigint, tree bigint, leaf string, proof_sha256 string, folded_root string, verified boolean")
    named = trees.select("tree", F.lower(F.hex("subroot")).alias("subroot"))
    joined = found.join(runtime.if_small(named, trees.count()), "tree")
    return joined.select("doc_id", "leaf", "subroot", F.lit(root.hex()).alias("root"), "proof_sha256", "folded_root", "verified")


#: Levels of the SQL below, enough for 59 049 rows of a source and as many sources.
_SQL_LEVELS = 10


def _sql() -> str:
    shown = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(cast({c} AS VARCHAR)) || ':' || cast({c} AS VARCHAR) END"
    head = " || ".join(shown(c) for c in COLUMNS[:-1])
    crc = (
        "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(cast(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), "
        "lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"
    )
    out = [
        f"WITH d AS (SELECT doc_id, source, sha256({head} || {shown('text')}) AS leaf, sha256({head} || {shown('t')}) AS other"
        f" FROM (SELECT *, CASE WHEN xor({crc}, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS t FROM documents))",
        "l AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d)",
        "n0 AS (SELECT tree, i, n, leaf AS h FROM l)",
    ]

    def levels(name: str) -> None:
        for k in range(_SQL_LEVELS):
            out.append(f"{name}r{k} AS (SELECT tree, i // 3 AS run, n, list(h ORDER BY i) AS hs FROM {name}{k} GROUP BY tree, i // 3, n)")
            out.append(f"{name}{k + 1} AS (SELECT tree, run AS i, (n + 2) // 3 AS n, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {name}r{k})")

    levels("n")
    out.append(f"m0 AS (SELECT 0 AS tree, tree AS i, count(*) OVER () AS n, h FROM n{_SQL_LEVELS})")
    levels("m")
    out.append("p0 AS (SELECT doc_id, leaf, tree, i AS pos, other AS f, '' AS sib FROM l)")
    number = 0
    for name in ("n", "m"):
        if name == "m":
            out.append(f"p{number + 1} AS (SELECT doc_id, leaf, tree, tree AS pos, f, sib FROM p{number})")
            number += 1
        tree = "p.tree" if name == "n" else "0"
        for k in range(_SQL_LEVELS):
            before, after = "array_to_string(hs[1:pos % 3], '')", "array_to_string(hs[pos % 3 + 2:], '')"
            out.append(
                f"p{number + 1} AS (SELECT doc_id, leaf, p.tree, pos // 3 AS pos, CASE WHEN n = 1 THEN f ELSE sha256({before} || f || {after}) END AS f, CASE WHEN n = 1 THEN sib ELSE sib || {before} || {after} END AS sib"
                f" FROM p{number} p JOIN {name}r{k} r ON r.tree = {tree} AND r.run = pos // 3)"
            )
            number += 1
    out.append(f"z AS (SELECT h AS root FROM m{_SQL_LEVELS})")
    return ",\n".join(out) + (
        f"\nSELECT doc_id, leaf, s.h AS subroot, root, sha256(sib) AS proof_sha256, f AS folded_root, f = root AS verified FROM p{number} p JOIN n{_SQL_LEVELS} s ON s.tree = p.tree, z"
    )


#: The same result in SQL, level by level.
SQL = _sql()
