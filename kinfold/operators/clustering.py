"""Grouping faces into persons: greedy assignment of new faces, exact average linkage with pins, stable ids."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold import constants as C
from kinfold import runtime
from kinfold.operators.components import connected_components
from kinfold.operators.ranking import ranked
from kinfold.operators.similarity import BLOCK, BLOCK_ROWS, PAIR_TASKS, block_pairs, cosine_pairs, kept_apart, matrix_of, packed_block, pair_products, person_means, unit_rows


class RunningMeans:
    """Person means in the order in which persons were first seen, each updated by every face that joins.

    The means are rows of one float32 matrix that grows by doubling; their lengths are kept beside them.
    """

    def __init__(self):
        self.names: list[int] = []
        self.counts: list[int] = []
        self._place: dict[int, int] = {}
        self._rows = np.zeros((0, 0), dtype=np.float32)
        self._lengths = np.zeros(0, dtype=np.float32)

    def means(self) -> np.ndarray:
        return self._rows[: len(self.names)]

    def load(self, names: list[int], means: list, counts: list[int]) -> None:
        """Persons that are known already, in the order in which ties go."""
        for name, mean, n in zip(names, means, counts, strict=True):
            self._open(name, np.asarray(mean, dtype=np.float32))
            self.counts[-1] = n

    def _open(self, name: int, vector: np.ndarray) -> None:
        k = len(self.names)
        if k == len(self._rows):
            rows = np.zeros((max(64, 2 * k), len(vector)), dtype=np.float32)
            lengths = np.zeros(len(rows), dtype=np.float32)
            rows[:k, : self._rows.shape[1]], lengths[:k] = self._rows, self._lengths
            self._rows, self._lengths = rows, lengths
        self._place[name] = k
        self.names.append(name)
        self.counts.append(1)
        self._set(k, vector)

    def _set(self, k: int, vector: np.ndarray) -> None:
        self._rows[k] = vector
        self._lengths[k] = np.sqrt((vector * vector).sum())

    def add(self, name: int, vector: np.ndarray) -> None:
        k = self._place.get(name)
        if k is None:
            self._open(name, vector)
            return
        n = self.counts[k]
        self._set(k, (self._rows[k] * n + vector) / np.asarray(n + 1, dtype=vector.dtype))
        self.counts[k] = n + 1

    def nearest(self, vector: np.ndarray, threshold: float) -> int | None:
        """The first of the most similar means, if its cosine is over the threshold."""
        if not self.names:
            return None
        length = self._lengths[: len(self.names)] * np.sqrt((vector * vector).sum())
        sim = np.divide(self.means() @ vector, length, out=np.zeros(len(length), dtype=np.float32), where=length > 0)
        best = int(np.argmax(sim))
        return self.names[best] if sim[best] > threshold else None

    def assign(self, vector: np.ndarray, threshold: float) -> int:
        """The person of a new face: an old one, or a tentative one that later faces may join."""
        name = self.nearest(vector, threshold)
        if name is None:
            name = -(len(self.names) + C.TENTATIVE_BASE)
        self.add(name, vector)
        return name


def greedy_assign(new_faces: DataFrame, existing: DataFrame, threshold: float = C.COSINE_THRESHOLD) -> DataFrame:
    """(face_id, person_id) of the new faces in the order of their ids; persons that had to be opened are negative.

    Each face sees the means as all before it left them, so one task walks through the batch; the known persons
    reach it as one mean and count each, added up by partial sums, not face by face. Ties go to the person seen first.
    """
    runtime.ship_package(new_faces.sparkSession)
    known = existing.where(F.col("person_id").isNotNull()).select("person_id", "id", "embedding")
    first = known.groupBy("person_id").agg(F.min("id").alias("face_id"), F.count("*").alias("faces"))
    old = person_means(known).select("person_id", F.col("mean").cast("array<float>").alias("embedding")).join(first, "person_id")
    rows = old.select(F.lit(0).alias("part"), "person_id", "face_id", "faces", "embedding").union(
        new_faces.select(F.lit(1), F.lit(None).cast("bigint"), "id", F.lit(1).cast("bigint"), F.col("embedding").cast("array<float>"))
    )

    def walk(table: pa.Table) -> pa.Table:
        means, faces, persons = RunningMeans(), [], []
        table = table.sort_by([("part", "ascending"), ("face_id", "ascending")])
        for part, person, face, n, vector in zip(*(table.column(c).to_pylist() for c in ("part", "person_id", "face_id", "faces", "embedding")), strict=True):
            if part == 0:
                means.load([person], [vector], [n])
            else:
                faces.append(face)
                persons.append(means.assign(np.asarray(vector, dtype=np.float32), threshold))
        return pa.table([pa.array(faces, pa.int64()), pa.array(persons, pa.int64())], names=["face_id", "person_id"])

    return rows.withColumn("all", F.lit(1)).groupBy("all").applyInArrow(walk, "face_id bigint, person_id bigint")


def average_linkage(unit: np.ndarray, anchors: list[int | None], threshold: float) -> list[list[int]]:
    """Clusters of rows: the two most similar ones merge until no average reaches the threshold.

    Clusters that are pinned to different persons never merge. Ties go to the first pair. Each row keeps its best
    partner to the right of it, and only rows whose best partner is touched look again.
    """
    n = len(unit)
    sim = unit @ unit.T
    tied = np.array([-1 if a is None else a for a in anchors], dtype=np.int64)
    held = np.array([a is not None for a in anchors])
    sim[held[:, None] & held[None, :] & (tied[:, None] != tied[None, :])] = -np.inf
    np.fill_diagonal(sim, -np.inf)
    size, members, alive = np.ones(n), [[i] for i in range(n)], np.ones(n, dtype=bool)
    best = np.full(n, -np.inf)
    at = np.zeros(n, dtype=np.int64)

    def look(i: int) -> None:
        if i + 1 < n:
            at[i] = i + 1 + int(np.argmax(sim[i, i + 1 :]))
            best[i] = sim[i, at[i]]

    for i in range(n):
        look(i)
    while n:
        a = int(np.argmax(best))
        if not best[a] >= threshold - C.LINKAGE_SLACK:
            break
        b = int(at[a])
        merged = (size[a] * sim[a] + size[b] * sim[b]) / (size[a] + size[b])
        held[a], tied[a] = held[a] or held[b], tied[a] if held[a] else tied[b]
        if held[a]:
            merged[held & (tied != tied[a])] = -np.inf
        size[a] += size[b]
        members[a] += members[b]
        alive[b] = False
        merged[~alive] = merged[a] = -np.inf
        sim[a], sim[:, a] = merged, merged
        sim[b], sim[:, b] = -np.inf, -np.inf
        best[b] = -np.inf
        stale = alive & ((at == a) | (at == b))
        stale[a] = True
        before = np.flatnonzero(alive[:a] & ~stale[:a])
        higher = before[(merged[before] > best[before]) | ((merged[before] == best[before]) & (a < at[before]))]
        best[higher], at[higher] = merged[higher], a
        for i in np.flatnonzero(stale):
            look(int(i))
    return [members[i] for i in np.flatnonzero(alive)]


def chained_linkage(unit: np.ndarray, anchors: list[int | None], threshold: float, sizes: np.ndarray | None = None) -> list[list[int]]:
    """The clusters of ``average_linkage`` without a matrix of all pairs: the average over two clusters is the product of their mean vectors.

    With ``sizes`` the rows are clusters already, given by the sums of their vectors. From some cluster a chain goes on to the most similar one until two are each other's most similar; these would merge in any order,
    as a merged cluster is to no other more similar than the better of its parts. Memory grows with the rows, time with their square.
    """
    n = len(unit)
    sums, size = unit.copy(), np.ones(n) if sizes is None else sizes.astype(np.float64)
    tied = np.array([-1 if a is None else a for a in anchors], dtype=np.int64)
    held = np.array([a is not None for a in anchors])
    members, alive, chain = [[i] for i in range(n)], np.ones(n, dtype=bool), []

    def nearest(a: int) -> tuple[int, float]:
        sim = sums @ sums[a] / (size * size[a])
        sim[~alive] = -np.inf
        sim[a] = -np.inf
        if held[a]:
            sim[held & (tied != tied[a])] = -np.inf
        # Of equals the one the chain came from, else it might go round for ever.
        if len(chain) > 1 and sim[chain[-2]] >= sim.max():
            return chain[-2], float(sim[chain[-2]])
        best = int(np.argmax(sim))
        return best, float(sim[best])

    open_ = np.ones(n, dtype=bool)
    while chain or open_.any():
        if not chain:
            chain.append(int(np.argmax(open_)))
        a = chain[-1]
        b, sim = nearest(a)
        if not sim >= threshold - C.LINKAGE_SLACK:
            # Nothing is near enough to the last one, and no merge elsewhere can bring anything nearer.
            open_[a] = False
            chain.pop()
        elif len(chain) > 1 and chain[-2] == b:
            chain[-2:] = []
            a, b = min(a, b), max(a, b)
            sums[a] += sums[b]
            size[a] += size[b]
            if held[b]:
                held[a], tied[a] = True, tied[b]
            members[a] += members[b]
            alive[b] = open_[b] = False
            open_[a] = True
        else:
            chain.append(b)
    return [members[i] for i in np.flatnonzero(alive)]


#: Rows of a component up to which all pairs are held in a matrix: 128 MB.
MATRIX_ROWS = 4096


def cluster_ids(unit: np.ndarray, anchors: list[int | None], places: np.ndarray, threshold: float, matrix_rows: int = MATRIX_ROWS) -> np.ndarray:
    """For each row the person its cluster is pinned to, else -(lowest place in it + 1)."""
    out = np.zeros(len(unit), dtype=np.int64)
    for own in (average_linkage if len(unit) <= matrix_rows else chained_linkage)(unit, anchors, threshold):
        pinned = [anchors[i] for i in own if anchors[i] is not None]
        out[own] = pinned[0] if pinned else -(int(places[own].min()) + 1)
    return out


#: A round of merges is worth its time if it merges one cluster in so many at least.
ROUND_SHARE = 64


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The whole numbers in order, each once; by sorting, which is faster here than ``np.unique``."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def mutual_rounds(sums: np.ndarray, size: np.ndarray, held: np.ndarray, tied: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges, in place, the clusters that are each other's most similar by the links (a, b), round by round until few are.

    Returns the row that each row has gone into, and the links that are left. Rounds are those of ``merge_round``, and what follows them may be in any order.
    """
    n, top = len(sums), np.arange(len(sums))
    key = _distinct(np.minimum(a, b) * n + np.maximum(a, b))
    a, b = np.divmod(key, n)
    sim, again = np.zeros(len(a)), np.ones(len(a), dtype=bool)
    while len(a):
        at = np.flatnonzero(again)
        sim[at] = pair_products(sums, a[at], b[at]) / (size[a[at]] * size[b[at]])
        fit = (sim >= threshold - C.LINKAGE_SLACK) & ~(held[a] & held[b] & (tied[a] != tied[b]))
        key, a, b, sim = key[fit], a[fit], b[fit], sim[fit]
        best = np.full(n, -np.inf)
        np.maximum.at(best, a, sim)
        np.maximum.at(best, b, sim)
        # Of equals the first pair is taken, by its smaller end and then by the larger one.
        first = np.full(n, n * n)
        for end in (a, b):
            top_of = sim == best[end]
            np.minimum.at(first, end[top_of], key[top_of])
        won = np.flatnonzero((first[a] == key) & (first[b] == key))
        into, gone = a[won], b[won]
        sums[into] += sums[gone]
        size[into] += size[gone]
        tied[into] = np.where(held[into], tied[into], tied[gone])
        held[into] |= held[gone]
        step = np.arange(n)
        step[gone] = into
        top = step[top]
        moved = np.zeros(n, dtype=bool)
        moved[into] = True
        few = len(won) * ROUND_SHARE < np.count_nonzero(best > -np.inf)
        x, y = step[a], step[b]
        again = moved[x] | moved[y]
        # Links of merged clusters fall together; those of others stay as they are.
        at = again & (x != y)
        fresh = _distinct(np.minimum(x[at], y[at]) * n + np.maximum(x[at], y[at]))
        key, sim = np.concatenate([key[~again], fresh]), np.concatenate([sim[~again], np.zeros(len(fresh))])
        again = np.arange(len(key)) >= len(key) - len(fresh)
        a, b = np.divmod(key, n)
        if few:
            break
    return top, a, b


def _cut(values, sizes: np.ndarray) -> list:
    """``values`` in pieces of these sizes, one after the other."""
    ends = np.cumsum(sizes).tolist()
    return [values[i:j] for i, j in zip([0, *ends], ends, strict=False)]


def linked_linkage(sums: np.ndarray, size: np.ndarray, held: np.ndarray, tied: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> list[list[int]]:
    """The clusters of ``average_linkage`` over clusters given by the sums of their vectors, of which the pairs (a, b) alone are near enough.

    Two clusters reach the threshold only if some pair of their parts does, so a cluster looks at those alone that its parts are linked with. The
    chain is that of ``chained_linkage``, after rounds that merge many at once. Time and memory grow with the links.
    """
    n, sums, size, held, tied = len(sums), sums.copy(), size.astype(np.float64), held.copy(), tied.copy()
    grown, a, b = mutual_rounds(sums, size, held, tied, a, b, threshold)
    ends, others = np.concatenate([a, b]), np.concatenate([b, a])
    near_by = _cut(others[np.argsort(ends, kind="stable")], np.bincount(ends, minlength=n))
    top, chain = grown, []
    members = _cut(np.argsort(grown, kind="stable").tolist(), np.bincount(grown, minlength=n))

    def nearest(x: int) -> tuple[int, float] | None:
        if not len(near_by[x]):
            return None
        near = np.unique(top[near_by[x]])
        near = near[near != x]
        # Products are summed in one order for both directions of a pair, so both have the same number.
        sim = (sums[near] * sums[x]).sum(axis=1) / (size[near] * size[x])
        fit = sim >= threshold - C.LINKAGE_SLACK
        if held[x]:
            fit &= ~(held[near] & (tied[near] != tied[x]))
        near_by[x], sim = near[fit], sim[fit]
        if not len(sim):
            return None
        at = int(np.argmax(sim))
        if len(chain) > 1:
            # Of equals the one the chain came from, else it might go round for ever.
            came = np.flatnonzero(near_by[x] == chain[-2])
            at = int(came[0]) if len(came) and sim[came[0]] >= sim[at] else at
        return int(near_by[x][at]), float(sim[at])

    for start in range(n):
        if top[start] != start:
            continue
        chain.append(start)
        while chain:
            x = chain[-1]
            found = nearest(x)
            if found is None:
                chain.pop()
            elif len(chain) > 1 and chain[-2] == found[0]:
                chain[-2:] = []
                into, gone = (x, found[0]) if len(members[x]) >= len(members[found[0]]) else (found[0], x)
                sums[into] += sums[gone]
                size[into] += size[gone]
                if held[gone]:
                    held[into], tied[into] = True, tied[gone]
                top[members[gone]] = into
                members[into] += members[gone]
                near_by[into] = np.concatenate([near_by[into], near_by[gone]])
                members[gone], near_by[gone] = [], near_by[gone][:0]
                if not chain:
                    chain.append(into)
            else:
                chain.append(found[0])
    return [m for m in members if m]


#: Clusters and links of a component that one task finishes; in larger ones rounds of merges come first. So many
#: vectors of 64 numbers are 67 MB, of which the task holds some four copies; so many links are 48 MB.
LINKAGE_ROWS, LINKAGE_LINKS = 131_072, 2_000_000
#: Rounds after which components are looked for again.
ROUNDS = 4


def _ends(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def _applied(clusters: DataFrame, links: DataFrame, step: DataFrame, moves: int, count: int, threshold: float, block_rows: int) -> DataFrame:
    """The links between the ``count`` ``clusters`` (id, sum, size, anchor) after the ``moves`` merges of ``step`` (id, target).

    Only links of merged clusters are computed again. They are dealt to the pairs of blocks of clusters, of which each two meet in a task.
    """
    ends = step.select("id", "target").union(step.select(F.col("target").alias("id"), "target")).distinct()
    ends = runtime.if_small(ends, 2 * moves)
    both = links.join(ends.withColumnsRenamed({"id": "a", "target": "ta"}), "a", "left").join(ends.withColumnsRenamed({"id": "b", "target": "tb"}), "b", "left")
    x, y = F.coalesce("ta", "a"), F.coalesce("tb", "b")
    again = F.col("ta").isNotNull() | F.col("tb").isNotNull()
    blocks = max(1, -(-count // block_rows))
    own = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    asked = both.where(again & (x != y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    asked = asked.select("a", "b", F.least(own("a"), own("b")).alias("i"), F.greatest(own("a"), own("b")).alias("j"))
    sent = clusters.withColumns({"own": own("id"), "other": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    sent = sent.select("id", "sum", "size", "anchor", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compute(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        ids, sums, size = np.asarray(rows.column("id")), matrix_of(rows.column("sum")), np.asarray(rows.column("size"))
        held, tied = kept_apart(rows.column("anchor"))
        a, b = (np.searchsorted(ids, np.asarray(pairs.column(c))) for c in "ab")
        # Links that have fallen together are one: both ends of a pair always meet in the same task.
        a, b = np.divmod(np.unique(a * max(len(ids), 1) + b), max(len(ids), 1))
        sim = pair_products(sums, a, b) / (size[a] * size[b])
        fit = (sim >= threshold - C.LINKAGE_SLACK) & ~(held[a] & held[b] & (tied[a] != tied[b]))
        return pa.table({"a": ids[a[fit]], "b": ids[b[fit]], "sim": sim[fit]})

    if count > BLOCK_ROWS:
        sent, asked = (t.repartition(min(PAIR_TASKS, blocks * (blocks + 1) // 2), "i", "j") for t in (sent, asked))
    fresh = sent.groupBy("i", "j").cogroup(asked.groupBy("i", "j")).applyInArrow(compute, "a bigint, b bigint, sim double")
    return runtime.materialize(both.where(~again).select("a", "b", "sim").union(fresh), "links")


def merge_copies(clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``clusters`` with those of equal vectors merged, and which (id) went into which (target).

    All that have no pin go with the first, and so do those pinned to the person of the first pin among them; each other person's come together
    by themselves. Nothing is nearer than they are, and merging them pair by pair would take a round for each. Vectors without length are near to nothing.
    """
    pin = F.min(F.when(F.col("anchor").isNotNull(), F.struct("id", "anchor")))["anchor"]
    # Few vectors have a hash that others have, too; these alone are compared as they are.
    told = clusters.withColumn("hash", F.xxhash64("sum"))
    crowded = told.groupBy("hash").count().where("count > 1").select("hash")
    same = told.join(crowded, "hash", "left_semi").groupBy("sum").agg(pin.alias("pin"), F.count("*").alias("n")).where((F.col("n") > 1) & F.exists("sum", lambda v: v != 0))
    side = F.when(F.col("anchor") != F.col("pin"), F.col("anchor"))
    told = clusters.join(same, "sum").select("id", "sum", "size", "anchor", side.alias("side"))
    merged = told.groupBy("sum", "side").agg(F.min("id").alias("target"), F.sum("size").alias("n"), F.max("anchor").alias("one"))
    step = told.join(merged, told["sum"].eqNullSafe(merged["sum"]) & told["side"].eqNullSafe(merged["side"])).where("id <> target").select("id", "target")
    step = runtime.materialize(step, "copies", narrow=8)
    grown = merged.select(F.col("target").alias("id"), "n", "one")
    left = clusters.join(step, "id", "left_anti").join(grown, "id", "left")
    return left.select("id", F.when(F.col("n").isNull(), F.col("sum")).otherwise(F.transform("sum", lambda v: v * F.col("n"))).alias("sum"), F.coalesce("n", "size").alias("size"), F.coalesce("anchor", "one").alias("anchor")), step


def merge_round(clusters: DataFrame, links: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """The ``count`` ``clusters`` with all pairs merged that are each other's most similar by ``links`` (a, b, sim), and which (id) went into which (target).

    Of equally similar pairs the first is taken, by the smaller id and then by the larger one, so some pair always merges.
    """
    best = links.select(F.col("a").alias("id"), "sim").union(links.select("b", "sim")).groupBy("id").agg(F.max("sim").alias("best"))
    best = runtime.if_small(best, count)
    for end in "ab":
        links = links.join(best.withColumnRenamed("id", end), end).where("sim = best").drop("best")
    links = links.select("a", "b", "sim")
    first = F.min(F.struct("a", "b")).alias("first")
    firsts = links.select(F.col("a").alias("id"), "a", "b").union(links.select("b", "a", "b")).groupBy("id").agg(first)
    # A pair that is the first of both its ends stands twice.
    pairs = firsts.groupBy(F.col("first.a").alias("target"), F.col("first.b").alias("id")).count().where("count = 2")
    step = runtime.materialize(pairs.select("id", "target"), "merges", narrow=8)
    taken = clusters.join(step, "id").select(F.col("target").alias("id"), F.col("sum").alias("more"), F.col("size").alias("extra"), F.col("anchor").alias("pin"))
    kept = clusters.join(step, "id", "left_anti").join(taken, "id", "left")
    added = F.when(F.col("more").isNull(), F.col("sum")).otherwise(F.zip_with("sum", "more", lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0))))
    return kept.select("id", added.alias("sum"), (F.col("size") + F.coalesce("extra", F.lit(0))).alias("size"), F.coalesce("anchor", "pin").alias("anchor")), step


def _finished(rooted: DataFrame, tied: DataFrame, threshold: float) -> DataFrame:
    """(id, target) of clusters (root, id, sum, size, anchor) with their links (root, a, b), each root in a task."""

    def finish(rows: pa.Table, links: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        ids, sums, size = np.asarray(rows.column("id")), matrix_of(rows.column("sum")), np.asarray(rows.column("size"))
        if len(ids) <= MATRIX_ROWS and (size == 1).all():
            found = average_linkage(sums, rows.column("anchor").to_pylist(), threshold)
        else:
            a, b = (np.searchsorted(ids, np.asarray(links.column(c))) for c in "ab")
            found = linked_linkage(sums, size, *kept_apart(rows.column("anchor")), a, b, threshold)
        target = ids.copy()
        for own in found:
            target[own] = ids[own].min()
        moved = target != ids
        return pa.table({"id": ids[moved], "target": target[moved]})

    return rooted.groupBy("root").cogroup(tied.groupBy("root")).applyInArrow(finish, "id bigint, target bigint")


#: Bins of a similarity that levels are looked for among.
LEVELS = 256
#: Of more links than a task holds, a level takes one in so many.
LEVEL_SHARE = 4


def _level(links: DataFrame, most: int, threshold: float) -> float | None:
    """The lowest bound, above the threshold, that some and at most ``most`` links reach."""
    bins = links.groupBy(F.floor(F.col("sim") * LEVELS).alias("at")).count().collect()
    level, found = None, 0
    for at, n in sorted(((r["at"], r["count"]) for r in bins), reverse=True):
        found += n
        if found > most or at / LEVELS <= threshold:
            break
        level = at / LEVELS
    return level


def _lists(x: np.ndarray) -> pa.ListArray:
    """The rows of ``x`` as a column of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _merged_blocks(clusters: DataFrame, step: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """``clusters`` after the merges of ``step`` (id, target), and their mean vectors in ``blocks`` as ``block_pairs`` takes them."""
    moved = clusters.join(step, "id", "left").withColumn("target", F.coalesce("target", "id"))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("target", "ascending"), ("id", "ascending")])
        ids, sums, size = np.asarray(rows.column("target")), matrix_of(rows.column("sum")), np.asarray(rows.column("size"))
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        held, tied = kept_apart(rows.column("anchor"))
        # All pins of a cluster are of one person.
        pin = np.maximum.reduceat(np.where(held, tied, np.iinfo(np.int64).min), first)
        pinned = np.logical_or.reduceat(held, first)
        sums, size = np.add.reduceat(sums, first, axis=0), np.add.reduceat(size, first)
        return pa.table([pa.array(ids[first]), _lists(sums), pa.array(size), pa.array(pin, mask=~pinned)], names=["id", "sum", "size", "anchor"])

    def pack(rows: pa.Table) -> pa.Table:
        x = matrix_of(rows.column("sum")) / np.asarray(rows.column("size"))[:, None]
        return packed_block(rows.column("own")[0].as_py(), rows.column("id"), x, rows.column("anchor"))

    own = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int").alias("own")
    merged = moved.withColumn("own", own("target")).repartition(blocks, "own").groupBy("own").applyInArrow(run, "id bigint, sum array<double>, size bigint, anchor bigint")
    merged = runtime.materialize(merged, "clusters")
    return merged, merged.withColumn("own", own("id")).repartition(blocks, "own").groupBy("own").applyInArrow(pack, BLOCK)


def merges(clusters: DataFrame, links: DataFrame, threshold: float, most_rows: int = LINKAGE_ROWS, block_rows: int = BLOCK_ROWS, told: tuple[int, int] | None = None) -> list[DataFrame]:
    """Average linkage of clusters (id, sum, size, anchor) that ``links`` (a, b, sim) holds all near pairs of, as merges (id, target) one after the other.

    A merged cluster is to no other more similar than the better of its parts was, and may merge with it only if both parts might. So two that are each
    other's best stay so until they merge, any order of such merges leads to the same clusters, and a pair below the threshold is out for good.
    For the same reason the clusters at a higher threshold are on the way to those at a lower one: of more links than a task holds, the most similar
    are merged as if their level were the threshold, and then what is left is compared anew. Where there is no such level, a round merges
    all pairs that are each other's best. Components of the links that are left and that a task can hold are finished there.
    ``told``: how many links and clusters there are, where they have been counted.
    """
    steps: list[DataFrame] = []
    left, count = told or (links.count(), clusters.count())
    forced, rounds = False, 0
    while left:
        level = _level(links, max(LINKAGE_LINKS, left // LEVEL_SHARE), threshold) if left > LINKAGE_LINKS and not forced else None
        if level is not None:
            upper = runtime.materialize(links.where(F.col("sim") >= level), "upper")
            own = merges(clusters.join(_ends(upper), "id", "left_semi"), upper, level + C.LINKAGE_SLACK, most_rows, block_rows)
            step = _last_targets(own, clusters.sparkSession)
            moved = step.count()
            if moved:
                steps.append(step)
                blocks = max(1, -(-(count - moved) // block_rows))
                clusters, packed = _merged_blocks(clusters, step, blocks)
                links = runtime.materialize(block_pairs(packed, blocks, threshold - C.LINKAGE_SLACK), "links")
                left, count = links.count(), count - moved
                continue
        if left > LINKAGE_LINKS or forced:
            for k in range(-1 if not rounds else 0, ROUNDS):
                # Before the first round equal vectors merge.
                merged, step = merge_copies(clusters) if k < 0 else merge_round(clusters, links, count)
                moved = step.count()
                if moved:
                    clusters, count = runtime.materialize(merged, "clusters"), count - moved
                    links = _applied(clusters, links, step, moved, count, threshold, block_rows)
                    steps.append(step)
                rounds += k >= 0
                left = links.count()
                if k >= 0 and left <= LINKAGE_LINKS and (count <= most_rows or not forced):
                    break
        # What one task may finish, one task may walk through.
        roots = connected_components(links.select("a", "b"), LINKAGE_LINKS, clean=True).withColumnRenamed("node", "id")
        if left <= LINKAGE_LINKS and count <= most_rows:
            # No component can be too large, so none is looked for. Every cluster with a link has a root or is one.
            roots = runtime.materialize(roots, "roots", narrow=0).select("id", "root")
            named = runtime.if_small(roots.union(roots.select(F.col("root").alias("id"), "root").distinct()), count)
            tied = links.join(named.select(F.col("id").alias("a"), F.col("root").alias("top")), "a").select(F.col("top").alias("root"), "a", "b")
            steps.append(runtime.materialize(_finished(clusters.join(named, "id"), tied, threshold), "finished", narrow=4))
            break
        clusters = clusters.join(_ends(links), "id", "left_semi")
        rooted = runtime.materialize(clusters.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "rooted")
        tied = runtime.materialize(links.join(rooted.select(F.col("id").alias("a"), "root"), "a"), "tied")
        rows, ties = rooted.groupBy("root").agg(F.count("*").alias("n")), tied.groupBy("root").agg(F.count("*").alias("m"))
        large = runtime.materialize(rows.join(ties, "root").where((F.col("n") > most_rows) | (F.col("m") > LINKAGE_LINKS)).select("root"), "large-roots", narrow=0)
        many = large.count()
        large = runtime.if_small(large, many)
        steps.append(runtime.materialize(_finished(*(t.join(large, "root", "left_anti") if many else t for t in (rooted, tied)), threshold), "finished", narrow=4))
        if not many:
            break
        clusters = rooted.join(large, "root", "left_semi").drop("root")
        links = runtime.materialize(tied.join(large, "root", "left_semi").select("a", "b", "sim"), "links")
        left, forced, count = links.count(), True, clusters.count()
    return steps


def _last_targets(steps: list[DataFrame], spark) -> DataFrame:
    """(id, target) of all that moved in one of the steps, with where it is after the last."""
    if not steps:
        return spark.createDataFrame([], "id bigint, target bigint")
    total = steps[-1]
    for step in reversed(steps[:-1]):
        later = total.select(F.col("id").alias("target"), F.col("target").alias("top"))
        total = total.union(step.join(later, "target", "left").select("id", F.coalesce("top", "target").alias("target")))
        total = runtime.materialize(total, "targets", narrow=4)
    return total


def recluster(faces: DataFrame, threshold: float = C.COSINE_THRESHOLD, most_rows: int = LINKAGE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(face_id, cluster_id) by constrained average linkage over all faces (id, person_id, pinned, embedding).

    A merge needs an average of at least the threshold, hence a pair that reaches it. All pairs are compared once; what follows works on
    those that reach it, and faces in no such pair are done. The place of a face is its rank by id in the whole table.
    """
    spark = faces.sparkSession
    runtime.ship_package(spark)
    anchor = F.when(F.col("pinned") & F.col("person_id").isNotNull(), F.col("person_id")).alias("anchor")
    count = faces.count()
    links = runtime.materialize(cosine_pairs(faces.select("id", "embedding", anchor), threshold - C.LINKAGE_SLACK, block_rows, "anchor", count), "links")

    def unit(batches):
        for batch in batches:
            sums = _lists(unit_rows(batch.column("embedding")))
            size = pa.array(np.ones(batch.num_rows, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), sums, size, batch.column("anchor")], names=["id", "sum", "size", "anchor"])

    linked, left = faces.select("id", anchor, "embedding"), links.count()
    # With few links most faces are in none of them; with many, finding those out would cost more than it saves.
    few = left < count
    if few:
        linked = linked.join(_ends(links), "id", "left_semi")
    clusters = runtime.materialize(linked.mapInArrow(unit, "id bigint, sum array<double>, size bigint, anchor bigint"), "clusters")
    moved = _last_targets(merges(clusters, links, threshold, most_rows, block_rows, (left, clusters.count() if few else count)), spark)
    # Ids alone are sorted.
    placed = ranked(faces.select("id", anchor), "id").join(moved, "id", "left").withColumn("target", F.coalesce("target", "id"))
    named = placed.groupBy("target").agg(F.min("place").alias("lead"), F.max("anchor").alias("pin"))
    return placed.join(named, "target").select(F.col("id").alias("face_id"), F.coalesce("pin", -(F.col("lead") + 1)).alias("cluster_id"))


#: Rows of overlaps that one task goes through.
CLAIM_ROWS = 500_000


def _claimed(overlap: DataFrame) -> DataFrame:
    """The claims of overlaps that one task holds: gone through in their order, each is taken whose cluster and person are free."""

    def walk(batches):
        table = pa.Table.from_batches(held) if (held := list(batches)) else None
        clusters, persons, won = set(), set(), []
        if table is not None:
            table = table.sort_by([("n", "descending"), ("person_id", "ascending"), ("first_face", "ascending"), ("cluster_id", "ascending")])
            for c, p in zip(table.column("cluster_id").to_pylist(), table.column("person_id").to_pylist(), strict=True):
                if c not in clusters and p not in persons:
                    clusters.add(c)
                    persons.add(p)
                    won.append((c, p))
        yield pa.RecordBatch.from_arrays([pa.array([w[k] for w in won], pa.int64()) for k in (0, 1)], names=["cluster_id", "person_id"])

    return overlap.coalesce(1).mapInArrow(walk, "cluster_id bigint, person_id bigint")


def claims(overlap: DataFrame, finish_rows: int = CLAIM_ROWS) -> DataFrame:
    """(cluster_id, person_id): greedy one-to-one claims by falling overlap, then person, then first face.

    ``overlap`` has cluster_id, person_id, n and first_face. The claims come from a total order, so a pair that is the
    first of both its cluster and its person is always taken: each round takes all such pairs and drops what they rule out. A chain of
    claims would take a round for each, so what is left is finished in one task once it is no more than ``finish_rows``.
    """
    runtime.ship_package(overlap.sparkSession)
    left = runtime.materialize(overlap, "overlap")
    taken: DataFrame | None = None
    order = [F.desc("n"), F.asc("person_id"), F.asc("first_face"), F.asc("cluster_id")]
    while left.count() > finish_rows:
        first = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1
        won = runtime.materialize(left.withColumn("c", first("cluster_id")).withColumn("p", first("person_id")).where("c AND p").select("cluster_id", "person_id"), "won")
        taken = won if taken is None else taken.union(won)
        rest = left.join(won.select("cluster_id"), "cluster_id", "left_anti").join(won.select("person_id"), "person_id", "left_anti")
        left = runtime.materialize(rest.select(*overlap.columns), "overlap")
    rest = _claimed(left)
    return taken.union(rest) if taken is not None else rest


def overlaps(faces: DataFrame, assignment: DataFrame) -> DataFrame:
    """(cluster_id, person_id, n, first_face): how many faces of a cluster a person had before, and the cluster's first face."""
    previous = faces.where(F.col("person_id").isNotNull()).select(F.col("id").alias("face_id"), "person_id")
    first = assignment.groupBy("cluster_id").agg(F.min("face_id").alias("first_face"))
    counts = assignment.join(previous, "face_id").groupBy("cluster_id", "person_id").agg(F.count("*").alias("n"))
    return counts.join(first, "cluster_id")


def stabilize(faces: DataFrame, assignment: DataFrame) -> DataFrame:
    """(face_id, person_id): clusters without a pinned person take over the person most of their faces had before.

    Persons that pins have claimed are out; a cluster that claims nobody keeps its negative id. Applied to its own
    result it changes nothing.
    """
    clusters = runtime.materialize(assignment.select("face_id", "cluster_id"), "assignment")
    named = clusters.where("cluster_id >= 0").select(F.col("cluster_id").alias("person_id")).distinct()
    loose = clusters.where("cluster_id < 0")
    free = overlaps(faces, loose).join(named, "person_id", "left_anti")
    won = claims(free.select("cluster_id", "person_id", "n", "first_face"))
    return clusters.join(won, "cluster_id", "left").select("face_id", F.coalesce("person_id", "cluster_id").alias("person_id"))


@dataclass
class Regrouped:
    """The tables after a regrouping; equal to those before where nothing changed."""

    faces: DataFrame
    persons: DataFrame


def with_new_persons(persons: DataFrame, assigned: DataFrame, next_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Persons for the negative ids of ``assigned`` (face_id, person_id), in the order of their first faces.

    Returns all persons, and (tentative, id) of the new ones. A new name counts all persons; colours go on along the
    palette and then around the colour wheel.
    """
    from kinfold.functions import media

    opened = assigned.where("person_id < 0").groupBy(F.col("person_id").alias("tentative")).agg(F.min("face_id").alias("first_face"))
    totals = persons.agg(F.count("*").alias("n"), F.coalesce(F.max("id"), F.lit(0)).alias("top"), F.count_distinct("color").alias("used")).first()
    used = {r["color"] for r in persons.where(F.col("color").isin(*C.PERSON_PALETTE)).select("color").distinct().collect()}
    free = [c for c in C.PERSON_PALETTE if c not in used]
    base = next_id if next_id is not None else int(totals["top"]) + 1
    placed = ranked(opened, "first_face")
    color = media.fallback_color(F.col("place") - len(free) + int(totals["used"]) + len(free))
    for k, c in reversed(list(enumerate(free))):
        color = F.when(F.col("place") == k, F.lit(c)).otherwise(color)
    name = F.concat(F.lit(C.AUTO_NAME_FORMAT.format("")), (F.col("place") + int(totals["n"]) + 1).cast("string"))
    made = runtime.materialize(placed.select("tentative", (F.col("place") + base).cast("bigint").alias("id"), name.alias("name"), color.alias("color")), "persons")
    return persons.select("id", "name", "color").union(made.select("id", "name", "color")), made.select("tentative", "id")


def _reassigned(faces: DataFrame, assigned: DataFrame, ids: DataFrame) -> DataFrame:
    """Faces with their new persons: pinned faces stay, faces that don't move stay as they are, moved ones lose their pin."""
    final = assigned.join(ids.withColumnRenamed("id", "made"), assigned["person_id"] == ids["tentative"], "left").select(F.col("face_id").alias("id"), F.coalesce("made", "person_id").alias("_new"))
    moved = F.col("_new").isNotNull() & ~F.coalesce(F.col("pinned"), F.lit(False)) & ~F.col("_new").eqNullSafe(F.col("person_id"))
    out = faces.join(final, "id", "left").withColumn("_moved", moved)
    out = out.withColumns({"person_id": F.when(F.col("_moved"), F.col("_new")).otherwise(F.col("person_id")), "pinned": F.when(F.col("_moved"), F.lit(False)).otherwise(F.col("pinned"))})
    return out.select(*faces.columns)


def regroup(faces: DataFrame, persons: DataFrame, threshold: float = C.COSINE_THRESHOLD) -> Regrouped:
    """Recluster all faces, keep ids stable, open persons for new clusters and drop automatic ones that end up empty."""
    from kinfold.operators.gallery import auto_named_empty

    assigned = runtime.materialize(stabilize(faces, recluster(faces, threshold)), "stable")
    every, ids = with_new_persons(persons, assigned)
    # Whoever takes the faces without their vectors doesn't move these.
    moved = _reassigned(faces, assigned, ids)
    gone = auto_named_empty(every, moved).select("id")
    return Regrouped(moved, every.join(gone, "id", "left_anti"))


def apply_greedy(faces: DataFrame, persons: DataFrame, new_ids: DataFrame, threshold: float = C.COSINE_THRESHOLD) -> Regrouped:
    """Assign the faces in ``new_ids`` (id) against all others and open persons where none is near."""
    fresh = faces.join(new_ids, "id", "left_semi").where(~F.coalesce(F.col("pinned"), F.lit(False)))
    known = faces.join(new_ids, "id", "left_anti").union(faces.join(new_ids, "id", "left_semi").where(F.coalesce(F.col("pinned"), F.lit(False))))
    assigned = runtime.materialize(greedy_assign(fresh, known, threshold), "greedy")
    every, ids = with_new_persons(persons, assigned)
    return Regrouped(_reassigned(faces, assigned, ids), every)


def quality(assignment: DataFrame, truth: DataFrame) -> DataFrame:
    """Purity and completeness of (face_id, cluster_id) against (face_id, label), and whether the partitions are equal."""
    both = assignment.join(truth, "face_id").groupBy("cluster_id", "label").agg(F.count("*").alias("n"))
    share = lambda key: both.groupBy(key).agg(F.max("n").alias("m"), F.sum("n").alias("t"), F.count("*").alias("k")).agg((F.sum("m") / F.sum("t")).alias(f"{key}_share"), F.max("k").alias(f"{key}_parts"))
    return share("cluster_id").crossJoin(share("label")).select(
        F.col("cluster_id_share").alias("purity"), F.col("label_share").alias("completeness"), ((F.col("cluster_id_parts") == 1) & (F.col("label_parts") == 1)).alias("same_partition")
    )
