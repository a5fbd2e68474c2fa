"""Connected components of an edge table, for any size of graph and any degree of a node.

Rounds of contraction: each node joins the neighbour that comes first in a random order of that round,
edges are moved to the joined nodes, and the map of the round is kept. A random order leaves at most
two thirds of the nodes in expectation, so the number of rounds is logarithmic, a chain included. The
minimum over neighbours is an aggregate with partial sums, so a hub with many links is no hot group;
the joins that move edges may be skewed by a hub and are left to adaptive skew handling. When at most
``finish_edges`` edges are left, one task of that bounded size completes the forest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold import runtime

#: Edges that one task holds if nothing else is said.
FINISH_EDGES = 250_000


def union_find(pairs) -> dict[int, int]:
    """Each node of the pairs, with the smallest node of its component."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def smallest_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the pairs (a, b), and for each the smallest node of its component: that of ``union_find``, for all pairs at once.

    Each root goes to the smallest root that it has a pair with, and then all nodes to the root of their root.
    """
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.split(at, 2)
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(root, high, low)
        while not np.array_equal(up := root[root], root):
            root = up
        x, y = root[low], root[high]
        apart = x != y
        x, y = x[apart], y[apart]
    return nodes, nodes[root]


def _finish(edges: DataFrame) -> DataFrame:
    import pyarrow as pa

    def forest(batches):
        ends = [(np.asarray(batch.column(0)), np.asarray(batch.column(1))) for batch in batches]
        nodes, roots = smallest_of(*(np.concatenate(x) for x in zip(*ends, strict=True))) if ends else (np.zeros(0, dtype=np.int64),) * 2
        moved = nodes != roots
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(roots[moved])], names=["node", "root"])

    return edges.coalesce(1).mapInArrow(forest, "node bigint, root bigint")


def connected_components(edges: DataFrame, finish_edges: int = FINISH_EDGES, clean: bool = False) -> DataFrame:
    """(node, root) for every node of the edges (a bigint, b bigint), the root being a node of the component.

    Nodes that are their own root are left out: a left join fills them in. Null ends, loops and
    repeated edges are ignored. Which node is the root is not promised; take a minimum over members.
    ``clean`` says that the edges lie materialized and hold none of these, so they are not written again.
    """
    runtime.ship_package(edges.sparkSession)
    maps: list[DataFrame] = []
    left = edges.select("a", "b") if clean else runtime.materialize(edges.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", narrow=8)
    while (n := left.count()) > finish_edges:
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(maps)), F.col(c)).alias("r"), F.col(c).alias("v"))
        both = left.select("a", "b").union(left.select("b", "a"))
        first = both.groupBy(F.col("a").alias("node")).agg(F.min(F.least(rank("a"), rank("b")))["v"].alias("root"))
        step = runtime.materialize(first.where("node <> root"), "step", narrow=4)
        moved = left.join(step.withColumnsRenamed({"node": "a", "root": "ra"}), "a", "left").join(step.withColumnsRenamed({"node": "b", "root": "rb"}), "b", "left")
        moved = moved.select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y")).where("x <> y")
        left = runtime.materialize(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        maps.append(step)
    total = _finish(left) if n else left.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    for step in reversed(maps):
        # A node of an earlier round goes where its target went later; targets that stayed keep their name.
        later = total.select(F.col("node").alias("root"), F.col("root").alias("top"))
        total = total.union(step.join(later, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
    # A node that was a target and moved in the same round stands twice, with the same root.
    return total.where("node <> root").distinct()
