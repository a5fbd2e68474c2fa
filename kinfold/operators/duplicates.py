"""Near-duplicate photos by perceptual hash: exact Hamming join by partitions of the bits, then connected components."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold import constants as C
from kinfold.functions import media
from kinfold.operators.components import connected_components


def _hashes(photos: DataFrame) -> DataFrame:
    return photos.where(media.usable_hash(F.col("phash"))).select("id", "path", media.hash_bits(F.col("phash")).alias("h"))


def thresholds(n: int, max_distance: int) -> list[int]:
    """How many differing bits each partition of the 64 allows, of least cost for ``n`` distinct hashes.

    The thresholds plus one add up to the distance plus one, so two hashes within the distance agree up to the threshold in one partition at
    least. A hash is sent once for every value within the threshold; one more costs a row, and each other hash that blind
    chance brings to a bucket a comparison. Few hashes want many narrow partitions, many hashes few wide ones.
    """
    best: tuple[float, list[int]] | None = None
    for parts in range(2, max_distance + 2):
        more, rest = divmod(max_distance + 1 - parts, parts)
        chosen = [more + (k < rest) for k in range(parts)]
        widths = [64 * (k + 1) // parts - 64 * k // parts for k in range(parts)]
        rows = [sum(comb(w, d) for d in range(t + 1)) for w, t in zip(widths, chosen, strict=True)]
        cost = sum(r * (20 + n * 2.0**-w) for r, w in zip(rows, widths, strict=True))
        if best is None or cost < best[0]:
            best = cost, chosen
    return best[1] if best else [max_distance]


def _near(hashes: DataFrame, max_distance: int) -> DataFrame:
    """(a, b, distance), a < b, of distinct hashes ``h`` that differ in at most ``max_distance`` bits.

    One side is sent under its own value of each partition, the other under all values within the partition's threshold, so they
    meet in an equi-join; a pair is kept where its first partition within the threshold is the one it met in, so none comes twice.
    """
    allowed = thresholds(hashes.count(), max_distance)
    parts = len(allowed)
    cuts = [64 * k // parts for k in range(parts + 1)]
    mask = lambda k: F.lit((1 << (cuts[k + 1] - cuts[k])) - 1)
    value = lambda h, k: F.shiftrightunsigned(h, cuts[k]).bitwiseAND(mask(k)) if parts > 1 else h
    flips = lambda k: [sum(1 << b for b in chosen) for d in range(allowed[k] + 1) for chosen in combinations(range(cuts[k + 1] - cuts[k]), d)]
    struct = lambda k, bits: F.struct(F.lit(k).alias("part"), bits.alias("bits"))
    own = F.array(*(struct(k, value(F.col("h"), k)) for k in range(parts)))
    # A function of two parameters would get the place in the array as the second.
    flipped = lambda k: lambda f: struct(k, value(F.col("h"), k).bitwiseXOR(f))
    wide = F.flatten(F.array(*(F.transform(F.array(*(F.lit(f).cast("bigint") for f in flips(k))), flipped(k)) for k in range(parts))))
    a, b = (hashes.select("h", F.explode(x).alias("x")).select("h", "x.*").alias(name) for name, x in (("a", own), ("b", wide)))
    same = (F.col("a.part") == F.col("b.part")) & (F.col("a.bits") == F.col("b.bits")) & (F.col("a.h") < F.col("b.h"))
    distance = media.hamming(F.col("a.h"), F.col("b.h"))
    apart = F.col("a.h").bitwiseXOR(F.col("b.h"))
    first = F.least(*(F.when(F.bit_count(value(apart, k)) <= allowed[k], F.lit(k)) for k in range(parts)), F.lit(None)) if parts > 1 else F.lit(0)
    return a.join(b, same & (distance <= max_distance) & (first == F.col("a.part"))).select(F.col("a.h").alias("a"), F.col("b.h").alias("b"), distance.alias("distance"))


def duplicate_pairs(photos: DataFrame, max_distance: int = C.MAX_HAMMING) -> DataFrame:
    """(id_a, id_b, distance), id_a < id_b, of all photos whose usable hashes are near.

    That is one row for every pair, also for all pairs of photos with one hash; ``duplicate_groups`` makes no pairs of equal hashes.
    """
    own = _hashes(photos)
    near = _near(own.select("h").distinct(), max_distance)
    both = near.union(near.select("b", "a", "distance"))
    left, right = own.select(F.col("id").alias("id_a"), F.col("h").alias("a")), own.select(F.col("id").alias("id_b"), F.col("h").alias("b"))
    differing = left.join(both, "a").join(right, "b").where("id_a < id_b").select("id_a", "id_b", "distance")
    equal = left.join(right, F.col("a") == F.col("b")).where("id_a < id_b").select("id_a", "id_b", F.lit(0).alias("distance"))
    return differing.union(equal)


def duplicate_groups(photos: DataFrame, max_distance: int = C.MAX_HAMMING) -> DataFrame:
    """(photo_id, path, group_id) of photos in groups of two and more, chains included; the group's name is its smallest id.

    Equal hashes count once until the end, so a hash that many photos share makes no pairs.
    """
    own = _hashes(photos)
    nodes = own.groupBy("h").agg(F.min("id").alias("least"))
    roots = connected_components(_near(nodes.select("h"), max_distance).select("a", "b")).withColumnRenamed("node", "h")
    rooted = nodes.join(roots, "h", "left").select("h", "least", F.coalesce("root", "h").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("group_id"))
    members = own.join(rooted.join(named, "root").select("h", "group_id"), "h").select(F.col("id").alias("photo_id"), "path", "group_id")
    big = members.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").select("group_id")
    return members.join(big, "group_id", "left_semi").select("photo_id", "path", "group_id")


def group_listing(groups: DataFrame) -> DataFrame:
    """One row for each group: its size, smallest path and members in the order of paths."""
    return groups.groupBy("group_id").agg(F.count("*").alias("size"), F.min("path").alias("first_path"), F.array_join(F.sort_array(F.collect_list("path")), "|").alias("paths"))


def only_duplicates(photos: DataFrame, groups: DataFrame) -> DataFrame:
    """The photos that are in some group."""
    return photos.join(groups.select(F.col("photo_id").alias("id")).distinct(), "id", "left_semi")
