"""Bringing the library in line with a folder listing: what is new, changed, unchanged and gone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.ranking import ranked

_KEPT = ("id", "path")


def classify(photos: DataFrame, scan: DataFrame) -> DataFrame:
    """(path, id, state) of every path on either side. Unchanged: same time and size, and analyzed before."""
    old = photos.select("path", "id", F.col("mtime").alias("old_mtime"), F.col("size").alias("old_size"), "analyzed_at")
    same = (F.col("mtime") == F.col("old_mtime")) & (F.col("size") == F.col("old_size")) & F.col("analyzed_at").isNotNull()
    state = F.when(F.col("mtime").isNull(), "gone").when(F.col("id").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return scan.select("path", "mtime", "size").join(old, "path", "full").select("path", "id", state.alias("state"))


def upsert(photos: DataFrame, rows: DataFrame, next_id: int | None = None) -> DataFrame:
    """``photos`` with ``rows`` (path and all other columns but id) put in: known paths keep their id, new ones get the next.

    ``next_id`` is the store's high-water mark, so that ids of deleted photos don't come back.
    """
    others = [c for c in photos.columns if c not in _KEPT]
    both = photos.select(*_KEPT, *(F.col(c).alias(f"_{c}") for c in others)).join(rows.select("path", F.lit(True).alias("_given"), *others), "path", "full")
    merged = both.select("id", "path", *(F.when(F.col("_given"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in others))
    base = next_id if next_id is not None else int(photos.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]) + 1
    fresh = ranked(merged.where("id IS NULL"), "path").withColumn("id", (F.col("place") + base).cast("bigint"))
    return merged.where("id IS NOT NULL").select(*photos.columns).union(fresh.select(*photos.columns))


def delete_missing(photos: DataFrame, scan: DataFrame, faces: DataFrame, photo_tags: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Photos, faces and photo tags without those of paths that the scan lacks. An empty scan empties the library."""
    kept = photos.join(scan.select("path").distinct(), "path", "left_semi").select(*photos.columns)
    ids = kept.select(F.col("id").alias("photo_id"))
    return kept, faces.join(ids, "photo_id", "left_semi").select(*faces.columns), photo_tags.join(ids, "photo_id", "left_semi").select(*photo_tags.columns)


def missing(photos: DataFrame, scan: DataFrame) -> DataFrame:
    """Photos whose path the scan lacks."""
    return photos.join(scan.select("path").distinct(), "path", "left_anti")
