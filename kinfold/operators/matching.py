"""Carrying pinned assignments over to re-detected faces by box overlap."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold import constants as C
from kinfold import runtime
from kinfold.functions import media

_BOX = ("x", "y", "w", "h")


def iou_candidates(faces: DataFrame, detections: DataFrame, least: float = C.MIN_IOU) -> DataFrame:
    """(photo_id, face_id, det_id, person_id, iou) of pinned faces with a person and detections of the same photo that overlap enough."""
    old = faces.where(F.col("pinned") & F.col("person_id").isNotNull()).select("photo_id", F.col("id").alias("face_id"), "person_id", *(F.col(c).alias(f"o_{c}") for c in _BOX))
    new = detections.select("photo_id", "det_id", *_BOX)
    share = media.iou(tuple(F.col(f"o_{c}") for c in _BOX), tuple(F.col(c) for c in _BOX))
    return old.join(new, "photo_id").withColumn("iou", share).where(F.col("iou") >= least).select("photo_id", "face_id", "det_id", "person_id", "iou")


def iou_match(faces: DataFrame, detections: DataFrame, least: float = C.MIN_IOU) -> DataFrame:
    """One-to-one matches within each photo, taken by falling overlap, then old face, then detection."""
    runtime.ship_package(faces.sparkSession)

    def match(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("iou", "descending"), ("face_id", "ascending"), ("det_id", "ascending")])
        faces_used, dets_used, keep = set(), set(), []
        for face, det in zip(rows.column("face_id").to_pylist(), rows.column("det_id").to_pylist(), strict=True):
            good = face not in faces_used and det not in dets_used
            keep.append(good)
            if good:
                faces_used.add(face)
                dets_used.add(det)
        return rows.filter(pa.array(keep, pa.bool_()))

    found = iou_candidates(faces, detections, least)
    return found.groupBy("photo_id").applyInArrow(match, found.schema)


def reanalyzed(faces: DataFrame, detections: DataFrame) -> DataFrame:
    """The detections as faces: matched ones inherit person and pin, the others have neither; unmatched pins are gone."""
    won = iou_match(faces, detections).select("det_id", "person_id")
    out = detections.join(won, "det_id", "left")
    return out.withColumn("pinned", F.col("person_id").isNotNull())
