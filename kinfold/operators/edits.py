"""Edits of the library as functions from tables to tables; the store publishes all results of one edit at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.media import user_text


def delete_photo_faces(faces: DataFrame, photo_id: int) -> DataFrame:
    return faces.where(F.col("photo_id") != photo_id)


def add_faces(faces: DataFrame, rows: DataFrame, next_id: int) -> DataFrame:
    """Insert faces; rows lack ids and get the next ones in the order of (photo_id, x, y)."""
    from kinfold.operators.ranking import ranked

    named = ranked(rows.withColumn("_order", F.struct("photo_id", "x", "y")), "_order").withColumn("id", (F.col("place") + next_id).cast("bigint"))
    return faces.unionByName(named.select(*faces.columns))


def set_face_person(faces: DataFrame, face_id: int, person_id: int | None, pinned: bool = True) -> DataFrame:
    """Put a face to a person; a manual assignment pins it."""
    here = F.col("id") == face_id
    return faces.withColumns({"person_id": F.when(here, F.lit(person_id).cast("bigint")).otherwise(F.col("person_id")), "pinned": F.when(here, F.lit(pinned)).otherwise(F.col("pinned"))})


def delete_face(faces: DataFrame, face_id: int) -> DataFrame:
    return faces.where(F.col("id") != face_id)


def create_person(persons: DataFrame, person_id: int, name: str, color: str) -> DataFrame:
    made = persons.sparkSession.createDataFrame([(person_id, name, color)], "id bigint, name string, color string")
    return persons.unionByName(made)


def rename_person(persons: DataFrame, person_id: int, name: str) -> DataFrame:
    """A blank name is ignored; names need not be unique and renaming pins nothing."""
    return persons.withColumn("name", F.when(F.col("id") == person_id, F.coalesce(user_text(F.lit(name)), F.col("name"))).otherwise(F.col("name")))


def merge_persons(persons: DataFrame, faces: DataFrame, source: int, target: int) -> tuple[DataFrame, DataFrame]:
    """All faces of ``source`` go to ``target``, pins as they are, and ``source`` is gone."""
    if source == target:
        raise ValueError("a person can't be merged with itself")
    moved = faces.withColumn("person_id", F.when(F.col("person_id") == source, F.lit(target).cast("bigint")).otherwise(F.col("person_id")))
    return persons.where(F.col("id") != source), moved


def delete_person(persons: DataFrame, faces: DataFrame, person_id: int) -> tuple[DataFrame, DataFrame]:
    """The person's faces become unassigned and lose their pins."""
    here = F.coalesce(F.col("person_id") == person_id, F.lit(False))
    freed = faces.withColumns({"pinned": F.when(here, F.lit(False)).otherwise(F.col("pinned")), "person_id": F.when(~here, F.col("person_id"))})
    return persons.where(F.col("id") != person_id), freed


def split_face(persons: DataFrame, faces: DataFrame, face_id: int, person_id: int, name: str) -> tuple[DataFrame, DataFrame]:
    """A face becomes a person of its own, pinned, in the next free colour."""
    from kinfold.operators.gallery import next_color

    color = next_color(persons).first()["color"]
    return create_person(persons, person_id, name, color), set_face_person(faces, face_id, person_id)


def get_or_create_tag(tags: DataFrame, name: str, next_id: int) -> DataFrame:
    """``tags`` with the trimmed name in it; a blank or known name adds nothing."""
    made = tags.sparkSession.range(1).select(F.lit(next_id).cast("bigint").alias("id"), user_text(F.lit(name)).alias("name")).where("name IS NOT NULL")
    return tags.unionByName(made.join(tags.select("name"), "name", "left_anti").select("id", "name"))


def tag_photo(tags: DataFrame, photo_tags: DataFrame, photo_id: int, name: str, next_id: int) -> tuple[DataFrame, DataFrame]:
    """Tag a photo; doing it twice is the same as once."""
    every = get_or_create_tag(tags, name, next_id)
    link = every.where(F.col("name") == user_text(F.lit(name))).select(F.lit(photo_id).cast("bigint").alias("photo_id"), F.col("id").alias("tag_id"))
    return every, photo_tags.unionByName(link).dropDuplicates(["photo_id", "tag_id"])


def untag_photo(photo_tags: DataFrame, photo_id: int, tag_id: int) -> DataFrame:
    """The tag itself stays, with one photo less."""
    return photo_tags.where(~((F.col("photo_id") == photo_id) & (F.col("tag_id") == tag_id)))


def delete_tag(tags: DataFrame, photo_tags: DataFrame, tag_id: int) -> tuple[DataFrame, DataFrame]:
    return tags.where(F.col("id") != tag_id), photo_tags.where(F.col("tag_id") != tag_id)
