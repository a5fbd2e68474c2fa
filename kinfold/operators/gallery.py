"""Browsing queries: filters with AND semantics, counts, display columns, order and navigation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold import constants as C
from kinfold.functions import media
from kinfold.operators.ranking import ranked
from kinfold.options import Options

_BOXES = "array<struct<x:double,y:double,w:double,h:double,color:string>>"


def having_all(links: DataFrame, key: str, value: str, wanted: Sequence[int]) -> DataFrame:
    """Keys that are linked with all wanted values: one aggregate, whatever their number."""
    distinct = sorted(set(wanted))
    return links.where(F.col(value).isin(distinct)).groupBy(key).agg(F.count_distinct(value).alias("n")).where(F.col("n") == len(distinct)).select(key)


def filtered_photos(photos: DataFrame, faces: DataFrame, photo_tags: DataFrame, person_ids: Sequence[int] = (), tag_ids: Sequence[int] = (), geotagged: bool = False) -> DataFrame:
    """Photos with all the persons and all the tags; no ids: no such filter."""
    out = photos
    if person_ids:
        out = out.join(having_all(faces, "photo_id", "person_id", person_ids).withColumnRenamed("photo_id", "id"), "id", "left_semi")
    if tag_ids:
        out = out.join(having_all(photo_tags, "photo_id", "tag_id", tag_ids).withColumnRenamed("photo_id", "id"), "id", "left_semi")
    if geotagged:
        out = out.where(F.col("exif_lat").isNotNull() & F.col("exif_lon").isNotNull())
    return out


def order_columns(order_by: str = "path") -> list[Column]:
    """Ascending with nulls last, by capture date for ``date`` and by path for all else; ties by id."""
    return [F.col("exif_date" if order_by == "date" else "path").asc_nulls_last(), F.col("id").asc()]


def with_rank(photos: DataFrame, order_by: str = "path") -> DataFrame:
    """``photos`` with their place in the order, from 0."""
    return ranked(photos, *order_columns(order_by), name="rank")


def photo_by_path(photos: DataFrame, path: str) -> DataFrame:
    """The photo with a path; paths are unique."""
    return photos.where(F.col("path") == path)


def faces_of_photo(faces: DataFrame, photo_id: int) -> DataFrame:
    return faces.where(F.col("photo_id") == photo_id)


def unpinned_faces(faces: DataFrame) -> DataFrame:
    return faces.where(~F.col("pinned"))


def cards(photos: DataFrame, faces: DataFrame, persons: DataFrame, photo_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """Photos with their faces (id, person_name, person_color, x, y, w, h) and tag names as arrays, ready to show.

    Faces and tags are gathered once for all photos, each photo's own being few.
    """
    shown = face_display(faces.select("id", "photo_id", "person_id", "x", "y", "w", "h"), persons)
    boxes = shown.groupBy(F.col("photo_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("id", "person_name", "person_color", "x", "y", "w", "h"))).alias("faces"))
    named = photo_tags.join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id")
    texts = named.groupBy(F.col("photo_id").alias("id")).agg(F.sort_array(F.collect_list("name")).alias("tags"))
    return photos.join(boxes, "id", "left").join(texts, "id", "left")


def gallery_view(photos: DataFrame, faces: DataFrame, persons: DataFrame, options: Options) -> DataFrame:
    """Photos as the owner's settings show them: place in the chosen order, size of the card, and the boxes of faces by id (x, y, w, h, color).

    Without face boxes there are none for any photo and faces are not read.
    """
    out = with_rank(photos, options.sort_order).withColumns(
        {"card_width": F.lit(C.CARD_WIDTH), "card_height": F.lit(C.CARD_HEIGHT_TALL if options.aspect == "3:4" else C.CARD_HEIGHT_WIDE)}
    )
    if not options.show_face_boxes:
        return out.withColumn("boxes", F.array().cast(_BOXES))
    shown = face_display(faces.select("id", "photo_id", "person_id", "x", "y", "w", "h"), persons)
    own = shown.groupBy(F.col("photo_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("id", "x", "y", "w", "h", F.col("person_color").alias("color")))).alias("own"))
    boxes = F.transform("own", lambda b: F.struct(b["x"].cast("double").alias("x"), b["y"].cast("double").alias("y"), b["w"].cast("double").alias("w"), b["h"].cast("double").alias("h"), b["color"].alias("color")))
    return out.join(own, "id", "left").withColumn("boxes", F.coalesce(boxes, F.array().cast(_BOXES))).drop("own")


def person_counts(persons: DataFrame, faces: DataFrame) -> DataFrame:
    """Each person with the number of their faces, 0 included; faces are counted before the join."""
    counts = faces.where(F.col("person_id").isNotNull()).groupBy(F.col("person_id").alias("id")).agg(F.count("*").alias("face_count"))
    out = persons.join(counts, "id", "left").withColumn("face_count", F.coalesce("face_count", F.lit(0)))
    return out.withColumn("list_label", F.concat("name", F.lit("  ("), F.col("face_count").cast("string"), F.lit(")")))


def tag_counts(tags: DataFrame, photo_tags: DataFrame) -> DataFrame:
    counts = photo_tags.groupBy(F.col("tag_id").alias("id")).agg(F.count("photo_id").alias("photo_count"))
    out = tags.join(counts, "id", "left").withColumn("photo_count", F.coalesce("photo_count", F.lit(0)))
    return out.withColumn("list_label", F.concat(F.lit("#"), F.col("name"), F.lit("  ("), F.col("photo_count").cast("string"), F.lit(")")))


def auto_named_empty(persons: DataFrame, faces: DataFrame) -> DataFrame:
    """Persons without faces that still have the name they were given automatically."""
    return person_counts(persons, faces).where((F.col("face_count") == 0) & F.col("name").rlike(C.AUTO_NAME))


def face_display(faces: DataFrame, persons: DataFrame) -> DataFrame:
    """Faces with the name and colour to show; a face without person has no name and the neutral colour."""
    named = persons.select(F.col("id").alias("person_id"), F.col("name").alias("person_name"), F.col("color").alias("person_color"))
    out = faces.join(named, "person_id", "left")
    return out.withColumns({"person_name": F.coalesce("person_name", F.lit("")), "person_color": F.coalesce("person_color", F.lit(C.UNASSIGNED_COLOR))})


def photo_caption(faces: DataFrame, persons: DataFrame) -> DataFrame:
    """The distinct names on each photo in the order of the faces, joined by comma and blank."""
    shown = face_display(faces.select("id", "photo_id", "person_id"), persons)
    first = shown.where("person_name <> ''").groupBy("photo_id", "person_name").agg(F.min("id").alias("first"))
    named = first.groupBy("photo_id").agg(F.sort_array(F.collect_list(F.struct("first", "person_name"))).alias("names"))
    caption = F.array_join(F.transform("names", lambda x: x["person_name"]), ", ")
    return faces.select("photo_id").distinct().join(named, "photo_id", "left").select("photo_id", F.coalesce(caption, F.lit("")).alias("caption"))


def photo_tag_names(photo_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """The tags of each photo by name, and the first few that are shown as dots with their colours."""
    named = photo_tags.join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id")
    all_names = named.groupBy("photo_id").agg(F.sort_array(F.collect_list("name")).alias("names"))
    dots = F.transform(F.slice("names", 1, C.TAG_DOTS), media.tag_color)
    return all_names.select("photo_id", F.array_join("names", ", ").alias("tag_names"), F.array_join(dots, ",").alias("tag_dots"))


def neighbours(photos: DataFrame, order_by: str = "path") -> DataFrame:
    """Each photo with those before and after it in the order, itself at the ends."""
    ranked = with_rank(photos.select("id", "path", "exif_date"), order_by).select("id", "rank")
    step = lambda k, name: ranked.select((F.col("rank") + k).alias("rank"), F.col("id").alias(name))
    out = ranked.join(step(1, "prev_id"), "rank", "left").join(step(-1, "next_id"), "rank", "left")
    return out.withColumns({"prev_id": F.coalesce("prev_id", "id"), "next_id": F.coalesce("next_id", "id")})


def grid_layout(photos: DataFrame, viewport_width: int, order_by: str = "path") -> DataFrame:
    """Row and column of each photo in a grid as wide as the viewport allows, one column at least."""
    columns = max(1, (viewport_width - 24) // 206)
    return with_rank(photos, order_by).withColumns({"grid_row": F.floor(F.col("rank") / columns), "grid_column": F.col("rank") % columns})


def moved_selection(rank: Column, step: Column, total: Column) -> Column:
    """A selection moved by a number of places, kept within the set."""
    return F.greatest(F.lit(0), F.least(rank + step, total - 1))


def with_moves(photos: DataFrame, step: Column, order_by: str = "path") -> DataFrame:
    """``photos`` with their place in the order, and the place that a move by ``step`` places from there leads to."""
    total = photos.agg(F.count("*").alias("_total"))
    return with_rank(photos, order_by).crossJoin(total).withColumn("moved_to", moved_selection(F.col("rank"), step, F.col("_total"))).drop("_total")


def start_index(photos: DataFrame, photo_id: int, order_by: str = "path") -> DataFrame:
    """The place of a photo in the order, counted from those before it without sorting; 0 if it isn't there."""
    key = F.col("exif_date" if order_by == "date" else "path")
    # A null comes after all values, so whether it is null comes first in the comparison.
    place = lambda name: F.struct(key.isNull().alias("none"), F.coalesce(key, F.lit("")).alias("key"), F.col("id")).alias(name)
    own = photos.where(F.col("id") == photo_id).agg(F.max(place("own")).alias("own"))
    return photos.select(place("place")).crossJoin(own).agg(F.count_if(F.col("place") < F.col("own")).alias("start_index"))


def kept_selection(photos: DataFrame, photo_id: int, order_by: str = "path") -> DataFrame:
    """The selected photo if it is still there, else the first of the order."""
    first = F.min_by("id", F.struct(F.col("exif_date" if order_by == "date" else "path").isNull(), F.col("exif_date" if order_by == "date" else "path"), F.col("id")))
    return photos.agg(F.coalesce(F.max(F.when(F.col("id") == photo_id, F.col("id"))), first).alias("selected_id"))


def by_name(rows: DataFrame) -> DataFrame:
    """Persons or tags with their place in the order of their names, equal names by id."""
    return ranked(rows, "name", "id")


def place_links(photos: DataFrame) -> DataFrame:
    """The full coordinates of geotagged photos as text and as the address of a map."""
    out = photos.where(F.col("exif_lat").isNotNull() & F.col("exif_lon").isNotNull())
    lat, lon = F.col("exif_lat"), F.col("exif_lon")
    return out.select("id", media.full_coordinates(lat, lon).alias("coordinates"), media.map_url(lat, lon).alias("map_url"))


def place_text(photos: DataFrame) -> DataFrame:
    """Title and coordinate texts of geotagged photos."""
    out = photos.where(F.col("exif_lat").isNotNull() & F.col("exif_lon").isNotNull())
    lat, lon = F.col("exif_lat"), F.col("exif_lon")
    return out.select("id", media.basename(F.col("path")).alias("title"), media.coordinates_text(lat, lon).alias("place"))


def next_color(persons: DataFrame) -> DataFrame:
    """The first palette colour that no person has; once all are taken, one from the number of colours in use."""
    spark = persons.sparkSession
    palette = spark.createDataFrame(list(enumerate(C.PERSON_PALETTE)), "pos int, color string")
    free = palette.join(persons.select("color").distinct(), "color", "left_anti").agg(F.min_by("color", "pos").alias("free"))
    used = persons.agg(F.count_distinct("color").alias("used"))
    return free.crossJoin(used).select(F.coalesce("free", media.fallback_color(F.col("used"))).alias("color"))


def others(persons: DataFrame, person_id: int) -> DataFrame:
    """The persons that one can be merged with, or a face moved to."""
    return persons.where(F.col("id") != person_id)
