"""All queries over the engine's own operators, and the SQL that DuckDB checks them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold import constants as C
from kinfold.functions import exif, media
from kinfold.operators import clustering, duplicates, edits, gallery, matching, similarity, sync
from kinfold.options import Options
from kinfold.plans.views import view, with_views
from kinfold.streaming import debounce

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracle: dict[str, str] = {}


def _named(sql: str = "", *views: str):
    """Registers a query under its function's name; ``sql`` is checked over the named views."""

    def put(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _oracle[f.__name__] = with_views(sql, *views)
        return f

    return put


# -- gallery -------------------------------------------------------------------------------------------------


@_named("SELECT id, path, row_number() OVER (ORDER BY path IS NULL, path, id) - 1 AS rank FROM photos", "photos")
def gallery_all_by_path(spark, d):
    return gallery.with_rank(view(spark, d, "photos").select("id", "path", "exif_date")).select("id", "path", "rank")


@_named("SELECT id, exif_date, row_number() OVER (ORDER BY exif_date IS NULL, exif_date, id) - 1 AS rank FROM photos", "photos")
def gallery_by_date(spark, d):
    return gallery.with_rank(view(spark, d, "photos").select("id", "path", "exif_date"), "date").select("id", "exif_date", "rank")


def _filtered(spark, d, persons=(), tags=(), geo=False):
    return gallery.filtered_photos(view(spark, d, "photos"), view(spark, d, "faces"), view(spark, d, "photo_tags"), persons, tags, geo)


@_named("SELECT DISTINCT p.id, p.path FROM photos p JOIN faces f1 ON f1.photo_id = p.id AND f1.person_id = 1 JOIN faces f2 ON f2.photo_id = p.id AND f2.person_id = 2", "photos", "faces")
def gallery_person_and(spark, d):
    return _filtered(spark, d, persons=[1, 2, 2]).select("id", "path")


@_named("SELECT DISTINCT p.id, p.path FROM photos p JOIN photo_tags a ON a.photo_id = p.id AND a.tag_id = 3 JOIN photo_tags b ON b.photo_id = p.id AND b.tag_id = 11", "photos", "photo_tags")
def gallery_tag_and(spark, d):
    return _filtered(spark, d, tags=[3, 11]).select("id", "path")


@_named(
    "SELECT id, path, exif_date, row_number() OVER (ORDER BY exif_date IS NULL, exif_date, id) - 1 AS rank FROM (SELECT DISTINCT p.* FROM photos p JOIN faces f ON f.photo_id = p.id AND f.person_id = 5 "
    "JOIN photo_tags t ON t.photo_id = p.id AND t.tag_id = 11 WHERE p.exif_lat IS NOT NULL AND p.exif_lon IS NOT NULL)",
    "photos", "faces", "photo_tags",
)
def gallery_person_tag_geo(spark, d):
    return gallery.with_rank(_filtered(spark, d, [5], [11], True), "date").select("id", "path", "exif_date", "rank")


@_named("SELECT id, path, size FROM photos WHERE path = '/lib/src3/IMG_000003.jpg'", "photos")
def photo_by_path(spark, d):
    return gallery.photo_by_path(view(spark, d, "photos"), "/lib/src3/IMG_000003.jpg").select("id", "path", "size")


@_named("SELECT id, person_id, confidence FROM faces WHERE photo_id = 17", "faces")
def faces_of_photo(spark, d):
    return gallery.faces_of_photo(view(spark, d, "faces"), 17).select("id", "person_id", "confidence")


@_named("SELECT id, photo_id FROM faces WHERE NOT pinned", "faces")
def unpinned_faces(spark, d):
    return gallery.unpinned_faces(view(spark, d, "faces")).select("id", "photo_id")


@_named(
    "SELECT p.id, coalesce(f.n, 0) AS face_count, coalesce(f.names, '') AS face_names, coalesce(t.names, '') AS tag_names FROM photos p "
    "LEFT JOIN (SELECT f.photo_id, count(*) AS n, string_agg(coalesce(name, ''), '|' ORDER BY f.id) AS names FROM faces f LEFT JOIN persons q ON q.id = f.person_id GROUP BY f.photo_id) f ON f.photo_id = p.id "
    "LEFT JOIN (SELECT photo_id, string_agg(name, '|' ORDER BY name) AS names FROM photo_tags l JOIN tags g ON g.id = l.tag_id GROUP BY photo_id) t ON t.photo_id = p.id",
    "photos", "faces", "persons", "photo_tags", "tags",
)
def gallery_cards(spark, d):
    shown = gallery.cards(*(view(spark, d, n) for n in ("photos", "faces", "persons", "photo_tags", "tags")))
    names = F.array_join(F.transform("faces", lambda f: f["person_name"]), "|")
    return shown.select("id", F.greatest(F.coalesce(F.size("faces"), F.lit(0)), F.lit(0)).cast("bigint").alias("face_count"), F.coalesce(names, F.lit("")).alias("face_names"), F.coalesce(F.array_join("tags", "|"), F.lit("")).alias("tag_names"))


@_named(
    "SELECT p.id, row_number() OVER (ORDER BY p.exif_date IS NULL, p.exif_date, p.id) - 1 AS rank, 190 AS card_width, 210 AS card_height, coalesce(f.n, 0) AS n_boxes, coalesce(f.colors, '') AS box_colors "
    "FROM photos p LEFT JOIN (SELECT f.photo_id, count(*) AS n, string_agg(coalesce(q.color, '#888888'), ',' ORDER BY f.id) AS colors FROM faces f LEFT JOIN persons q ON q.id = f.person_id GROUP BY f.photo_id) f ON f.photo_id = p.id",
    "photos", "faces", "persons",
)
def gallery_by_settings(spark, d):
    shown = gallery.gallery_view(*(view(spark, d, n) for n in ("photos", "faces", "persons")), Options(sort_order="date", aspect="4:3"))
    colors = F.array_join(F.transform("boxes", lambda b: b["color"]), ",")
    return shown.select("id", "rank", "card_width", "card_height", F.size("boxes").cast("bigint").alias("n_boxes"), colors.alias("box_colors"))


@_named("SELECT id, path FROM photos WHERE path NOT IN (SELECT path FROM scan)", "photos", "scan")
def missing_photos(spark, d):
    return sync.missing(view(spark, d, "photos"), view(spark, d, "scan")).select("id", "path")


@_named("SELECT p.id, p.name, p.color, count(f.id) AS face_count, p.name || '  (' || cast(count(f.id) AS VARCHAR) || ')' AS list_label FROM persons p LEFT JOIN faces f ON f.person_id = p.id GROUP BY p.id, p.name, p.color", "persons", "faces")
def person_face_counts(spark, d):
    return gallery.person_counts(view(spark, d, "persons"), view(spark, d, "faces"))


@_named("SELECT t.id, t.name, count(pt.photo_id) AS photo_count, '#' || t.name || '  (' || cast(count(pt.photo_id) AS VARCHAR) || ')' AS list_label FROM tags t LEFT JOIN photo_tags pt ON pt.tag_id = t.id GROUP BY t.id, t.name", "tags", "photo_tags")
def tag_photo_counts(spark, d):
    return gallery.tag_counts(view(spark, d, "tags"), view(spark, d, "photo_tags"))


@_named("SELECT p.id, p.name FROM persons p LEFT JOIN faces f ON f.person_id = p.id WHERE regexp_full_match(p.name, 'Persona [0-9]+') GROUP BY p.id, p.name HAVING count(f.id) = 0", "persons", "faces")
def auto_named_empty(spark, d):
    return gallery.auto_named_empty(view(spark, d, "persons"), view(spark, d, "faces")).select("id", "name")


@_named("SELECT f.id, f.photo_id, f.person_id, coalesce(p.name, '') AS person_name, coalesce(p.color, '#888888') AS person_color FROM faces f LEFT JOIN persons p ON p.id = f.person_id", "faces", "persons")
def face_display(spark, d):
    return gallery.face_display(view(spark, d, "faces"), view(spark, d, "persons")).select("id", "photo_id", "person_id", "person_name", "person_color")


@_named(
    "SELECT photo_id, coalesce(string_agg(name, ', ' ORDER BY first) FILTER (WHERE name IS NOT NULL), '') AS caption FROM (SELECT f.photo_id, p.name, min(f.id) AS first FROM faces f LEFT JOIN persons p ON p.id = f.person_id GROUP BY f.photo_id, p.name) GROUP BY photo_id",
    "faces", "persons",
)
def photo_caption(spark, d):
    return gallery.photo_caption(view(spark, d, "faces"), view(spark, d, "persons"))


@_named("SELECT id, rank, coalesce(lag(id) OVER (ORDER BY rank), id) AS prev_id, coalesce(lead(id) OVER (ORDER BY rank), id) AS next_id FROM (SELECT id, row_number() OVER (ORDER BY exif_date IS NULL, exif_date, id) - 1 AS rank FROM photos)", "photos")
def photo_nav(spark, d):
    return gallery.neighbours(view(spark, d, "photos"), "date").select("id", "rank", "prev_id", "next_id")


@_named("SELECT id, rank // 4 AS grid_row, rank % 4 AS grid_column FROM (SELECT id, row_number() OVER (ORDER BY path, id) - 1 AS rank FROM photos)", "photos")
def grid_layout(spark, d):
    return gallery.grid_layout(view(spark, d, "photos").select("id", "path", "exif_date"), 860).select("id", "grid_row", "grid_column")


@_named("SELECT row_number - 1 AS start_index FROM (SELECT id, row_number() OVER (ORDER BY path, id) AS row_number FROM photos) WHERE id = 77", "photos")
def start_index(spark, d):
    return gallery.start_index(view(spark, d, "photos").select("id", "path", "exif_date"), 77)


@_named("SELECT id AS selected_id FROM photos ORDER BY path, id LIMIT 1", "photos")
def kept_selection(spark, d):
    return gallery.kept_selection(view(spark, d, "photos"), -5)


@_named("SELECT id, list_last(string_split(path, '/')) AS title, printf('%.5f, %.5f', exif_lat, exif_lon) AS place FROM photos WHERE exif_lat IS NOT NULL AND exif_lon IS NOT NULL", "photos")
def place_text(spark, d):
    return gallery.place_text(view(spark, d, "photos"))


@_named("SELECT photo_id, string_agg(t.name, ', ' ORDER BY t.name) AS tag_names FROM photo_tags p JOIN tags t ON t.id = p.tag_id GROUP BY photo_id", "photo_tags", "tags")
def photo_tag_names(spark, d):
    return gallery.photo_tag_names(view(spark, d, "photo_tags"), view(spark, d, "tags")).select("photo_id", "tag_names")


@_named(
    "SELECT color FROM (SELECT unnest(['" + "', '".join(C.PERSON_PALETTE) + "']) AS color, unnest(range(0, 18)) AS pos) WHERE color NOT IN (SELECT color FROM persons) ORDER BY pos LIMIT 1", "persons"
)
def next_color(spark, d):
    return gallery.next_color(view(spark, d, "persons"))


@_named("SELECT id, name, cast(list_reduce([0] || list_transform(string_split(sha1(name), ''), lambda c: strpos('0123456789abcdef', c) - 1), lambda a, x: (a * 16 + x) % 360) AS BIGINT) AS hue FROM tags", "tags")
def tag_hue(spark, d):
    return view(spark, d, "tags").select("id", "name", media.tag_hue(F.col("name")).cast("bigint").alias("hue"))


@_named("SELECT id, name FROM persons WHERE id <> 4 ", "persons")
def merge_choices(spark, d):
    return gallery.others(view(spark, d, "persons"), 4).select("id", "name")


@_named("SELECT id, person_id, sha1(path || ':' || cast(cast(mtime AS BIGINT) AS VARCHAR) || '.0:480') AS cache_key FROM (SELECT p.*, f.person_id FROM photos p JOIN faces f ON f.photo_id = p.id)", "photos", "faces")
def thumbnail_keys(spark, d):
    shown = view(spark, d, "photos").select("id", "path", "mtime").join(view(spark, d, "faces").select(F.col("photo_id").alias("id"), "person_id"), "id")
    # Whole seconds print as Python prints them.
    text = F.concat(F.col("mtime").cast("bigint").cast("string"), F.lit(".0"))
    return shown.select("id", "person_id", media.thumbnail_key(F.col("path"), text, C.THUMBNAIL_SIDE).alias("cache_key"))


@_named("SELECT f.id, round(f.x * 480 / p.width, 6) AS x, round(f.y * 480 / p.height, 6) AS y FROM faces f JOIN photos p ON p.id = f.photo_id", "faces", "photos")
def thumbnail_boxes(spark, d):
    sized = view(spark, d, "photos").select(F.col("id").alias("photo_id"), "width", "height")
    rows = view(spark, d, "faces").select("id", "photo_id", "x", "y").join(sized, "photo_id")
    shown = lambda c, side: F.round(media.rescale(F.col(c), F.col(side).cast("double"), F.lit(480.0)), 6).alias(c)
    return rows.select("id", shown("x", "width"), shown("y", "height"))


# -- duplicates ----------------------------------------------------------------------------------------------

_PAIRS = (
    "pairs AS (SELECT a.id AS id_a, b.id AS id_b, bit_count(xor(cast('0x' || a.phash AS UBIGINT), cast('0x' || b.phash AS UBIGINT))) AS distance FROM photos a JOIN photos b ON a.id < b.id "
    "WHERE a.phash <> '0000000000000000' AND b.phash <> '0000000000000000' AND bit_count(xor(cast('0x' || a.phash AS UBIGINT), cast('0x' || b.phash AS UBIGINT))) <= 4)"
)
_GROUPS = (
    _PAIRS + ", walk AS (SELECT id_a AS id, id_b AS seen FROM pairs UNION SELECT id_b, id_a FROM pairs UNION SELECT w.id, CASE WHEN p.id_a = w.seen THEN p.id_b ELSE p.id_a END FROM walk w JOIN pairs p ON p.id_a = w.seen OR p.id_b = w.seen), "
    "groups AS (SELECT id AS photo_id, least(id, min(seen)) AS group_id FROM walk GROUP BY id)"
)


def _with(ctes: str, select: str) -> str:
    return f"{ctes}\n{select}"


def _pairs_oracle(select: str, ctes: str, *views: str) -> str:
    """A query after further common table expressions; ``with_views`` ends its own with a comma."""
    return with_views(_with(ctes, select), *views)


@_named()
def dup_pairs(spark, d):
    return duplicates.duplicate_pairs(view(spark, d, "photos")).select("id_a", "id_b", F.col("distance").cast("int").alias("distance"))


@_named()
def dup_groups(spark, d):
    return duplicates.group_listing(duplicates.duplicate_groups(view(spark, d, "photos")))


@_named()
def gallery_duplicates(spark, d):
    photos = view(spark, d, "photos")
    return duplicates.only_duplicates(photos, duplicates.duplicate_groups(photos)).select("id", "path")


# -- metadata ------------------------------------------------------------------------------------------------


@_named(
    r"SELECT photo_id, strftime(try_strptime(regexp_extract(dt, '^\s*(\d{4}:\d{2}:\d{2}[ T]\d{2}:\d{2}:\d{2})', 1).replace('T', ' '), '%Y:%m:%d %H:%M:%S'), '%Y-%m-%dT%H:%M:%S') AS exif_date FROM exif_raw WHERE dt NOT LIKE '0000%' "
    "UNION ALL SELECT photo_id, NULL FROM exif_raw WHERE dt IS NULL OR dt LIKE '0000%'",
    "exif_raw",
)
def exif_dates(spark, d):
    return view(spark, d, "exif_raw").select("photo_id", exif.capture_date(F.col("dt")).alias("exif_date"))


@_named(
    "SELECT photo_id, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL AND abs(lat) <= 90 AND abs(lon) <= 180 AND NOT (lat = 0 AND lon = 0) THEN round(lat, 6) END AS lat, "
    "CASE WHEN lat IS NOT NULL AND lon IS NOT NULL AND abs(lat) <= 90 AND abs(lon) <= 180 AND NOT (lat = 0 AND lon = 0) THEN round(lon, 6) END AS lon FROM (SELECT photo_id, "
    "CASE WHEN lat_m < 60 AND lat_s < 60 THEN CASE upper(trim(lat_ref))[1] WHEN 'N' THEN lat_d + lat_m / 60 + lat_s / 3600 WHEN 'S' THEN -(lat_d + lat_m / 60 + lat_s / 3600) END END AS lat, "
    "CASE WHEN lon_m < 60 AND lon_s < 60 THEN CASE upper(trim(lon_ref))[1] WHEN 'E' THEN lon_d + lon_m / 60 + lon_s / 3600 WHEN 'W' THEN -(lon_d + lon_m / 60 + lon_s / 3600) END END AS lon FROM exif_raw)",
    "exif_raw",
)
def exif_gps(spark, d):
    rows = view(spark, d, "exif_raw")
    lat = exif.dms_to_decimal(F.array("lat_d", "lat_m", "lat_s"), F.col("lat_ref"), "N", "S")
    lon = exif.dms_to_decimal(F.array("lon_d", "lon_m", "lon_s"), F.col("lon_ref"), "E", "W")
    place = exif.gps(lat, lon)
    return rows.select("photo_id", F.round(place["lat"], 6).alias("lat"), F.round(place["lon"], 6).alias("lon"))


# -- similarity and clustering -------------------------------------------------------------------------------

_SIM = "list_cosine_similarity(cast(a.embedding AS DOUBLE[]), cast(b.embedding AS DOUBLE[]))"


@_named(f"SELECT a.id AS a, b.id AS b, round({_SIM}, 6) AS sim FROM faces a JOIN faces b ON a.id < b.id WHERE {_SIM} >= 0.363", "faces")
def cosine_pairs(spark, d):
    return similarity.cosine_pairs(view(spark, d, "faces").select("id", "embedding")).select("a", "b", F.round("sim", 6).alias("sim"))


@_named("SELECT person_id, pos, round(avg(x), 6) AS mean FROM (SELECT person_id, cast(unnest(embedding) AS DOUBLE) AS x, cast(unnest(range(0, len(embedding))) AS INTEGER) AS pos FROM faces WHERE person_id IS NOT NULL) GROUP BY person_id, pos", "faces")
def person_centroids(spark, d):
    means = similarity.person_means(view(spark, d, "faces").select("person_id", "embedding"))
    return means.select("person_id", F.posexplode("mean").alias("pos", "x")).select("person_id", "pos", F.round("x", 6).alias("mean"))


@_named()
def nearest_person(spark, d):
    faces = view(spark, d, "faces")
    near = similarity.nearest_person(faces.where("person_id IS NULL").select("id", "embedding"), similarity.person_means(faces.select("person_id", "embedding")), 0.2)
    return near.select("id", "near_id", F.round("sim", 6).alias("sim"))


@_named()
def threshold_components(spark, d):
    from kinfold.operators.components import connected_components

    faces = view(spark, d, "faces").select("id", "embedding")
    roots = connected_components(similarity.cosine_pairs(faces).select("a", "b")).withColumnRenamed("node", "id")
    rooted = faces.select("id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = rooted.groupBy("root").agg(F.min("id").alias("component"))
    return rooted.join(named, "root").select("id", "component")


def _faces(spark, d):
    return view(spark, d, "faces").select("id", "person_id", "pinned", "embedding", "photo_id")


@_named()
def recluster_pairs(spark, d):
    return clustering.recluster(_faces(spark, d), 0.45)


@_named()
def recluster_full(spark, d):
    return clustering.recluster(_faces(spark, d))


@_named()
def stabilized(spark, d):
    faces = _faces(spark, d)
    return clustering.stabilize(faces, clustering.recluster(faces, 0.45))


@_named()
def regrouped_persons(spark, d):
    done = clustering.regroup(_faces(spark, d), view(spark, d, "persons"), 0.45)
    return gallery.person_counts(done.persons, done.faces).select("id", "name", "color", "face_count")


@_named()
def greedy_assign(spark, d):
    faces = _faces(spark, d)
    return clustering.greedy_assign(faces.where("person_id IS NULL"), faces.where("person_id IS NOT NULL"))


@_named()
def cluster_quality(spark, d):
    faces = _faces(spark, d)
    return clustering.quality(clustering.recluster(faces, 0.45), faces.where("person_id IS NOT NULL").select(F.col("id").alias("face_id"), F.col("person_id").alias("label")))


# -- synchronizing and edits ---------------------------------------------------------------------------------


@_named(
    "SELECT coalesce(p.path, s.path) AS path, p.id, CASE WHEN s.path IS NULL THEN 'gone' WHEN p.id IS NULL THEN 'new' WHEN s.mtime = p.mtime AND s.size = p.size AND p.analyzed_at IS NOT NULL THEN 'unchanged' ELSE 'changed' END AS state FROM photos p FULL JOIN scan s ON s.path = p.path",
    "photos", "scan",
)
def sync_classify(spark, d):
    return sync.classify(view(spark, d, "photos"), view(spark, d, "scan"))


@_named(
    "SELECT coalesce(p.id, (SELECT max(id) FROM photos) + row_number() OVER (PARTITION BY p.id IS NULL ORDER BY s.path)) AS id, coalesce(s.path, p.path) AS path, coalesce(s.mtime, p.mtime) AS mtime, coalesce(s.size, p.size) AS size, CASE WHEN s.path IS NULL THEN p.phash END AS phash FROM photos p FULL JOIN scan s ON s.path = p.path",
    "photos", "scan",
)
def sync_upsert(spark, d):
    photos = view(spark, d, "photos")
    given = view(spark, d, "scan")
    rows = given.select("path", "mtime", "size", *(F.lit(None).cast(f.dataType).alias(f.name) for f in photos.schema.fields if f.name not in ("id", "path", "mtime", "size")))
    return sync.upsert(photos, rows).select("id", "path", "mtime", "size", "phash")


@_named(
    "SELECT 'photos' AS name, count(*) AS n FROM photos WHERE path IN (SELECT path FROM scan) UNION ALL SELECT 'faces', count(*) FROM faces WHERE photo_id IN (SELECT id FROM photos WHERE path IN (SELECT path FROM scan)) "
    "UNION ALL SELECT 'photo_tags', count(*) FROM photo_tags WHERE photo_id IN (SELECT id FROM photos WHERE path IN (SELECT path FROM scan))",
    "photos", "scan", "faces", "photo_tags",
)
def cascade_delete(spark, d):
    names = ("photos", "faces", "photo_tags")
    kept = sync.delete_missing(view(spark, d, "photos"), view(spark, d, "scan"), view(spark, d, "faces"), view(spark, d, "photo_tags"))
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, t in zip(names, kept, strict=True)]
    return counts[0].union(counts[1]).union(counts[2])


@_named("SELECT id, CASE WHEN person_id = 3 THEN 5 ELSE person_id END AS person_id, pinned FROM faces", "faces")
def merge_persons(spark, d):
    return edits.merge_persons(view(spark, d, "persons"), view(spark, d, "faces"), 3, 5)[1].select("id", "person_id", "pinned")


@_named("SELECT id, CASE WHEN person_id = 2 THEN NULL ELSE person_id END AS person_id, CASE WHEN person_id = 2 THEN FALSE ELSE pinned END AS pinned FROM faces", "faces")
def delete_person(spark, d):
    return edits.delete_person(view(spark, d, "persons"), view(spark, d, "faces"), 2)[1].select("id", "person_id", "pinned")


@_named("SELECT id, name, color, (SELECT count(*) FROM faces f WHERE CASE WHEN f.person_id = 3 THEN 5 ELSE f.person_id END = p.id) AS face_count FROM persons p WHERE id <> 3", "persons", "faces")
def persons_after_merge(spark, d):
    persons, faces = edits.merge_persons(view(spark, d, "persons"), view(spark, d, "faces"), 3, 5)
    return gallery.person_counts(persons, faces).select("id", "name", "color", "face_count")


@_named("SELECT id, name, color, (SELECT count(*) FROM faces f WHERE f.person_id = p.id) AS face_count FROM persons p WHERE id <> 2", "persons", "faces")
def persons_after_delete(spark, d):
    persons, faces = edits.delete_person(view(spark, d, "persons"), view(spark, d, "faces"), 2)
    return gallery.person_counts(persons, faces).select("id", "name", "color", "face_count")


@_named("SELECT photo_id, tag_id FROM photo_tags WHERE NOT (photo_id = 7 AND tag_id = 1) UNION SELECT 3, 26 UNION SELECT 4, id FROM tags WHERE id = 4", "photo_tags", "tags")
def retag(spark, d):
    tags, links = view(spark, d, "tags"), view(spark, d, "photo_tags")
    tags, links = edits.tag_photo(tags, links, 3, "  beach ", 26)
    known = tags.where("id = 4").first()["name"]
    tags, links = edits.tag_photo(tags, links, 4, known, 27)
    return edits.untag_photo(links, 7, 1)


@_named("SELECT id, CASE WHEN id = 10 THEN 8 ELSE person_id END AS person_id, pinned OR id = 10 AS pinned FROM faces WHERE id <> 12", "faces")
def move_and_delete_face(spark, d):
    return edits.delete_face(edits.set_face_person(view(spark, d, "faces"), 10, 8), 12).select("id", "person_id", "pinned")


_IOU = "greatest(0, least(f.x + f.w, d.x + d.w) - greatest(f.x, d.x)) * greatest(0, least(f.y + f.h, d.y + d.h) - greatest(f.y, d.y))"


@_named(
    f"SELECT photo_id, face_id, det_id, round(i / (fa + da - i), 6) AS iou FROM (SELECT f.photo_id, f.id AS face_id, d.det_id, {_IOU} AS i, f.w * f.h AS fa, d.w * d.h AS da FROM faces f JOIN detections d ON d.photo_id = f.photo_id WHERE f.pinned AND f.person_id IS NOT NULL) WHERE i / (fa + da - i) >= 0.5",
    "faces", "detections",
)
def iou_candidates(spark, d):
    return matching.iou_candidates(view(spark, d, "faces"), view(spark, d, "detections")).select("photo_id", "face_id", "det_id", F.round("iou", 6).alias("iou"))


@_named()
def iou_match(spark, d):
    return matching.iou_match(view(spark, d, "faces"), view(spark, d, "detections")).select("photo_id", "face_id", "det_id", "person_id")


@_named("SELECT min(ts) AS started, max(ts) + INTERVAL 2 SECONDS AS fires_at, count(*) AS events FROM (SELECT ts, sum(fresh) OVER (ORDER BY ts, event_id) AS burst FROM (SELECT event_id, ts, CASE WHEN ts - lag(ts) OVER (ORDER BY ts, event_id) <= INTERVAL 2 SECONDS THEN 0 ELSE 1 END AS fresh FROM dir_events)) GROUP BY burst", "dir_events")
def debounce_sessions(spark, d):
    return debounce.debounce_batch(view(spark, d, "dir_events"))


_oracle["dup_pairs"] = _pairs_oracle("SELECT id_a, id_b, cast(distance AS INTEGER) AS distance FROM pairs", _PAIRS, "photos")
_oracle["dup_groups"] = _pairs_oracle(
    "SELECT group_id, count(*) AS size, min(path) AS first_path, string_agg(path, '|' ORDER BY path) AS paths FROM groups JOIN photos ON id = photo_id GROUP BY group_id", _GROUPS, "photos"
)
_oracle["gallery_duplicates"] = _pairs_oracle("SELECT id, path FROM photos WHERE id IN (SELECT photo_id FROM groups)", _GROUPS, "photos")
_EDGES = f"edges AS (SELECT a.id AS a, b.id AS b FROM faces a JOIN faces b ON a.id < b.id WHERE {_SIM} >= {{0}})"
_oracle["threshold_components"] = _pairs_oracle(
    "SELECT f.id, least(f.id, coalesce((SELECT min(seen) FROM walk w WHERE w.id = f.id), f.id)) AS component FROM faces f",
    _EDGES.format("0.363") + ", walk AS (SELECT a AS id, b AS seen FROM edges UNION SELECT b, a FROM edges UNION SELECT w.id, CASE WHEN e.a = w.seen THEN e.b ELSE e.a END FROM walk w JOIN edges e ON e.a = w.seen OR e.b = w.seen)",
    "faces",
)
_oracle["nearest_person"] = _pairs_oracle(
    "SELECT id, CASE WHEN sim > 0.2 THEN near_id END AS near_id, CASE WHEN sim > 0.2 THEN round(sim, 6) END AS sim FROM (SELECT id, near_id, sim, row_number() OVER (PARTITION BY id ORDER BY sim DESC, near_id) AS place FROM "
    "(SELECT f.id, m.person_id AS near_id, list_cosine_similarity(cast(f.embedding AS DOUBLE[]), m.mean) AS sim FROM faces f, means m WHERE f.person_id IS NULL)) WHERE place = 1",
    "means AS (SELECT person_id, list(m ORDER BY pos) AS mean FROM (SELECT person_id, pos, avg(x) AS m FROM (SELECT person_id, cast(unnest(embedding) AS DOUBLE) AS x, unnest(range(0, len(embedding))) AS pos FROM faces WHERE person_id IS NOT NULL) GROUP BY person_id, pos) GROUP BY person_id)",
    "faces",
)
# At this threshold the test tables up to sf0.01 have no component of more than two faces, so a cluster is a pair or a single face.
_oracle["recluster_pairs"] = _pairs_oracle(
    "SELECT f.id AS face_id, coalesce(f.anchor, o.anchor, -(least(f.place, coalesce(o.place, f.place)) + 1)) AS cluster_id FROM own f LEFT JOIN partner p ON p.id = f.id LEFT JOIN own o ON o.id = p.other",
    "own AS (SELECT id, CASE WHEN pinned THEN person_id END AS anchor, row_number() OVER (ORDER BY id) - 1 AS place FROM faces), "
    + _EDGES.format("0.45")
    + ", good AS (SELECT e.a, e.b FROM edges e JOIN own x ON x.id = e.a JOIN own y ON y.id = e.b WHERE x.anchor IS NULL OR y.anchor IS NULL OR x.anchor = y.anchor), partner AS (SELECT a AS id, b AS other FROM good UNION SELECT b, a FROM good)",
    "faces",
)


from kinfold.plans import checks  # noqa: E402, F401  registers its queries with those above


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracle)
