"""Further queries: metadata parsers, edits, names and colours, and the greedy steps of grouping, with recursive SQL beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold import constants as C
from kinfold.functions import exif, media
from kinfold.operators import clustering, edits, gallery, matching, similarity
from kinfold.plans.registry import _named, _oracle, _pairs_oracle
from kinfold.plans.views import view
from kinfold.sources import models
from kinfold.streaming import debounce

# -- names, colours, texts -----------------------------------------------------------------------------------


@_named("SELECT id, name, row_number() OVER (ORDER BY name, id) - 1 AS place FROM persons", "persons")
def persons_by_name(spark, d):
    return gallery.by_name(view(spark, d, "persons")).select("id", "name", "place")


@_named("SELECT id, name, row_number() OVER (ORDER BY name, id) - 1 AS place FROM tags", "tags")
def tags_by_name(spark, d):
    return gallery.by_name(view(spark, d, "tags")).select("id", "name", "place")


def _channel(options: str) -> str:
    return f"lpad(lower(printf('%x', cast(floor(list_extract([{options}], cast(floor(h * 6) AS INTEGER) % 6 + 1) * 255e0) AS BIGINT))), 2, '0')"


#: A hue h (0 to 1) as #rrggbb, from the levels v, p, q and t of its sector.
_HEX = "'#' || " + " || ".join(_channel(x) for x in ("v, q, p, p, t, v", "t, v, v, q, p, p", "p, p, t, v, v, q"))
_COLORED = (
    "hued AS (SELECT *, hue / 360e0 AS h FROM (SELECT id, name, cast(list_reduce([0] || list_transform(string_split(sha1(name), ''), lambda c: strpos('0123456789abcdef', c) - 1), lambda a, x: (a * 16 + x) % 360) AS BIGINT) AS hue FROM tags)), "
    "mixed AS (SELECT *, 0.9e0 AS v, 0.9e0 * (1e0 - 0.6e0) AS p, 0.9e0 * (1e0 - 0.6e0 * (h * 6 - floor(h * 6))) AS q, 0.9e0 * (1e0 - 0.6e0 * (1e0 - (h * 6 - floor(h * 6)))) AS t FROM hued), "
    f"colored AS (SELECT id, name, {_HEX} AS color FROM mixed)"
)


@_named()
def tag_colors(spark, d):
    return view(spark, d, "tags").select("id", "name", media.tag_color(F.col("name")).alias("color"))


@_named()
def photo_tag_dots(spark, d):
    return gallery.photo_tag_names(view(spark, d, "photo_tags"), view(spark, d, "tags")).select("photo_id", "tag_dots")


_oracle["tag_colors"] = _pairs_oracle("SELECT id, name, color FROM colored", _COLORED, "tags")
_oracle["photo_tag_dots"] = _pairs_oracle(
    "SELECT photo_id, string_agg(color, ',' ORDER BY name) AS tag_dots FROM (SELECT photo_id, c.name, c.color, row_number() OVER (PARTITION BY photo_id ORDER BY c.name) AS place FROM photo_tags p JOIN colored c ON c.id = p.tag_id) WHERE place <= 4 GROUP BY photo_id",
    _COLORED,
    "tags",
    "photo_tags",
)


@_named(
    "SELECT id, cast(exif_lat AS VARCHAR) || ', ' || cast(exif_lon AS VARCHAR) AS coordinates, 'https://www.openstreetmap.org/?mlat=' || cast(exif_lat AS VARCHAR) || '&mlon=' || cast(exif_lon AS VARCHAR) AS map_url "
    "FROM photos WHERE exif_lat IS NOT NULL AND exif_lon IS NOT NULL",
    "photos",
)
def place_links(spark, d):
    return gallery.place_links(view(spark, d, "photos")).select("id", "coordinates", "map_url")


@_named("SELECT id, greatest(0, least(rank + step, (SELECT count(*) FROM photos) - 1)) AS moved_to FROM (SELECT id, id % 9 - 4 AS step, row_number() OVER (ORDER BY path, id) - 1 AS rank FROM photos)", "photos")
def selection_moves(spark, d):
    photos = view(spark, d, "photos").select("id", "path", "exif_date")
    return gallery.with_moves(photos, F.col("id") % 9 - 4).select("id", "moved_to")


@_named("SELECT id, lower(coalesce(nullif(regexp_extract(path, '[^/]([.][^./]+)$', 1), ''), '')) AS extension, regexp_matches(lower(path), '[^/][.](bmp|jpe?g|png|tiff?|webp)$') AS is_image FROM scan_files", "scan_files")
def file_kinds(spark, d):
    return view(spark, d, "scan_files").select("id", media.extension(F.col("path")).alias("extension"), media.is_image(F.col("path")).alias("is_image"))


@_named("SELECT event_id, lower(trim(coalesce(raw, ''))) IN ('1', 'true', 'yes', 'on') AS is_on, nullif(trim(raw), '') AS entered FROM settings", "settings")
def setting_values(spark, d):
    return view(spark, d, "settings").select("event_id", media.truthy(F.col("raw")).alias("is_on"), media.user_text(F.col("raw")).alias("entered"))


# -- metadata ------------------------------------------------------------------------------------------------

_PARSED = r"CASE WHEN {0} NOT LIKE '0000%' THEN strftime(try_strptime(regexp_extract({0}, '^\s*(\d{{4}}:\d{{2}}:\d{{2}}[ T]\d{{2}}:\d{{2}}:\d{{2}})', 1).replace('T', ' '), '%Y:%m:%d %H:%M:%S'), '%Y-%m-%dT%H:%M:%S') END"


@_named(
    f"SELECT photo_id, coalesce({_PARSED.format('original')}, {_PARSED.format('digitized')}, {_PARSED.format('modified')}) AS taken FROM "
    "(SELECT photo_id, dt AS original, CASE WHEN photo_id % 3 <> 0 THEN replace(dt, '0000:', '1999:') END AS digitized, CASE WHEN photo_id % 5 = 0 THEN '2020:01:02 03:04:05 left' ELSE 'unknown' END AS modified FROM exif_raw)",
    "exif_raw",
)
def exif_first_dates(spark, d):
    digitized = F.when(F.col("photo_id") % 3 != 0, F.replace("dt", F.lit("0000:"), F.lit("1999:")))
    modified = F.when(F.col("photo_id") % 5 == 0, F.lit("2020:01:02 03:04:05 left")).otherwise(F.lit("unknown"))
    return view(spark, d, "exif_raw").select("photo_id", exif.first_date(F.col("dt"), digitized, modified).alias("taken"))


@_named("SELECT photo_id, CASE WHEN lat_m <> 0 THEN round(lat_d / lat_m, 9) END AS ratio, CASE WHEN lat_m <> 0 AND lat_s <> 0 THEN round(lat_d / lat_m / lat_s, 9) END AS twice FROM exif_raw", "exif_raw")
def exif_ratios(spark, d):
    once = exif.ratio(F.col("lat_d"), F.col("lat_m"))
    return view(spark, d, "exif_raw").select("photo_id", F.round(once, 9).alias("ratio"), F.round(exif.ratio(once, F.col("lat_s")), 9).alias("twice"))


# -- edits ---------------------------------------------------------------------------------------------------


@_named("SELECT id, photo_id FROM faces WHERE photo_id <> 17", "faces")
def delete_photo_faces(spark, d):
    return edits.delete_photo_faces(view(spark, d, "faces"), 17).select("id", "photo_id")


@_named(
    "SELECT id, photo_id, person_id, pinned FROM faces UNION ALL SELECT 900000 + row_number() OVER (ORDER BY photo_id, x, y) - 1, photo_id, NULL, FALSE FROM detections", "faces", "detections"
)
def insert_faces(spark, d):
    faces = view(spark, d, "faces")
    rows = view(spark, d, "detections").select("photo_id", F.lit(None).cast("bigint").alias("person_id"), "x", "y", "w", "h", F.array().cast("array<float>").alias("embedding"), F.lit(False).alias("pinned"), F.lit(0.5).alias("confidence"))
    typed = faces.withColumn("embedding", F.col("embedding").cast("array<float>")).select("id", *rows.columns)
    return edits.add_faces(typed, rows, 900000).select("id", "photo_id", "person_id", "pinned")


@_named("SELECT id, CASE id WHEN 4 THEN 'Ada' ELSE name END AS name, color FROM persons UNION ALL SELECT 999, 'New', '#010203'", "persons")
def create_and_rename(spark, d):
    persons = edits.create_person(view(spark, d, "persons"), 999, "New", "#010203")
    return edits.rename_person(edits.rename_person(persons, 4, "  Ada "), 5, "   ").select("id", "name", "color")


@_named("SELECT 'tag' AS kind, id AS tag_id, NULL AS photo_id FROM tags WHERE id <> 3 UNION ALL SELECT 'link', tag_id, photo_id FROM photo_tags WHERE tag_id <> 3", "tags", "photo_tags")
def delete_tag(spark, d):
    tags, links = edits.delete_tag(view(spark, d, "tags"), view(spark, d, "photo_tags"), 3)
    return tags.select(F.lit("tag").alias("kind"), F.col("id").alias("tag_id"), F.lit(None).cast("bigint").alias("photo_id")).union(links.select(F.lit("link"), "tag_id", "photo_id"))


_PALETTE = "(SELECT unnest(['" + "', '".join(C.PERSON_PALETTE) + f"']) AS color, unnest(range(0, {len(C.PERSON_PALETTE)})) AS pos)"


@_named(
    f"SELECT id, CASE WHEN id = 10 THEN 500 ELSE person_id END AS person_id, pinned OR id = 10 AS pinned, CASE WHEN id = 10 THEN (SELECT min_by(color, pos) FROM {_PALETTE} WHERE color NOT IN (SELECT color FROM persons)) END AS made_color FROM faces", "faces", "persons"
)
def split_face(spark, d):
    persons, faces = edits.split_face(view(spark, d, "persons"), view(spark, d, "faces"), 10, 500, "Persona 500")
    made = persons.where("id = 500").select(F.lit(10).cast("bigint").alias("id"), F.col("color").alias("made_color"))
    return faces.select("id", "person_id", "pinned").join(made, "id", "left")


@_named("SELECT event_id, ts FROM dir_events e WHERE NOT EXISTS (SELECT 1 FROM dir_events r WHERE r.event_id % 50 = 7 AND e.ts >= r.ts AND e.ts < r.ts + INTERVAL 30 SECONDS)", "dir_events")
def events_outside_runs(spark, d):
    events = view(spark, d, "dir_events").select("event_id", "ts")
    runs = events.where("event_id % 50 = 7").select(F.col("ts").alias("start_ts"), (F.col("ts") + F.expr("INTERVAL 30 SECONDS")).alias("end_ts"))
    return debounce.outside_runs(events, runs)


# -- greedy steps --------------------------------------------------------------------------------------------

_CLUSTERS = "loose AS (SELECT id AS face_id, -(id % 23) - 1 AS cluster_id FROM faces WHERE id % 3 <> 0)"
_OVERLAPS = _CLUSTERS + (
    ", met AS (SELECT l.cluster_id, f.person_id, count(*) AS n, any_value(m.first_face) AS first_face FROM loose l JOIN faces f ON f.id = l.face_id AND f.person_id IS NOT NULL "
    "JOIN (SELECT cluster_id, min(face_id) AS first_face FROM loose GROUP BY cluster_id) m ON m.cluster_id = l.cluster_id GROUP BY l.cluster_id, f.person_id)"
)


def _loose(spark, d):
    return view(spark, d, "faces").where("id % 3 <> 0").select(F.col("id").alias("face_id"), (-(F.col("id") % 23) - 1).alias("cluster_id"))


@_named()
def cluster_overlaps(spark, d):
    return clustering.overlaps(view(spark, d, "faces").select("id", "person_id"), _loose(spark, d)).select("cluster_id", "person_id", "n", "first_face")


@_named()
def claimed_persons(spark, d):
    faces = view(spark, d, "faces").select("id", "person_id")
    return clustering.stabilize(faces, _loose(spark, d))


_oracle["cluster_overlaps"] = _pairs_oracle("SELECT cluster_id, person_id, n, first_face FROM met", _OVERLAPS, "faces")
# One overlap after the other: it is claimed if neither its cluster nor its person is in the list so far.
_oracle["claimed_persons"] = _pairs_oracle(
    "SELECT l.face_id, coalesce(c.person_id, l.cluster_id) AS person_id FROM loose l LEFT JOIN (SELECT unnest(cs) AS cluster_id, unnest(ps) AS person_id FROM (SELECT * FROM walk ORDER BY k DESC LIMIT 1)) c ON c.cluster_id = l.cluster_id",
    _OVERLAPS
    + ", queue AS (SELECT *, row_number() OVER (ORDER BY n DESC, person_id, first_face, cluster_id) AS k FROM met), "
    "walk AS (SELECT cast(0 AS BIGINT) AS k, cast([] AS BIGINT[]) AS cs, cast([] AS BIGINT[]) AS ps UNION ALL "
    "SELECT q.k, CASE WHEN list_contains(w.cs, q.cluster_id) OR list_contains(w.ps, q.person_id) THEN w.cs ELSE list_append(w.cs, q.cluster_id) END, "
    "CASE WHEN list_contains(w.cs, q.cluster_id) OR list_contains(w.ps, q.person_id) THEN w.ps ELSE list_append(w.ps, q.person_id) END FROM walk w JOIN queue q ON q.k = w.k + 1)",
    "faces",
)


@_named(
    "SELECT cast((SELECT max(id) FROM persons) + place AS BIGINT) AS id, 'Persona ' || cast((SELECT count(*) FROM persons) + place AS VARCHAR) AS name, color FROM "
    "(SELECT cluster_id, row_number() OVER (ORDER BY min(face_id)) AS place FROM (SELECT id AS face_id, -(id % 10) - 1 AS cluster_id FROM faces WHERE id % 4 = 1) GROUP BY cluster_id) "
    f"JOIN (SELECT color, row_number() OVER (ORDER BY pos) AS place FROM {_PALETTE} WHERE color NOT IN (SELECT color FROM persons)) USING (place) UNION ALL SELECT id, name, color FROM persons",
    "persons", "faces",
)
def opened_persons(spark, d):
    assigned = view(spark, d, "faces").where("id % 4 = 1").select(F.col("id").alias("face_id"), (-(F.col("id") % 10) - 1).alias("person_id"))
    return clustering.with_new_persons(view(spark, d, "persons"), assigned)[0].select("id", "name", "color")


_CANDIDATES = (
    "boxes AS (SELECT f.photo_id, f.id AS face_id, d.det_id, f.person_id, greatest(0, least(f.x + f.w, d.x + d.w) - greatest(f.x, d.x)) * greatest(0, least(f.y + f.h, d.y + d.h) - greatest(f.y, d.y)) AS i, f.w * f.h + d.w * d.h AS areas "
    "FROM faces f JOIN detections d ON d.photo_id = f.photo_id WHERE f.pinned AND f.person_id IS NOT NULL), "
    "queue AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY i / (areas - i) DESC, face_id, det_id) AS k FROM boxes WHERE i / (areas - i) >= 0.5), "
    "walk AS (SELECT DISTINCT photo_id, cast(0 AS BIGINT) AS k, cast([] AS BIGINT[]) AS fs, cast([] AS BIGINT[]) AS ds FROM queue UNION ALL "
    "SELECT q.photo_id, q.k, CASE WHEN list_contains(w.fs, q.face_id) OR list_contains(w.ds, q.det_id) THEN w.fs ELSE list_append(w.fs, q.face_id) END, "
    "CASE WHEN list_contains(w.fs, q.face_id) OR list_contains(w.ds, q.det_id) THEN w.ds ELSE list_append(w.ds, q.det_id) END FROM walk w JOIN queue q ON q.photo_id = w.photo_id AND q.k = w.k + 1)"
)
_WON = "SELECT photo_id, unnest(fs) AS face_id, unnest(ds) AS det_id FROM (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY k DESC) AS last FROM walk) WHERE last = 1"
_oracle["iou_match"] = _pairs_oracle(f"SELECT m.photo_id, m.face_id, m.det_id, f.person_id FROM ({_WON}) m JOIN faces f ON f.id = m.face_id", _CANDIDATES, "faces", "detections")


@_named()
def inherited_pins(spark, d):
    return matching.reanalyzed(view(spark, d, "faces"), view(spark, d, "detections")).select("det_id", "photo_id", "person_id", "pinned")


_oracle["inherited_pins"] = _pairs_oracle(
    f"SELECT d.det_id, d.photo_id, f.person_id, f.person_id IS NOT NULL AS pinned FROM detections d LEFT JOIN ({_WON}) m ON m.det_id = d.det_id LEFT JOIN faces f ON f.id = m.face_id", _CANDIDATES, "faces", "detections"
)

# Each step of the walk gives one new face to the first of the most similar means, or to a new one. The state holds names, means and counts.
_GREEDY = (
    "parts AS (SELECT person_id, pos, avg(v) AS m FROM (SELECT person_id, cast(unnest(embedding) AS DOUBLE) AS v, unnest(range(0, len(embedding))) AS pos FROM faces WHERE person_id IS NOT NULL) GROUP BY person_id, pos), "
    "known AS (SELECT person_id, (SELECT min(id) FROM faces f WHERE f.person_id = p.person_id) AS first_face, (SELECT count(*) FROM faces f WHERE f.person_id = p.person_id) AS n, list(m ORDER BY pos) AS mean FROM parts p GROUP BY person_id), "
    "fresh AS (SELECT id, cast(embedding AS DOUBLE[]) AS v, row_number() OVER (ORDER BY id) AS k FROM faces WHERE person_id IS NULL AND {0}), "
    "walk AS (SELECT cast(0 AS BIGINT) AS k, cast(NULL AS BIGINT) AS face_id, cast(NULL AS BIGINT) AS person_id, list(person_id ORDER BY first_face) AS names, list(mean ORDER BY first_face) AS means, list(n ORDER BY first_face) AS counts FROM known UNION ALL "
    "SELECT k, id, names[spot], names, list_transform(means, lambda m, i: CASE WHEN i = spot THEN CASE WHEN old THEN list_transform(m, lambda c, j: (c * counts[spot] + v[j]) / (counts[spot] + 1)) ELSE v END ELSE m END), "
    "list_transform(counts, lambda c, i: CASE WHEN i = spot AND old THEN c + 1 ELSE c END) FROM ("
    "SELECT k, id, v, old, CASE WHEN old THEN best ELSE len(names) + 1 END AS spot, CASE WHEN old THEN names ELSE list_append(names, -(len(names) + 1000000)) END AS names, "
    "CASE WHEN old THEN means ELSE list_append(means, v) END AS means, CASE WHEN old THEN counts ELSE list_append(counts, cast(1 AS BIGINT)) END AS counts FROM ("
    "SELECT *, list_position(sims, list_max(sims)) AS best, list_max(sims) > 0.363 AS old FROM (SELECT f.k, f.id, f.v, w.names, w.means, w.counts, list_transform(w.means, lambda m: list_cosine_similarity(m, f.v)) AS sims FROM walk w JOIN fresh f ON f.k = w.k + 1))))"
)
_oracle["greedy_assign"] = _pairs_oracle("SELECT face_id, person_id FROM walk WHERE face_id IS NOT NULL", _GREEDY.replace("{0}", "TRUE"), "faces")


@_named()
def greedy_applied(spark, d):
    """The new faces, those without person or pin, put to old and new persons; all others stay as they are."""
    faces = view(spark, d, "faces").select("id", "person_id", "pinned", "embedding", "photo_id")
    done = clustering.apply_greedy(faces, view(spark, d, "persons"), faces.where("person_id IS NULL AND NOT pinned").select("id"))
    named = done.persons.select(F.col("id").alias("person_id"), "name")
    return done.faces.select("id", "person_id", "pinned").join(named, "person_id", "left").select("id", "person_id", "pinned", "name")


# New persons come in the order of their first faces.
_oracle["greedy_applied"] = _pairs_oracle(
    "SELECT f.id, coalesce(o.id, w.person_id, f.person_id) AS person_id, f.pinned, coalesce(o.name, p.name) AS name FROM faces f LEFT JOIN walk w ON w.face_id = f.id LEFT JOIN opened o ON o.tentative = w.person_id "
    "LEFT JOIN persons p ON p.id = coalesce(w.person_id, f.person_id)",
    _GREEDY.replace("{0}", "NOT pinned")
    + ", opened AS (SELECT person_id AS tentative, (SELECT max(id) FROM persons) + place AS id, 'Persona ' || cast((SELECT count(*) FROM persons) + place AS VARCHAR) AS name FROM "
    "(SELECT person_id, row_number() OVER (ORDER BY min(face_id)) AS place FROM walk WHERE person_id < 0 GROUP BY person_id))",
    "faces",
    "persons",
)


@_named()
def model_problems(spark, d):
    """Pages as files: what a catalogue of their hashes and sizes, and a record of first use, find wrong with them."""
    pages = view(spark, d, "pages").withColumn("name", F.col("page_id").cast("string"))
    own, digest = F.col("page_id"), lambda c: F.sha2(c, 256)
    catalog = pages.select(
        "name", F.when(own % 3 == 0, F.upper(digest("html"))).when((own % 3 == 1) & (own % 2 == 0), digest("url")).alias("sha256"), F.when(own % 5 == 0, F.length("html") + own % 2).cast("bigint").alias("size")
    )
    files = pages.where("page_id % 11 <> 3").select("name", digest("html").alias("sha256"), F.length("html").cast("bigint").alias("size"))
    recorded = pages.where("page_id % 7 < 4").select("name", F.when(own % 4 == 1, digest("html")).otherwise(digest("url")).alias("sha256"))
    return models.problems(catalog, files, recorded)


_oracle["model_problems"] = (
    "SELECT name, problem FROM (SELECT c.name, CASE WHEN f.name IS NULL THEN 'missing' WHEN f.size = 0 THEN 'empty' WHEN c.size <> f.size THEN 'size mismatch' WHEN coalesce(lower(c.sha256), lower(r.sha256)) IS NULL THEN 'no known hash' "
    "WHEN coalesce(lower(c.sha256), lower(r.sha256)) <> f.sha256 THEN 'checksum mismatch' END AS problem FROM "
    "(SELECT cast(page_id AS VARCHAR) AS name, CASE WHEN page_id % 3 = 0 THEN upper(sha256(html)) WHEN page_id % 3 = 1 AND page_id % 2 = 0 THEN sha256(url) END AS sha256, CASE WHEN page_id % 5 = 0 THEN length(html) + page_id % 2 END AS size FROM pages) c "
    "LEFT JOIN (SELECT cast(page_id AS VARCHAR) AS name, sha256(html) AS sha256, length(html) AS size FROM pages WHERE page_id % 11 <> 3) f ON f.name = c.name LEFT JOIN (SELECT cast(page_id AS VARCHAR) AS name, sha256(CASE WHEN page_id % 4 = 1 THEN html ELSE url END) AS sha256 FROM pages WHERE page_id % 7 < 4) r ON r.name = c.name) WHERE problem IS NOT NULL"
)


@_named()
def nearest_person_by_blocks(spark, d):
    """The same as ``nearest_person`` when the means are too many to broadcast."""
    faces = view(spark, d, "faces")
    near = similarity.nearest_person(faces.where("person_id IS NULL").select("id", "embedding"), similarity.person_means(faces.select("person_id", "embedding")), 0.2, means_bytes=2048)
    return near.select("id", "near_id", F.round("sim", 6).alias("sim"))


_oracle["nearest_person_by_blocks"] = _oracle["nearest_person"]

# -- grouping ------------------------------------------------------------------------------------------------

_UNITS = (
    "units AS (SELECT id, CASE WHEN pinned THEN person_id END AS anchor, row_number() OVER (ORDER BY id) - 1 AS place, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS unit FROM (SELECT *, cast(embedding AS DOUBLE[]) AS v FROM faces)), "
    "edges AS (SELECT a.id AS a, b.id AS b FROM units a JOIN units b ON a.id < b.id WHERE list_dot_product(a.unit, b.unit) >= {0}), "
    "walk AS (SELECT a AS id, b AS seen FROM edges UNION SELECT b, a FROM edges UNION SELECT w.id, CASE WHEN e.a = w.seen THEN e.b ELSE e.a END FROM walk w JOIN edges e ON e.a = w.seen OR e.b = w.seen), "
    "comps AS (SELECT id, least(id, min(seen)) AS comp FROM walk GROUP BY id), "
    # Each step merges the most similar pair of clusters of every component that has one; the averages come from sums of unit vectors.
    "clusters AS (SELECT 0 AS step, comp, place AS lead, [id] AS ids, unit AS total, 1 AS n, anchor FROM units JOIN comps USING (id) UNION ALL ("
    "WITH pairs AS (SELECT a.comp, a.lead AS x, b.lead AS y, list_dot_product(a.total, b.total) / (a.n * b.n) AS sim FROM clusters a JOIN clusters b ON a.comp = b.comp AND a.lead < b.lead WHERE a.anchor IS NULL OR b.anchor IS NULL OR a.anchor = b.anchor), "
    "best AS (SELECT comp, x, y FROM (SELECT *, row_number() OVER (PARTITION BY comp ORDER BY sim DESC, x, y) AS r FROM pairs WHERE sim >= {0} - 1e-12) WHERE r = 1) "
    "SELECT c.step + 1, c.comp, c.lead, CASE WHEN o.lead IS NULL THEN c.ids ELSE list_concat(c.ids, o.ids) END, CASE WHEN o.lead IS NULL THEN c.total ELSE list_transform(c.total, lambda t, i: t + o.total[i]) END, "
    "c.n + coalesce(o.n, 0), coalesce(c.anchor, o.anchor) FROM clusters c JOIN best t ON t.comp = c.comp LEFT JOIN clusters o ON o.comp = t.comp AND o.lead = t.y AND c.lead = t.x WHERE c.lead <> t.y)), "
    "found AS (SELECT unnest(ids) AS face_id, coalesce(anchor, -(lead + 1)) AS cluster_id FROM (SELECT *, max(step) OVER (PARTITION BY comp) AS last FROM clusters) WHERE step = last "
    "UNION ALL SELECT id, coalesce(anchor, -(place + 1)) FROM units WHERE id NOT IN (SELECT id FROM comps))"
)
_STABLE = (
    "met AS (SELECT l.cluster_id, f.person_id, count(*) AS n, (SELECT min(m.face_id) FROM found m WHERE m.cluster_id = l.cluster_id) AS first_face FROM found l JOIN faces f ON f.id = l.face_id "
    "WHERE l.cluster_id < 0 AND f.person_id IS NOT NULL AND f.person_id NOT IN (SELECT cluster_id FROM found) GROUP BY l.cluster_id, f.person_id), "
    "queue AS (SELECT *, row_number() OVER (ORDER BY n DESC, person_id, first_face, cluster_id) AS k FROM met), "
    "claims AS (SELECT cast(0 AS BIGINT) AS k, cast([] AS BIGINT[]) AS cs, cast([] AS BIGINT[]) AS ps UNION ALL "
    "SELECT q.k, CASE WHEN list_contains(w.cs, q.cluster_id) OR list_contains(w.ps, q.person_id) THEN w.cs ELSE list_append(w.cs, q.cluster_id) END, "
    "CASE WHEN list_contains(w.cs, q.cluster_id) OR list_contains(w.ps, q.person_id) THEN w.ps ELSE list_append(w.ps, q.person_id) END FROM claims w JOIN queue q ON q.k = w.k + 1), "
    "won AS (SELECT unnest(cs) AS cluster_id, unnest(ps) AS person_id FROM (SELECT * FROM claims ORDER BY k DESC LIMIT 1)), "
    "stable AS (SELECT f.face_id, coalesce(w.person_id, f.cluster_id) AS person_id FROM found f LEFT JOIN won w ON w.cluster_id = f.cluster_id)"
)
_oracle["recluster_full"] = _pairs_oracle("SELECT face_id, cluster_id FROM found", _UNITS.format("0.363e0"), "faces")
_oracle["stabilized"] = _pairs_oracle("SELECT face_id, person_id FROM stable", _UNITS.format("0.45e0") + ", " + _STABLE, "faces")


@_named()
def regrouped_faces(spark, d):
    """The whole regrouping: clusters, claims, new persons, pins; automatic names without faces are gone."""
    faces = view(spark, d, "faces").select("id", "person_id", "pinned", "embedding", "photo_id")
    done = clustering.regroup(faces, view(spark, d, "persons"))
    named = done.persons.select(F.col("id").alias("person_id"), "name")
    return done.faces.select("id", "person_id", "pinned").join(named, "person_id", "left").select("id", "person_id", "pinned", "name")


# New persons come in the order of their first faces; a face that moves loses its pin, a pinned one stays.
_oracle["regrouped_faces"] = _pairs_oracle(
    "SELECT g.id, g.person_id, g.pinned, coalesce(p.name, o.name) AS name FROM moved g LEFT JOIN persons p ON p.id = g.person_id LEFT JOIN opened o ON o.id = g.person_id",
    _UNITS.format("0.363e0")
    + ", "
    + _STABLE
    + ", opened AS (SELECT person_id AS tentative, (SELECT max(id) FROM persons) + place AS id, 'Persona ' || cast((SELECT count(*) FROM persons) + place AS VARCHAR) AS name FROM "
    "(SELECT person_id, row_number() OVER (ORDER BY min(face_id)) AS place FROM stable WHERE person_id < 0 GROUP BY person_id)), "
    "moved AS (SELECT f.id, CASE WHEN f.pinned THEN f.person_id ELSE coalesce(o.id, s.person_id) END AS person_id, f.pinned FROM faces f JOIN stable s ON s.face_id = f.id LEFT JOIN opened o ON o.tentative = s.person_id)",
    "faces",
    "persons",
)


_oracle["regrouped_persons"] = _pairs_oracle(
    "SELECT e.id, e.name, e.color, (SELECT count(*) FROM moved m WHERE m.person_id = e.id) AS face_count FROM everyone e WHERE (SELECT count(*) FROM moved m WHERE m.person_id = e.id) > 0 OR NOT regexp_full_match(e.name, 'Persona [0-9]+')",
    _UNITS.format("0.45e0")
    + ", "
    + _STABLE
    + f", free AS (SELECT color, row_number() OVER (ORDER BY pos) AS place FROM {_PALETTE} WHERE color NOT IN (SELECT color FROM persons)), "
    "placed AS (SELECT person_id AS tentative, place, (SELECT max(id) FROM persons) + place AS id, 'Persona ' || cast((SELECT count(*) FROM persons) + place AS VARCHAR) AS name, "
    "((place - 1 + (SELECT count(DISTINCT color) FROM persons)) * 47) % 360 / 360e0 AS h, 0.85e0 AS v, 0.85e0 * (1e0 - 0.65e0) AS p FROM (SELECT person_id, row_number() OVER (ORDER BY min(face_id)) AS place FROM stable WHERE person_id < 0 GROUP BY person_id)), "
    "opened AS (SELECT *, 0.85e0 * (1e0 - 0.65e0 * (h * 6 - floor(h * 6))) AS q, 0.85e0 * (1e0 - 0.65e0 * (1e0 - (h * 6 - floor(h * 6)))) AS t FROM placed), "
    f"everyone AS (SELECT id, name, color FROM persons UNION ALL SELECT o.id, o.name, coalesce(f.color, {_HEX}) FROM opened o LEFT JOIN free f ON f.place = o.place), "
    "moved AS (SELECT f.id, CASE WHEN f.pinned THEN f.person_id ELSE coalesce(o.id, s.person_id) END AS person_id FROM faces f JOIN stable s ON s.face_id = f.id LEFT JOIN opened o ON o.tentative = s.person_id)",
    "faces",
    "persons",
)


_oracle["cluster_quality"] = _pairs_oracle(
    "SELECT (SELECT sum(m) / sum(t) FROM of_cluster) AS purity, (SELECT sum(m) / sum(t) FROM of_label) AS completeness, (SELECT max(k) FROM of_cluster) = 1 AND (SELECT max(k) FROM of_label) = 1 AS same_partition",
    _UNITS.format("0.45e0")
    + ", counted AS (SELECT cluster_id, person_id AS label, count(*) AS n FROM found JOIN faces ON id = face_id WHERE person_id IS NOT NULL GROUP BY ALL), "
    "of_cluster AS (SELECT max(n) AS m, sum(n) AS t, count(*) AS k FROM counted GROUP BY cluster_id), of_label AS (SELECT max(n) AS m, sum(n) AS t, count(*) AS k FROM counted GROUP BY label)",
    "faces",
)
