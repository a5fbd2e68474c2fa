"""Views over the test tables that stand for a media library: the text is the same in Spark SQL and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinfold.runtime import table

PHOTOS = """
SELECT doc_id AS id,
 '/lib/' || source || '/IMG_' || lpad(cast(doc_id AS string),6,'0') || CASE doc_id % 5 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' ELSE '.jpg' END AS path,
 cast(1700000000 + doc_id * 60 AS double) AS mtime, n_chars AS size,
 cast(720 + 240 * (doc_id % 2) AS bigint) AS width, cast(960 - 240 * (doc_id % 2) AS bigint) AS height,
 CASE WHEN doc_id % 6 = 5 THEN cast(NULL AS string) ELSE '2025-' || lpad(cast(1 + doc_id % 12 AS string),2,'0') || '-' || lpad(cast(1 + doc_id % 28 AS string),2,'0') || 'T' || lpad(cast(doc_id % 24 AS string),2,'0') || ':' || lpad(cast(doc_id % 60 AS string),2,'0') || ':00' END AS exif_date,
 CASE WHEN doc_id % 4 = 2 THEN 46.5e0 + 0.25e0 * (doc_id % 64) END AS exif_lat,
 CASE WHEN doc_id % 4 = 2 THEN 6.5e0 - 0.5e0 * (doc_id % 32) END AS exif_lon,
 CASE WHEN doc_id % 13 = 12 THEN cast(NULL AS string) WHEN doc_id % 17 = 16 THEN '0000000000000000'
      WHEN cast(floor(doc_id / 3) AS bigint) % 8 = 0 THEN substr(md5(cast(cast(floor(doc_id / 3) AS bigint) AS string)),1,15) || CASE doc_id % 3 WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE '3' END
      WHEN cast(floor(doc_id / 3) AS bigint) % 8 = 4 THEN substr(md5(cast(cast(floor(doc_id / 3) AS bigint) AS string)),1,14) || CASE doc_id % 3 WHEN 0 THEN '00' WHEN 1 THEN '0f' ELSE 'ff' END
      ELSE substr(md5('p' || cast(doc_id AS string)),1,16) END AS phash,
 CASE WHEN doc_id % 23 = 22 THEN cast(NULL AS double) ELSE 1.7e9 END AS analyzed_at
FROM documents
"""

FACES = """
SELECT vec_id + 1 AS id, vec_id % 200 AS photo_id,
 CASE WHEN vec_id % 11 = 0 THEN cast(NULL AS bigint) ELSE cast(label + 1 AS bigint) END AS person_id,
 cast(vec_id % 37 AS double) AS x, cast(vec_id % 53 AS double) AS y, cast(20 + vec_id % 9 AS double) AS w, cast(24 + vec_id % 7 AS double) AS h,
 embedding, vec_id % 7 = 0 AS pinned, 0.75e0 + (vec_id % 16) / 64e0 AS confidence
FROM embeddings
"""

PERSONS = """
SELECT DISTINCT cast(label + 1 AS bigint) AS id, CASE WHEN label = 3 THEN 'Alice' ELSE 'Persona ' || cast(label + 1 AS string) END AS name,
 CASE label % 4 WHEN 0 THEN '#e6194b' WHEN 1 THEN '#3cb44b' WHEN 2 THEN '#ffe119' ELSE '#4363d8' END AS color FROM embeddings
UNION ALL SELECT cast(r_regionkey + 101 AS bigint), CASE WHEN r_regionkey % 2 = 0 THEN 'Persona ' || cast(r_regionkey + 101 AS string) ELSE 'Grandma ' || r_name END, '#000000' FROM region
"""

TAGS = """
SELECT cast(n_nationkey + 1 AS bigint) AS id, lower(n_name) AS name FROM nation
"""

PHOTO_TAGS = """
SELECT DISTINCT doc_id AS photo_id, cast(doc_id % 7 + 1 AS bigint) AS tag_id FROM documents
UNION SELECT doc_id, cast(10 + quality AS bigint) FROM labels UNION SELECT doc_id, cast(8 AS bigint) FROM labels WHERE toxic = 1
"""

DETECTIONS = """
SELECT id - 1 AS det_id, photo_id, x + (id % 5) AS x, y + (id % 4) AS y, w, h + (id % 3) AS h FROM faces WHERE id % 10 <> 0
"""

EXIF_RAW = """
SELECT event_id AS photo_id,
 CASE WHEN event_id % 19 = 0 THEN cast(NULL AS string) WHEN event_id % 23 = 0 THEN 'garbage' ELSE
 lpad(cast(CASE WHEN event_id % 29 = 0 THEN 0 ELSE 2015 + event_id % 10 END AS string),4,'0') || ':' || lpad(cast(event_id % 14 AS string),2,'0') || ':' || lpad(cast(event_id % 33 AS string),2,'0') || CASE WHEN event_id % 2 = 0 THEN ' ' ELSE 'T' END || lpad(cast(event_id % 26 AS string),2,'0') || ':' || lpad(cast(event_id % 61 AS string),2,'0') || ':' || lpad(cast(event_id % 62 AS string),2,'0') END AS dt,
 cast(event_id % 97 AS double) AS lat_d, cast(event_id % 61 AS double) AS lat_m, cast(event_id % 60 AS double) AS lat_s,
 CASE event_id % 8 WHEN 0 THEN 'N' WHEN 1 THEN 'S' WHEN 2 THEN 'n' WHEN 3 THEN ' S ' WHEN 4 THEN 'E' WHEN 5 THEN cast(NULL AS string) WHEN 6 THEN '' ELSE 'North' END AS lat_ref,
 cast(event_id % 190 AS double) AS lon_d, cast(event_id % 59 AS double) AS lon_m, cast(0 AS double) AS lon_s,
 CASE event_id % 3 WHEN 0 THEN 'E' WHEN 1 THEN 'w' ELSE 'W' END AS lon_ref
FROM events
"""

SCAN = """
SELECT path, CASE WHEN id % 5 = 4 THEN mtime + 1 ELSE mtime END AS mtime, CASE WHEN id % 9 = 8 THEN size + 1 ELSE size END AS size FROM photos WHERE id % 10 <> 3
UNION ALL SELECT '/lib/new/' || cast(page_id AS string) || '.jpg', 1.8e9, cast(length(url) AS bigint) FROM pages
"""

DIR_EVENTS = """
SELECT event_id, user_id % 8 AS dir_id, ts FROM events
"""

SCAN_FILES = """
SELECT event_id AS id, '/in.d/' || CASE event_id % 9 WHEN 0 THEN 'a.JPG' WHEN 1 THEN '.jpg' WHEN 2 THEN 'x.tar.png' WHEN 3 THEN 'noext' WHEN 4 THEN 'b.webp' WHEN 5 THEN 'c.tiff.' WHEN 6 THEN 'd.Jpeg' WHEN 7 THEN 'e.txt' ELSE 'sub.png/f' END AS path FROM events
"""

SETTINGS = """
SELECT event_id, CASE event_id % 8 WHEN 0 THEN ' Yes ' WHEN 1 THEN '0' WHEN 2 THEN cast(NULL AS string) WHEN 3 THEN 'on' WHEN 4 THEN 'TRUE' WHEN 5 THEN '   ' WHEN 6 THEN '1' ELSE 'no' END AS raw FROM events
"""

#: Each view with the views and tables that its text names.
TEXTS = {
    "photos": (PHOTOS, ("documents",)),
    "faces": (FACES, ("embeddings",)),
    "persons": (PERSONS, ("embeddings", "region")),
    "tags": (TAGS, ("nation",)),
    "photo_tags": (PHOTO_TAGS, ("documents", "labels")),
    "detections": (DETECTIONS, ("faces",)),
    "exif_raw": (EXIF_RAW, ("events",)),
    "scan": (SCAN, ("photos", "pages")),
    "dir_events": (DIR_EVENTS, ("events",)),
    "scan_files": (SCAN_FILES, ("events",)),
    "settings": (SETTINGS, ("events",)),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view over the tables in ``sf_dir``; a name that is no view is a table."""
    if name not in TEXTS:
        return table(spark, sf_dir, name)
    text, needs = TEXTS[name]
    return spark.sql(_braced(text, needs), **{n: view(spark, sf_dir, n) for n in needs})


def _braced(text: str, needs: tuple[str, ...]) -> str:
    """The view's text with the tables that it reads as parameters."""
    for n in needs:
        text = text.replace(f"FROM {n}", "FROM {" + n + "}")
    return text


def with_views(query: str, *names: str) -> str:
    """``query`` for DuckDB with the views it needs as common table expressions."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in TEXTS[name][1]:
            if n in TEXTS:
                need(n)
        if name not in order:
            order.append(name)

    for n in names:
        need(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({TEXTS[n][0].strip()})" for n in order) + "," * bool(order) + "\n" + query
