"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import decontamination, language_id, language_model, mixing, quality_classifier, quality_rules, simhash, substring_dedup, url_filter, warc
from kinfold.runtime import scratch_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, fp bigint, key bigint, block bigint, kept boolean, label int, rank int, target double"
_PASSAGE = " ".join(f"w{i}" for i in range(30))
_LONG = " ".join(f"long{i % 9973}" for i in range(120_000))


def _row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, len(text or ""), 1, 2, 3, 4, True, 5, 6, 7.0)


ROWS = [
    _row(1, _PASSAGE),
    _row(2, _PASSAGE),
    _row(2, _PASSAGE),
    _row(3, None, None, None),
    _row(4, ""),
    _row(5, " \n\t "),
    _row(None, "a document without id " + _PASSAGE, "fr", "b"),
    _row(6, _LONG, "de", "b"),
    _row(7, "$$$ ### 123", None, "c"),
    _row(8, "ä ö ü ß éé x", "de", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, None), (3, None, 1)], "doc_id bigint, quality int, toxic int")


def words(text):
    return (text or "").encode().split()


def test_quality_rules(docs, labels):
    rows = quality_rules.judge(docs, quality_rules.fit(docs, labels)).collect()
    assert len(rows) == len(ROWS)
    long = next(r for r in rows if r["doc_id"] == 6)
    assert long["n_words"] == 120_000 and long["n_repeat_words"] == 120_000 and long["base_failed"] and not long["kept"]
    assert quality_rules.judge(docs.limit(0), None).count() == 0
    assert quality_rules.keep_good(docs, labels).columns == docs.columns


def test_language_id(docs):
    rows = language_id.predict(docs, language_id.fit(docs, F.lit(True))).collect()
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert len(rows) == len(ROWS) and und == {3, 4, 5, 7} and all(0 <= r["score"] <= 1 for r in rows)
    assert language_id.fit(docs.limit(0), F.lit(True)) is None
    assert {r["lang_pred"] for r in language_id.predict(docs, None).collect()} == {"und"}


def test_quality_classifier(docs, labels):
    rows = quality_classifier.score(docs, quality_classifier.fit(docs, labels, F.lit(True))).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality_classifier.score(docs.limit(0), None).count() == 0


def test_simhash(docs):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    of = {r["doc_id"]: r["component_id"] for r in rows}
    assert of[2] == of[1] == 1 and of[4] == of[5] == of[3] == 3
    assert {r["fp"] for r in rows if r["doc_id"] in (3, 4, 5)} == {0}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] in (1, 2, 3, 4, 5)) == [1, 3]


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(10, " ".join(f"W{i}" for i in range(5, 17)), 0), (2, "w5, w6-w7 w8 w9 w10 w11 w12 w13 w14 w15", 0), (2, "nowhere", 0), (11, None, 0), (None, "w1", 0), (12, "ß", 0), (13, "", 0)], "item_id bigint, text string, size int")
    rows = {r["doc_id"]: r for r in decontamination.contamination(docs, bench).collect()}
    assert rows[1]["n_words"] == 30 and rows[1]["n_hit"] == 12 and rows[1]["n_items"] == 2
    assert rows[1]["items_sha256"] == hashlib.sha256(b"10,2").hexdigest() and rows[8]["n_items"] == 1 and rows[8]["n_hit"] == 1
    assert rows[3]["n_words"] == 0 and rows[6]["n_hit"] == 0 and not rows[4]["contaminated"]
    # Every pass but the last is written before the next: one matcher is alive at a time, also for an item that is longer than a block.
    passes = decontamination.contamination(docs, bench, patterns=2)
    assert len(decontamination.blocks(bench, patterns=2)) > 2 and passes._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {r["doc_id"]: tuple(r) for r in passes.collect()} == {k: tuple(r) for k, r in rows.items()}
    assert decontamination.keep_clean(docs, bench, patterns=2)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert decontamination.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.contamination(docs.limit(0), bench).count() == 0
    assert sorted(r["doc_id"] for r in decontamination.keep_clean(docs, bench).collect()) == [3, 4, 5, 6, 7]


def test_substring_dedup(docs):
    rows = substring_dedup.repeats(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_removed"] == 0 and by[2]["n_removed"] == 30 and by[None]["n_removed"] == 30 and by[6]["n_removed"] == 0
    assert by[None]["kept_sha256"] == hashlib.sha256(b"a document without id").hexdigest()
    assert substring_dedup.repeats(docs.limit(0)).count() == 0
    cut = {r["doc_id"]: r for r in substring_dedup.drop_repeats(docs).collect()}
    assert cut[2]["text"] == "" and cut[2]["n_chars"] == 0 and cut[1]["text"] == _PASSAGE and cut[3]["text"] is None and cut[5]["text"] == " \n\t "


def test_ids_are_whole_numbers(docs):
    named = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    for apply in (simhash.near_duplicates, substring_dedup.repeats, mixing.taken, lambda d: quality_rules.judge(d, None), lambda d: language_id.predict(d, None), lambda d: quality_classifier.score(d, None), lambda d: language_model.score(d, F.lit(False)), lambda d: decontamination.contamination(d, d)):
        with pytest.raises(TypeError, match="whole numbers"):
            apply(named)


def test_mixing(spark, docs):
    rows = mixing.taken(docs).collect()
    total = sum(len(words(r[1])) for r in ROWS)
    assert len(rows) == len(ROWS) and sum(r["size"] for r in rows) == total
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    sources = {r["source"]: (r["source_size"], r["target"]) for r in rows}
    for source, (size, target) in sources.items():
        assert abs(sum(r["taken"] for r in rows if r["source"] == source) - target) <= 1 and target <= 2 * size
    assert sum(t for _, t in sources.values()) == pytest.approx(1.5 * total)
    assert mixing.taken(docs.limit(0)).count() == 0
    clashing = docs.withColumn("_mix_row", F.lit(1)).withColumn("_mix_number", F.lit(2))
    assert set(clashing.columns) <= set(mixing.with_taken(clashing).columns)
    # A third of the rows have no id and as many words: they are one stream like any other.
    same = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.lit("a b c d e").alias("text"), F.lit("s").alias("source"))
    parts = mixing.taken(same).collect()
    assert len(parts) == 3000 and sum(r["taken"] for r in parts) == 22_500 and all(r["taken"] <= 10 for r in parts)
    full = mixing.with_taken(docs)
    assert full.count() == len(ROWS) and set(docs.columns) <= set(full.columns)


def test_language_model(docs):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    rows = language_model.score(docs, held, windows=50).collect()
    assert len(rows) == len(ROWS)
    learned = [words((r[1] or "").lower()) for r in ROWS if r[0] is None or zlib.crc32(str(r[0]).encode()) % 10]
    assert {r["train_tokens"] for r in rows} == {sum(map(len, learned)) + len(learned)}
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)} == {1} and all(r["score"] < 0 and r["base_score"] < 0 for r in rows)
    assert language_model.score(docs.limit(0), held, windows=50).count() == 0


def test_urls(spark):
    rows = [
        (1, "HTTP://WWW.Example.NET/en/x?y#z", "net/"), (2, "http://a.org/fr/", None), (3, "http://a.org", None), (4, None, None), (5, "no scheme", None), (6, "https://m.cheap-pills.example.com/x/", None),
        (6, "https://m.cheap-pills.example.com/x/", None), (7, "http://example.net/de/", "q"), (8, "http://foo.net", None), (None, "://h?://x/", None), (9, "http://notcheap-pills.example.com/", None), (10, "http://" + "a." * 5000 + "com/" + "p" * 10000, None),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, rule string")
    got = url_filter.judge(pages, url_filter.production_list(spark)).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert by[1] == ("www.example.net", "/en/x", "example.net/en/", "allow") and by[2][2:] == ("org/fr/", "allow") and by[3] == ("a.org", "", None, "allow")
    assert by[4] == by[5] == ("", "", None, "allow") and by[6][2:] == (None, "block") and by[7][2:] == ("net/", "block")
    assert by[8] == ("foo.net", "", None, "allow") and by[None] == ("h", "", None, "allow") and by[9][3] == "allow" and by[10][3] == "allow"
    assert url_filter.judge(pages.limit(0), url_filter.production_list(spark).limit(0)).count() == 0


def test_long_hosts_have_listed_sites(spark):
    urls = ["http://" + "a" * 300 + ".casino-win.example.com/", "http://" + "a." * 300 + "casino-win.example.com/x", "http://" + "a" * 300 + ".example.com/", "http://" + "a." * 300 + "b/p"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r["page_id"]: (r["listed"], r["verdict"]) for r in url_filter.judge(pages, url_filter.production_list(spark)).collect()}
    assert got == {0: (True, "block"), 1: (True, "block"), 2: (False, "allow"), 3: (False, "allow")}
    deep = spark.createDataFrame([("a.b.c.d.e/",), ("one/",), ("x.y/page",)], "key string")
    pages = spark.createDataFrame([(0, "http://z.a.b.c.d.e/"), (1, "http://one/"), (2, "http://www.x.y/page/"), (3, "http://b.c.d.e/")], "page_id bigint, url string")
    assert {r["page_id"]: r["listed"] for r in url_filter.judge(pages, deep).collect()} == {0: True, 1: True, 2: True, 3: False}


def test_keys_are_canonical(spark):
    urls = ["http://user:pw@ADS-track.example.com:8080/x", "http://ads-track.example.com./", "http://ads%2Dtrack.example.com/", "https://www.tionble.example.org:443/en/25/?q", "http://tionble.example.org/en/26", "http://site19999.listed.example", "http://site20000.listed.example/", "http://a@b/%zz"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r["page_id"]: r["listed"] for r in url_filter.judge(pages, url_filter.production_list(spark)).collect()}
    assert got == {0: True, 1: True, 2: True, 3: True, 4: False, 5: True, 6: False, 7: False}
    listed = spark.createDataFrame([("HTTP://Shop.example.com:80/",), ("http://www.news.example/a%20b/",), ("nothing",), (None,)], "url string")
    assert {r["key"] for r in url_filter.canonical(listed).collect()} == {"shop.example.com/", "news.example/a b"}


def test_false_positives_of_the_filter_are_allowed(spark):
    """A filter of one block is full: every page passes it, and the exact join decides alone."""
    listed = spark.range(5000).select(F.concat(F.lit("bad"), F.col("id").cast("string"), F.lit(".example/")).alias("key"))
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("http://"), F.when(F.col("id") % 4 == 0, F.lit("bad")).otherwise(F.lit("good")), F.col("id").cast("string"), F.lit(".example/x")).alias("url"))
    blocks = url_filter.build_filter(listed, url_filter.filter_blocks(5000, most_bytes=32))
    assert len(blocks) == 1 and (blocks == np.uint64(2**64 - 1)).all()
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, listed, most_filter_bytes=32).collect()}
    assert got == {i: "block" if i % 4 == 0 else "allow" for i in range(400)}


def test_filter_has_no_false_negatives(spark):
    listed = spark.range(20_000).select(F.concat(F.lit("h"), F.col("id"), F.lit(".com/")).alias("key"))
    blocks = url_filter.filter_blocks(20_000)
    made = url_filter.build_filter(listed, blocks)
    hashes = lambda df: df.select(F.xxhash64("key"), url_filter.bits_hash(F.col("key"))).toPandas().to_numpy().T
    assert url_filter.probe(made, *hashes(listed)).all()
    others = spark.range(20_000).select(F.concat(F.lit("x"), F.col("id"), F.lit(".com/")).alias("key"))
    assert url_filter.probe(made, *hashes(others)).mean() < 0.02
    assert url_filter.filter_blocks(10**9, most_bytes=1 << 20) == 1 << 15


def test_warc_round_trip(spark):
    html = ["<p>é</p>" * 50, "<p>é</p>" * 50, None, "", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "y" * 300_000]
    rows = [(i, f"http://h/{i}\r\nX: y" if i == 0 else None, h, "response") for i, h in enumerate(html)] + [(None, "u", "y" * 300_000, "z"), (5, "again", "y" * 300_000, "z")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, record_type string")
    path = scratch_path(spark, "test-archive")
    warc.write_archive(warc.records_of(pages), path)
    read = warc.read_archive(spark, path)
    got = read.collect()
    assert len(got) == len(rows)
    responses = {r["record_id"]: bytes(r["payload"]).decode() for r in got if r["record_type"] == "response"}
    assert responses == {"<urn:page:1>": html[1], "<urn:page:3>": "", "<urn:page:4>": html[4], "<urn:page:5>": html[5]}
    revisits = {(r["record_id"], r["refers_to"]) for r in got if r["record_type"] == "revisit"}
    assert revisits == {("<urn:page:0>", "<urn:page:1>"), ("<urn:page:2>", "<urn:page:3>"), ("<urn:page:none>", "<urn:page:5>")}
    assert all(r["payload_digest"] == warc.base32_sha1((html[r_id] or "").encode()) for r in got if (r_id := int(r["record_id"][10:-1]) if "none" not in r["record_id"] else 5) is not None)
    pushed = warc.read_archive(spark, path, "skip").where((F.col("record_type") == "revisit") & F.col("payload_length").between(100, 1000))
    assert [r["record_id"] for r in pushed.collect()] == ["<urn:page:0>"]
    warc.write_archive(warc.records_of(pages.limit(0)), empty := scratch_path(spark, "test-empty"))
    assert warc.read_archive(spark, empty).count() == 0
    moved = {tuple(r)[:6] for r in warc.records_of(pages, broadcast_payloads=0).collect()}
    assert moved == {tuple(r)[:6] for r in warc.records_of(pages).collect()}
    small = warc.records_of(pages, least_bytes=1_000).groupBy("record_type").count().collect()
    assert {r["record_type"]: r["count"] for r in small} == {"response": 7, "revisit": 1}


def test_warc_modes(spark):
    pages = lambda *ids: spark.createDataFrame([(i, "http://h/", f"<p>{i}</p>" * 40) for i in ids], "page_id bigint, url string, html string")
    ids = lambda path, **more: sorted(r["record_id"] for r in warc.read_archive(spark, path, **more).collect())
    name = lambda *own: [f"<urn:page:{i}>" for i in own]
    path = scratch_path(spark, "test-modes")
    warc.write_archive(warc.records_of(pages(1, 2)), path)
    warc.write_archive(warc.records_of(pages(3)), path)
    assert ids(path) == name(1, 2, 3)
    warc.write_archive(warc.records_of(pages(4, 5)), path, mode="overwrite", compression="gzip")
    assert ids(path) == name(4, 5) and ids(path, payload="verify") == name(4, 5)
    store, folder = warc.store_of(path)
    assert all(n.startswith("_committed-") or n.endswith(".warc.gz") for n in warc.listing(store, folder))
    assert ids(path, foreign=True) == name(4, 5)
    pushed = warc.read_archive(spark, path, "skip").where(F.col("record_id") == "<urn:page:5>")
    assert [(r["record_id"], r["payload"]) for r in pushed.collect()] == [("<urn:page:5>", None)]


def test_warc_of_another_writer(spark):
    path = scratch_path(spark, "test-foreign")
    store, folder = warc.store_of(path)
    store.create_dir(folder, recursive=True)
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hi</p>"
    with store.open_output_stream(f"{folder}/a.warc") as file:
        file.write(warc.info_bytes("a.warc"))
        file.write(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nWARC-Target-URI: http://h/\r\nContent-Type: application/http;\r\n msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n")
    with pytest.raises(Exception, match="no manifest"):
        warc.read_archive(spark, path).collect()
    row = warc.read_archive(spark, path, foreign=True).first()
    assert (row["record_id"], row["payload_length"], bytes(row["payload"])) == ("<urn:x>", 9, b"<p>hi</p>")


def test_a_failed_write_is_not_read(spark):
    path = scratch_path(spark, "test-failed")
    good = warc.records_of(spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "page_id bigint, url string, html string"))
    # The second record can't be written: a payload_length that fails when it is computed.
    bad = good.withColumn("payload_length", F.when(F.col("record_id") == "<urn:page:2>", F.raise_error(F.lit("stop")).cast("bigint")).otherwise(F.col("payload_length")))
    with pytest.raises(Exception, match="stop"):
        warc.write_archive(bad.coalesce(1), path)
    with pytest.raises(Exception, match="no manifest"):
        warc.read_archive(spark, path).collect()
