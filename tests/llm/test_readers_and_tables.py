"""Foreign archives with broken records, shift tables of a whole block, benchmarks in several blocks, and many languages."""

import gzip
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import decontamination, language_id, warc


def record(number, body, headers=(), http=(), length=None, kind="response"):
    head = "HTTP/1.1 200 OK\r\n" + "".join(f"{k}: {v}\r\n" for k, v in http) + "\r\n"
    block = head.encode() + body
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:{number}>", "Content-Type: application/http; msgtype=response", *(f"{k}: {v}" for k, v in headers)]
    if length != "none":
        lines.append(f"Content-Length: {len(block) if length is None else length}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@pytest.fixture
def archive(spark, tmp_path):
    def make(*records, name="a.warc"):
        (tmp_path / name).write_bytes(b"".join(records))
        return f"file://{tmp_path}"

    return make


def digest(body):
    return f"sha1:{warc.base32_sha1(body)}"


def test_length_filters_keep_records_of_other_writers(spark, archive):
    path = archive(record(1, b"longer body"), record(2, b""), record(3, b"xyz", [("X-Payload-Length", "3")]))
    read = warc.read_archive(spark, path, foreign=True)
    assert {r["record_id"]: r["payload_length"] for r in read.collect()} == {"<urn:1>": 11, "<urn:2>": 0, "<urn:3>": 3}
    ids = lambda df: sorted(r["record_id"] for r in df.collect())
    assert ids(read.where("payload_length > 0")) == ["<urn:1>", "<urn:3>"] and ids(read.where("payload_length = 0")) == ["<urn:2>"]
    assert ids(read.where("payload_length <> 3")) == ["<urn:1>", "<urn:2>"] and ids(read.where("payload_length IN (3, 11)")) == ["<urn:1>", "<urn:3>"]
    assert ids(read.where("payload_length > 5 AND record_type = 'response'")) == ["<urn:1>"]


def test_codings_and_digests_of_either_form(spark, archive):
    body = b"some text " * 20
    packed, chunked = gzip.compress(body), b"a;x=1\r\n0123456789\r\n3\r\nabc\r\n0\r\n\r\n"
    raw = zlib.compressobj(wbits=-15)
    bare = raw.compress(body) + raw.flush()
    in_chunks = b"%x\r\n%s\r\n0\r\n\r\n" % (len(packed), packed)
    path = archive(
        record(1, packed, [("WARC-Payload-Digest", digest(packed))], [("Content-Encoding", "gzip")]),
        record(2, packed, [("WARC-Payload-Digest", digest(body))], [("Content-Encoding", "gzip")]),
        record(3, chunked, [("WARC-Payload-Digest", digest(b"0123456789abc"))], [("Transfer-Encoding", "chunked")]),
        record(4, in_chunks, [("WARC-Payload-Digest", digest(packed))], [("Transfer-Encoding", "chunked"), ("Content-Encoding", "gzip")]),
        record(5, zlib.compress(body), (), [("Content-Encoding", "deflate")]),
        record(6, bare, (), [("Content-Encoding", "deflate")]),
        record(7, b"brotli", (), [("Content-Encoding", "br")]),
    )
    assert warc.read_archive(spark, path, payload="verify", foreign=True).count() == 7
    found = {r["record_id"][5:-1]: bytes(r["payload"]) for r in warc.read_archive(spark, path, foreign=True).collect()}
    assert found == {"1": body, "2": body, "3": b"0123456789abc", "4": body, "5": body, "6": body, "7": b"brotli"}


def test_broken_records_end_the_read_or_are_kept(spark, archive):
    bad = gzip.compress(b"text " * 100)[:-20]
    path = archive(
        record(1, b"good"), record(2, bad, (), [("Content-Encoding", "gzip")]), record(3, b"no length", length="none"), record(4, b"fine"),
        record(5, b"xx", [("WARC-Payload-Digest", digest(b"yy"))]), record(6, b"cut", length=9999),
    )
    with pytest.raises(Exception, match="EOFError|Compressed file ended"):
        warc.read_archive(spark, path, foreign=True).collect()
    rows = {r["record_id"][5:-1]: r for r in warc.read_archive(spark, path, foreign=True, errors="keep").collect()}
    assert sorted(rows) == ["1", "2", "3", "4", "5", "6"]
    assert {k for k, r in rows.items() if r["error"]} == {"2", "3", "6"} and all(rows[k]["payload"] is None for k in "236")
    assert bytes(rows["1"]["payload"]) == b"good" and bytes(rows["4"]["payload"]) == b"fine" and "Content-Length" in rows["3"]["error"]
    checked = {r["record_id"][5:-1]: r["error"] for r in warc.read_archive(spark, path, payload="verify", foreign=True, errors="keep").collect()}
    assert "not what its headers say" in checked["5"] and checked["1"] is None
    with pytest.raises(Exception, match="no Content-Length"):
        warc.read_archive(spark, path, payload="skip", foreign=True).collect()


def test_archives_cut_within_a_member(spark, archive):
    whole = gzip.compress(record(1, b"one")) + gzip.compress(record(2, b"two" * 500))
    path = archive(whole[:-25], name="b.warc.gz")
    with pytest.raises(Exception):
        warc.read_archive(spark, path, foreign=True).collect()
    rows = {r["record_id"]: r["error"] for r in warc.read_archive(spark, path, foreign=True, errors="keep").collect()}
    assert rows["<urn:1>"] is None and all(e for k, e in rows.items() if k != "<urn:1>")


def test_the_shift_table_skips_at_a_whole_block():
    rng = np.random.default_rng(1)
    words = [f"w{k}".encode() for k in range(30_000)]
    items = [(str(k), [words[i] for i in rng.integers(0, len(words), 2509)]) for k in range(100)]
    matcher = decontamination.build(items)
    (table,) = matcher.tables
    assert len(table.texts) >= 249_000 and table.shift.nbytes <= 64 << 20
    ids = rng.integers(1, len(words) + 1, 200_000).astype(np.int32)
    at = np.arange(9, len(ids))
    assert decontamination.shifts(table, ids, at).mean() > 6
    # A word that the benchmark lacks is skipped over whole.
    ids[1000] = 0
    assert decontamination.shifts(table, ids, np.array([1000, 1001])).tolist() == [10, 9]


def test_benchmarks_in_several_blocks(spark):
    rng = np.random.default_rng(7)
    vocabulary = [f"v{k}" for k in range(400)]
    text = lambda n: " ".join(vocabulary[i] for i in rng.integers(0, 400, n))
    items = [(k, text(60)) for k in range(30)] + [(100, "v1"), (101, "v2 v3"), (102, None)]
    docs = []
    for k in range(60):
        parts = [text(40)]
        for j in rng.integers(0, 30, k % 4):
            words = items[j][1].split()
            at = int(rng.integers(0, 40))
            parts.append(" ".join(words[at : at + 14]))
        docs.append((k if k % 9 else None, " ".join(parts), k))
    docs += [(1, docs[1][1], 0), (1, docs[1][1], 0), (2, None, 0), (3, "", 0)]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string, key int").repartition(4)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    wanted = sorted(map(str, decontamination.contamination(documents, bench).collect()))
    assert len(decontamination.blocks(bench, patterns=350)) >= 4
    assert sorted(map(str, decontamination.contamination(documents, bench, patterns=350).collect())) == wanted
    kept = sorted(map(str, decontamination.keep_clean(documents, bench).collect()))
    assert sorted(map(str, decontamination.keep_clean(documents, bench, patterns=350).collect())) == kept and len(kept) < len(docs)


def test_three_hundred_languages_are_learned(spark):
    rng = np.random.default_rng(3)
    rows = []
    for lang in range(300):
        letters = hashlib.sha256(str(lang).encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop"))
        words = [letters[i : i + 5] for i in range(0, 30, 5)]
        rows += [(lang * 20 + k, " ".join(rng.choice(words, 40)), f"l{lang}") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    model = language_id.fit(docs, F.lit(True))
    assert len(model.languages) == 300
    found = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").select("lang", "lang_pred").collect()
    assert {r["lang_pred"] for r in found} == {f"l{k}" for k in range(300)}
    assert sum(r["lang"] == r["lang_pred"] for r in found) > 0.95 * len(found)
