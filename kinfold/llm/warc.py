"""Operator 8, WARC: a Python data source that writes and reads web archives, and the revisit rule on top of it.

Writing: each task writes whole files of at most ``roll_bytes`` under names of its own, each with a warcinfo record
first, and the driver commits their names in one numbered manifest when all tasks are done. Files of lost, failed or
repeated attempts are in no manifest and are never read. A write in mode overwrite says so in its manifest, from which on
earlier ones don't count; their files are deleted afterwards. ``compression`` gzip makes each record a gzip member of its own.
Reading: files are packed into partitions of bounded size; the headers of a record are
parsed first, and a record that fails a pushed filter on its type or a header is skipped by its stated
length, without reading, decoding or digesting its payload (in a compressed file it is inflated and thrown away). ``payload``
says what happens to the others: ``decode`` returns it, ``verify`` decodes it and compares length and digest with the headers, ``skip``
leaves it alone. A file is read by one task, since a record's text may look like the start of another. A folder without
a manifest is an error, as its write may not have ended; the option ``foreign`` reads archives of other writers,
all ``.warc`` and ``.warc.gz`` files in a folder.

A payload is the body of an HTTP response, gzip-coded where that is shorter. Digest and length in the headers are
those of the full payload before coding; where a foreign record states no length, that of the decoded payload is given.
Paths are URIs of any store that pyarrow knows.

Defined results: a null text has an empty payload; equal payloads, empty ones included, are one response and
revisits from ``least_bytes`` on. Rows that repeat the largest page_id of their payload are all responses. A null
page_id is never the response of others. A record that can't be read is an error, or with ``errors="keep"`` a row with a null payload and the reason. Empty tables give an archive without files and an empty result.
Line ends and other control characters in a URL are percent-coded in its header.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    Not,
    WriterCommitMessage,
)

from kinfold import runtime
from kinfold.llm import hashed_features as hf

FORMAT = "kinfold_warc"
VERSION = b"WARC/1.1"
#: Written as the date of every record, so that archives of equal rows are equal.
DATE = "2026-01-01T00:00:00Z"
SCHEMA = "record_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_length bigint, payload binary, error string"
_ARROW = pa.schema([(n, pa.string()) for n in ("record_type", "record_id", "refers_to", "target_uri", "payload_digest")] + [("payload_length", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])
#: What reading a broken record raises.
_BROKEN = (ValueError, EOFError, OSError, zlib.error)
#: The header that each column is read from.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "refers_to": "warc-refers-to", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "payload_length": "x-payload-length"}
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_COMPARE = {EqualTo: "__eq__", GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__"}


def store_of(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_text(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(kind: str, record_id: str, refers_to: str | None, uri: str | None, digest: str, length: int, payload: bytes | None) -> bytes:
    """One record; a revisit has no payload of its own."""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", DATE)]
    if uri is not None:
        fields.append(("WARC-Target-URI", _header_text(uri)))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(length))]
    block = b""
    if kind == "revisit":
        fields += [("WARC-Refers-To", refers_to or ""), ("WARC-Profile", _REVISIT)]
    else:
        body, coding = payload or b"", b""
        packed = gzip.compress(body, 1, mtime=0) if len(body) > 64 else body
        if len(packed) < len(body):
            body, coding = packed, b"Content-Encoding: gzip\r\n"
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + coding + b"Content-Length: %d\r\n\r\n" % len(body) + body
        fields.append(("Content-Type", "application/http;msgtype=response"))
    fields.append(("Content-Length", str(len(block))))
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in fields)]) + b"\r\n\r\n" + block + b"\r\n\r\n"


def info_bytes(name: str) -> bytes:
    """The record that a file begins with."""
    block = b"software: kinfold\r\nformat: WARC File Format 1.1\r\n"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in fields)]) + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_headers(file, line: bytes | None = None) -> dict[str, str] | None:
    """The headers of the record that starts here, with lower-case names; None at the end of the file. ``line`` is its first line if that has been read."""
    line = file.readline() if line is None else line
    while line in (b"\r\n", b"\n"):
        line = file.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not the start of a WARC record: {line[:40]!r}")
    found, last = {}, None
    while (line := file.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise ValueError("the file ends within the headers of a record")
        if line[:1] in b" \t" and last:
            found[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, _, value = line.decode("utf-8", "replace").partition(":")
        last = name.strip().lower()
        found[last] = value.strip()
    return found


def unchunked(body: bytes) -> bytes:
    """The body of a message that was sent in chunks."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].partition(b";")[0], 16)
        if not size:
            return b"".join(out)
        if end + 2 + size > len(body):
            raise ValueError("a chunk is cut short")
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def forms_of(block: bytes, content_type: str) -> list[bytes]:
    """The payload of a block as it was sent, and in the forms that follow when its transfer coding and then its content codings are taken off.

    The last form is the payload. ``chunked``, ``gzip`` and ``deflate`` are known; with another coding the payload is what comes before it.
    """
    if "application/http" not in content_type:
        return [block]
    head, _, body = block.partition(b"\r\n\r\n")
    codings: dict[bytes, list[bytes]] = {b"transfer-encoding": [], b"content-encoding": []}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if (own := name.strip().lower()) in codings:
            codings[own] += [c.strip().lower() for c in value.split(b",")]
    forms = [body]
    # The coding that was put on last comes off first.
    for coding in [*reversed(codings[b"transfer-encoding"]), *reversed(codings[b"content-encoding"])]:
        if coding == b"chunked":
            forms.append(unchunked(forms[-1]))
        elif coding in (b"gzip", b"x-gzip"):
            forms.append(gzip.decompress(forms[-1]))
        elif coding == b"deflate":
            try:
                forms.append(zlib.decompress(forms[-1]))
            except zlib.error:
                # Some servers leave the wrapping out.
                forms.append(zlib.decompress(forms[-1], -zlib.MAX_WBITS))
        elif coding not in (b"", b"identity"):
            break
    return forms


class FilePartition(InputPartition):
    files: tuple[str, ...]

    def __init__(self, files):
        self.files = tuple(files)


@dataclass
class Written(WriterCommitMessage):
    files: tuple[str, ...]
    records: int


class WarcSource(DataSource):
    """Options: ``path``, ``payload`` (decode, verify, skip), ``foreign`` (true, false), ``errors`` (fail, keep), ``partition_bytes``, ``roll_bytes`` and ``compression`` (none, gzip).

    ``verify`` accepts a digest of the payload as it was sent or in any form with codings taken off. By default a record that can't be read ends the read; with ``errors`` set to keep it
    comes with what is known of it, a null payload and the reason in ``error``, and reading goes on with the next record that can be found.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.payload = options["path"], options.get("payload", "decode")
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))
        self.foreign = options.get("foreign", "false").lower() == "true"
        self.errors = options.get("errors", "fail")
        if self.errors not in ("fail", "keep"):
            raise ValueError("errors must be fail or keep")
        if self.payload not in ("decode", "verify", "skip"):
            raise ValueError("payload must be decode, verify or skip")
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = getattr(f, "attribute", ("",))[0]
            if column == "payload_length" and len(f.attribute) == 1:
                # Spark tests it, too: a record whose headers don't tell it has a length only when it is read.
                yield f
            if column in HEADERS and len(f.attribute) == 1 and type(f) in _COMPARE:
                self.tests.append((column, _COMPARE[type(f)], f.value))
            elif column in HEADERS and len(f.attribute) == 1 and isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif column in HEADERS and len(f.attribute) == 1 and isinstance(f, IsNotNull):
                self.tests.append((column, "known", None))
            elif isinstance(f, Not) and isinstance(f.child, EqualTo) and len(f.child.attribute) == 1 and f.child.attribute[0] in HEADERS and f.child.attribute[0] != "payload_length":
                self.tests.append((f.child.attribute[0], "__ne__", f.child.value))
            elif column != "payload_length":
                yield f

    def files(self) -> list[tuple[str, int]]:
        """Committed files and their sizes; of an archive of another writer, all files in it."""
        store, path = store_of(self.path)
        found = listing(store, path)
        if self.foreign:
            names = sorted(n for n in found if n.endswith((".warc", ".warc.gz")))
        else:
            current = standing(store, found)
            if current is None:
                raise FileNotFoundError(f"{self.path} has no manifest: its write has not ended, or another writer made it (option foreign)")
            names = sorted(current)
            if missing := [n for n in names if n not in found]:
                raise FileNotFoundError(f"committed files are gone: {missing[:3]}")
        return [(found[n].path, found[n].size) for n in names]

    def partitions(self):
        out, now, size = [], [], 0
        for path, own in self.files():
            if now and size + own > self.partition_bytes:
                out.append(FilePartition(now))
                now, size = [], 0
            now.append(path)
            size += own
        return [*out, FilePartition(now)]

    def wanted(self, row: dict) -> bool:
        for column, test, value in self.tests:
            own = row[column]
            if own is None and column == "payload_length":
                continue
            if own is None or test == "in" and own not in value or test.startswith("__") and getattr(own, test)(value) is not True:
                return False
        return True

    def records(self, file) -> Iterator[dict]:
        line = None
        while True:
            row = {c: None for c in (*HEADERS, "payload", "error")}
            try:
                headers = read_headers(file, line)
                if headers is None:
                    return
                line = None
                row |= {column: headers.get(name) for column, name in HEADERS.items()}
                row["payload_digest"] = (row["payload_digest"] or "").rpartition(":")[2] or None
                row["payload_length"] = int(row["payload_length"]) if row["payload_length"] else None
                if "content-length" not in headers:
                    raise ValueError(f"record {row['record_id']} has no Content-Length")
                length = int(headers["content-length"])
            except _BROKEN as e:
                if self.errors == "fail":
                    raise
                yield row | {"payload_length": None, "error": str(e)}
                line = self.next_start(file)
                if line is None:
                    return
                continue
            wanted = self.wanted(row)
            if self.payload == "skip" or row["record_type"] == "revisit" or not wanted:
                file.seek(file.tell() + length)
            else:
                try:
                    block = file.read(length)
                    if len(block) < length:
                        raise ValueError(f"record {row['record_id']} is cut short")
                    self.take(row, block, headers.get("content-type", ""))
                except _BROKEN as e:
                    if self.errors == "fail":
                        raise
                    row["error"] = f"{type(e).__name__}: {e}"
            if wanted:
                yield row

    def take(self, row: dict, block: bytes, content_type: str) -> None:
        """Puts the payload and its length into the row, or holds them against what the headers say."""
        forms = forms_of(block, content_type)
        payload = forms[-1]
        if self.payload == "verify" and (
            row["payload_digest"] not in (None, *(base32_sha1(f) for f in reversed(forms))) or row["payload_length"] not in (None, *(len(f) for f in forms))
        ):
            raise ValueError(f"payload of {row['record_id']} is not what its headers say")
        if row["payload_length"] is None:
            row["payload_length"] = len(payload)
        if self.payload == "decode":
            row["payload"] = payload

    def next_start(self, file) -> bytes | None:
        """The next line that begins a record."""
        try:
            while (line := file.readline()) and not line.startswith(b"WARC/"):
                pass
        except _BROKEN:
            return None
        return line or None

    def read(self, partition):
        store, _ = store_of(self.path)
        rows, held = [], 0
        for path in partition.files if partition else ():
            with store.open_input_file(path) as raw:
                file = _Buffered(_Inflated(raw) if path.endswith(".gz") else raw)
                for row in self.records(file):
                    rows.append(row)
                    held += 200 + len(row["payload"] or b"")
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def listing(store, folder: str) -> dict:
    """The files of a folder by their names."""
    from pyarrow import fs

    return {f.base_name: f for f in store.get_file_info(fs.FileSelector(folder, recursive=False, allow_not_found=True)) if f.is_file}


_MANIFEST = "_committed-"


def standing(store, found: dict) -> list[str] | None:
    """The files that the manifests name, from the last one on that replaces what was before; None without a manifest."""
    names: list[str] | None = None
    for manifest in sorted(n for n in found if n.startswith(_MANIFEST)):
        with store.open_input_stream(found[manifest].path) as file:
            kind, *files = file.read().decode().split("\n")
        names = files if kind == "replace" or names is None else names + files
    return None if names is None else [n for n in names if n]


class _Inflated:
    """Reads, and jumps ahead, over the contents of a file of gzip members. Of a file that is cut short all that can be unpacked is read before the error."""

    def __init__(self, raw):
        self.raw, self.member, self.left, self.at = raw, None, b"", 0

    def _some(self, most: int) -> bytes:
        """Up to ``most`` further bytes; none at the end of the file."""
        while True:
            self.left = self.left or self.raw.read(1 << 16)
            if self.member is None:
                # Zeros may follow a member.
                self.left = self.left.lstrip(b"\0")
                if self.left:
                    self.member = zlib.decompressobj(wbits=16 + zlib.MAX_WBITS)
                else:
                    self.left = self.raw.read(1 << 16)
                    if not self.left:
                        return b""
                continue
            got = self.member.decompress(self.left, most)
            if self.member.eof:
                self.left, self.member = self.member.unused_data, None
            elif not got and not self.left:
                raise EOFError("the file ends within a compressed member")
            else:
                self.left = self.member.unconsumed_tail
            if got:
                return got

    def read(self, n: int) -> bytes:
        parts, have = [], 0
        while have < n:
            try:
                part = self._some(n - have)
            except (EOFError, zlib.error):
                if not have:
                    raise
                break
            if not part:
                break
            parts.append(part)
            have += len(part)
        self.at += have
        return b"".join(parts)

    def tell(self) -> int:
        return self.at

    def seek(self, to: int) -> None:
        while self.at < to and self.read(min(1 << 20, to - self.at)):
            pass


class _Buffered:
    """Line reads over a file of a store, which has none."""

    def __init__(self, raw, size: int = 1 << 18):
        self.raw, self.size, self.buffer, self.at = raw, size, b"", 0

    def _more(self) -> bool:
        got = self.raw.read(self.size)
        self.buffer, self.at = self.buffer[self.at :] + got, 0
        return bool(got)

    def readline(self) -> bytes:
        while (end := self.buffer.find(b"\n", self.at)) < 0:
            if not self._more():
                end = len(self.buffer) - 1
                break
        line = self.buffer[self.at : end + 1]
        self.at = end + 1
        return line

    def read(self, n: int) -> bytes:
        have = self.buffer[self.at : self.at + n]
        self.at += len(have)
        return have if len(have) == n else have + self.raw.read(n - len(have))

    def tell(self) -> int:
        return self.raw.tell() - len(self.buffer) + self.at

    def seek(self, to: int) -> None:
        ahead = to - self.tell()
        if 0 <= ahead <= len(self.buffer) - self.at:
            self.at += ahead
        else:
            self.raw.seek(to)
            self.buffer, self.at = b"", 0


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.roll_bytes = int(options.get("roll_bytes", 128 << 20))
        self.compression = options.get("compression", "none")
        if self.compression not in ("none", "gzip"):
            raise ValueError("compression must be none or gzip")
        self.job = uuid.uuid4().hex

    def write(self, iterator) -> Written:
        store, folder = store_of(self.path)
        store.create_dir(folder, recursive=True)
        packed = (lambda record: gzip.compress(record, 6, mtime=0)) if self.compression == "gzip" else lambda record: record
        names, count, file, size = [], 0, None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if file is None:
                        names.append(f"part-{self.job[:8]}-{uuid.uuid4().hex}.warc" + ".gz" * (self.compression == "gzip"))
                        file = store.open_output_stream(f"{folder}/{names[-1]}", compression=None)
                        size = file.write(packed(info_bytes(names[-1])))
                    record = packed(record_bytes(*(row[c] for c in ("record_type", "record_id", "refers_to", "target_uri", "payload_digest", "payload_length", "payload"))))
                    file.write(record)
                    size, count = size + len(record), count + 1
                    if size >= self.roll_bytes:
                        file.close()
                        file = None
        except BaseException:
            if file is not None:
                file.close()
            _remove(store, folder, names)
            raise
        if file is not None:
            file.close()
        return Written(tuple(names), count)

    def commit(self, messages) -> None:
        store, folder = store_of(self.path)
        store.create_dir(folder, recursive=True)
        before = listing(store, folder)
        number = 1 + max([int(n.split("-")[1]) for n in before if n.startswith(_MANIFEST)], default=-1)
        own = [n for m in messages if m for n in m.files]
        draft, name = f"{folder}/.draft-{self.job}", f"{folder}/{_MANIFEST}{number:010d}-{self.job}"
        with store.open_output_stream(draft) as file:
            file.write("\n".join(["replace" if self.overwrite else "add", *own]).encode())
        # From here on the new files are what is read.
        store.move(draft, name)
        if self.overwrite:
            manifests = [n for n in before if n.startswith(_MANIFEST)]
            _remove(store, folder, manifests + [n for n in before if n.endswith((".warc", ".warc.gz")) and n not in own])

    def abort(self, messages) -> None:
        """Nothing is committed; the files of tasks that did end are deleted."""
        store, folder = store_of(self.path)
        _remove(store, folder, [n for m in messages if m for n in m.files])


def _remove(store, folder: str, names: list[str]) -> None:
    for name in names:
        try:
            store.delete_file(f"{folder}/{name}")
        except OSError:
            # What no manifest names is never read, so a file that can't be deleted now does no harm.
            continue


def register(spark: SparkSession) -> None:
    runtime.ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_archive(records: DataFrame, path: str, mode: str = "append", compression: str = "none") -> None:
    """Write rows of ``SCHEMA``'s columns as WARC records."""
    register(records.sparkSession)
    records.write.format(FORMAT).mode(mode).option("compression", compression).save(path)


def read_archive(spark: SparkSession, path: str, payload: str = "decode", foreign: bool = False, errors: str = "fail") -> DataFrame:
    """The records of an archive but for those that only describe a file."""
    register(spark)
    read = spark.read.format(FORMAT).option("payload", payload).option("foreign", str(foreign).lower()).option("errors", errors).load(path)
    return read.where(F.col("record_type") != "warcinfo")


#: Repeated payloads whose hashes are broadcast, at most: some 50 MB.
BROADCAST_PAYLOADS = 500_000


def records_of(pages: DataFrame, least_bytes: int = 0, broadcast_payloads: int = BROADCAST_PAYLOADS) -> DataFrame:
    """One record for each page: a response, or a revisit of the page with the largest id and the same payload.

    Payloads are compared by length and SHA-256. Only the hashes are shuffled: those that occur more than once go back to the pages, by a
    broadcast if they are few enough, else by a join that moves the pages.
    """
    hf.whole_ids(pages, "page_id")
    own = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    same = F.struct(F.octet_length("payload").alias("n"), F.unhex(F.sha2("payload", 256)).alias("h"))
    own = own.withColumns({"payload_length": F.octet_length("payload").cast("bigint"), "sha1": F.sha1("payload"), "same": same})
    repeated = own.where(F.col("payload_length") >= least_bytes).groupBy("same").agg(F.max("page_id").alias("last_id"), F.count("*").alias("copies")).where("copies > 1")
    repeated = runtime.materialize(repeated.select("same", "last_id", F.lit(True).alias("met")), "repeated")
    if repeated.count() <= broadcast_payloads:
        repeated = F.broadcast(repeated)
    # Without an equal payload a page is a response; with one, all but the rows of the largest id are revisits.
    joined = own.join(repeated, "same", "left").withColumn("again", F.col("met").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last_id")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    # Hex digits in fives are twenty bits, four letters of base 32.
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    digit = lambda five, k: F.substring(letters, (F.shiftrightunsigned(five, 15 - 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
    five = lambda i: F.conv(F.substring("sha1", 5 * i + 1, 5), 16, 10).cast("bigint")
    digest = F.concat(*(digit(five(i), k) for i in range(8) for k in range(4)))
    return joined.select(
        F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"),
        name(F.col("page_id")).alias("record_id"),
        F.when(F.col("again"), name(F.col("last_id"))).alias("refers_to"),
        F.col("url").alias("target_uri"),
        digest.alias("payload_digest"),
        "payload_length",
        F.when(~F.col("again"), F.col("payload")).alias("payload"),
    )


def page_number(urn: str) -> Column:
    """The page_id in a record's name; null if there is none."""
    return F.regexp_extract(urn, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last_id FROM p)
SELECT page_id, cast(strlen(h) AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + cast((cast('0x' || substr(x, cast(5 * (k // 4) + 1 AS BIGINT), 5) AS BIGINT) >> cast(15 - 5 * (k % 4) AS BIGINT)) & 31 AS BIGINT)]), '') AS payload_digest,
 CASE WHEN page_id IS DISTINCT FROM last_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN page_id IS DISTINCT FROM last_id THEN last_id END AS refers_to FROM m
"""
