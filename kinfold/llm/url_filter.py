"""Operator 1, URL filters: rules by host and path, then a listed-URL test by Bloom filter and exact join.

The listed canonical URLs are hashed into a blocked Bloom filter: each key sets eight bits of one 256-bit
block, so a probe touches one block; one hash chooses the block, another the bits. The blocks are built by an aggregate with partial results; the filter
has a stated largest size, beyond which it lets more through but stays exact in the end. Keys that may be
listed, few of all, go to a hash join with the list itself, which removes the false positives. The clean
rows are not shuffled.

Canonical keys of a URL: its host and each parent domain of two labels at least, with a slash (a listed
site covers its subdomains), and its host and path without a trailing slash (a listed page). For keys a host goes without
user name, port and trailing dots, a page's host without a leading ``www.``, and percent codes are resolved; ``canonical`` makes a list of such
keys from URLs. The list is a table; ``production_list`` is the one of the registered query.

Defined results: a null URL or one without ``://`` has empty host and path, no rule and no keys, and is allowed.
Of a host's parents only those with no more labels than some listed site are looked up. Repeated rows keep their number; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold import runtime
from kinfold.llm import hashed_features as hf

#: Fixed values of the contract: verdict, host and path prefix.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The production list: sites known for advertising, gambling and spam, under three endings each, a register of numbered sites,
#: and every fifth page of two mixed sites.
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_ENDINGS = ("example.com", "example.net", "example.org")
NUMBERED_SITES, LISTED_PAGES = 20_000, 1000
PAGE_SITES, PAGE_FOLDERS = ("blog.tionsh.example.com", "tionble.example.org"), ("de", "en", "es", "fr")

BITS_PER_KEY = 16
MOST_FILTER_BYTES = 64 << 20
_BLOCK_BYTES, _WORDS = 32, 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host`` and path, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, domain, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        rule, verdict = F.when(fits, F.lit(domain + prefix)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def extent(listed: DataFrame) -> tuple[int, int]:
    """How many keys (key string) there are, and the largest number of labels of a listed site: no longer parent can be listed."""
    labels = F.when(F.col("key").endswith("/"), F.size(F.split("key", r"\.")))
    told = listed.agg(F.count("*").alias("n"), F.coalesce(F.max(labels), F.lit(0)).alias("labels")).first()
    return int(told["n"]), int(told["labels"])


def _decoded(text: Column) -> Column:
    """Percent codes resolved; a text that can't be stays."""
    plain = F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    return F.when(F.contains(text, F.lit("%")), F.coalesce(plain, text)).otherwise(text)


def site_of(host: Column) -> Column:
    """A host as lists know it: without user name, port and trailing dots, percent codes resolved."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    return F.regexp_replace(F.translate(_decoded(bare), _UPPER, _LOWER), r"\.+$", "")


def page_of(site: Column, path: Column) -> Column:
    return F.concat(F.regexp_replace(site, r"^www\.", ""), F.rtrim(_decoded(path), F.lit("/")))


def canonical(listed: DataFrame) -> DataFrame:
    """The keys (key string) of listed URLs (url string): a URL without a path lists its site, any other its page."""
    site, path = site_of(host_of(F.col("url"))), path_of(F.col("url"))
    key = F.when(F.rtrim(path, F.lit("/")) == "", F.concat(site, F.lit("/"))).otherwise(page_of(site, path))
    return listed.where(site != "").select(key.alias("key")).distinct()


def keys_of(host: Column, path: Column, most: int) -> Column:
    """The canonical keys under which a URL may be listed; sites of ``most`` labels at most."""
    host = site_of(host)
    labels = F.split(host, r"\.")
    first = F.greatest(F.size(labels) - F.lit(most - 1), F.lit(1))
    # A host of one label is its own site.
    last = F.greatest(F.size(labels) - 1, F.lit(1))
    parents = F.transform(F.sequence(F.least(first, last), last), lambda i: F.concat(F.array_join(F.slice(labels, i, F.size(labels)), "."), F.lit("/")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(parents, F.array(page_of(host, path)))))


def filter_blocks(keys: int, bits_per_key: int = BITS_PER_KEY, most_bytes: int = MOST_FILTER_BYTES) -> int:
    """The number of blocks, a power of two: enough for the keys, or as many as the largest size holds."""
    wanted = max(1, math.ceil(keys * bits_per_key / 8 / _BLOCK_BYTES))
    return min(1 << (wanted - 1).bit_length(), 1 << (max(1, most_bytes // _BLOCK_BYTES).bit_length() - 1))


def bits_hash(key: Column) -> Column:
    """The hash that chooses a key's bits; it has nothing to do with the one that chooses its block."""
    return F.xxhash64(key, F.lit("bits"))


def build_filter(listed: DataFrame, blocks: int) -> np.ndarray:
    """The filter of ``listed`` (key string) as ``blocks`` rows of four 64-bit words."""
    shift = 64 - (blocks.bit_length() - 1)
    hashed = listed.select(F.xxhash64("key").alias("h"), bits_hash(F.col("key")).alias("b"))
    block = F.lit(0).cast("bigint") if blocks == 1 else F.shiftrightunsigned("h", shift)
    bit = lambda k: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(b, {6 * k}) & 63L AS int))")
    words = [F.bit_or(bit(2 * w).bitwiseOR(bit(2 * w + 1))).alias(f"w{w}") for w in range(_WORDS)]
    out = np.zeros((blocks, _WORDS), dtype=np.int64)
    for row in hashed.groupBy(block.alias("block")).agg(*words).toLocalIterator():
        out[row["block"]] = [row[f"w{w}"] for w in range(_WORDS)]
    return out.view(np.uint64)


def probe(blocks: np.ndarray, hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """False for keys that are certainly not in the filter, from their two hashes."""
    shift = 64 - (len(blocks).bit_length() - 1)
    h, b = (x.astype(np.int64).view(np.uint64) for x in (hashes, bits))
    own = blocks[(h >> np.uint64(shift)).astype(np.int64)] if len(blocks) > 1 else np.broadcast_to(blocks[0], (len(h), _WORDS))
    hit = np.ones(len(h), dtype=bool)
    for k in range(2 * _WORDS):
        hit &= (own[:, k // 2] >> ((b >> np.uint64(6 * k)) & np.uint64(63))) & np.uint64(1) == 1
    return hit


def _possible(held):
    """Keeps the keys that may be listed."""

    def run(batches):
        for batch in batches:
            keys = batch.column("keys")
            sizes = np.diff(np.asarray(keys.offsets))
            hit = probe(held.value, *(np.asarray(batch.column(c).flatten()) for c in ("hashes", "bits")))
            flat = keys.flatten().filter(pa.array(hit))
            kept = np.add.reduceat(np.append(hit, False).astype(np.int64), np.asarray(keys.offsets)[:-1] - keys.offsets[0].as_py()) if len(sizes) else sizes
            kept = np.where(sizes > 0, kept, 0)
            offsets = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
            maybe = pa.ListArray.from_arrays(pa.array(offsets), flat)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("page_id", "host", "path")] + [maybe], names=["page_id", "host", "path", "maybe"])

    return run


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, most_filter_bytes: int = MOST_FILTER_BYTES) -> DataFrame:
    """page_id, host, path, rule, listed and verdict for each row of ``pages``; ``listed`` has canonical keys (key string)."""
    spark = hf.whole_ids(pages, "page_id").sparkSession
    runtime.ship_package(spark)
    own = runtime.materialize(listed.where(F.col("key").isNotNull()).select("key").distinct(), "listed", narrow=8)
    count, labels = extent(own)
    held = spark.sparkContext.broadcast(build_filter(own, filter_blocks(count, most_bytes=most_filter_bytes)))
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keyed = parsed.withColumn("keys", keys_of(F.col("host"), F.col("path"), labels)).withColumns({"hashes": F.transform("keys", lambda k: F.xxhash64(k)), "bits": F.transform("keys", bits_hash)})
    key = pages.schema["page_id"].dataType.simpleString()
    seen = runtime.materialize(keyed.mapInArrow(_possible(held), f"page_id {key}, host string, path string, maybe array<string>"), "urls")
    clean, possible = seen.where(F.size("maybe") == 0), seen.where(F.size("maybe") > 0)
    tested = possible.select("host", "path", F.explode("maybe").alias("key")).distinct().join(own, "key").select("host", "path").distinct().withColumn("listed", F.lit(True))
    # Only rows that the filter lets through are shuffled.
    judged = clean.select("page_id", "host", "path", F.lit(False).alias("listed")).union(
        possible.join(tested, ["host", "path"], "left").select("page_id", "host", "path", F.coalesce("listed", F.lit(False)).alias("listed"))
    )
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_list = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_list).alias("verdict"), "listed")


def production_list(spark) -> DataFrame:
    """The canonical keys of the listed sites and pages."""
    named = spark.createDataFrame([(f"{name}.{end}/",) for name in LISTED_NAMES for end in LISTED_ENDINGS], "key string")
    numbered = spark.range(NUMBERED_SITES).select(F.concat(F.lit("site"), F.col("id").cast("string"), F.lit(".listed.example/")).alias("key"))
    folders = F.array(*(F.lit(f"{site}/{folder}/") for site in PAGE_SITES for folder in PAGE_FOLDERS))
    pages = spark.range(0, LISTED_PAGES, 5).withColumn("folder", F.explode(folders))
    return named.union(numbered).union(pages.select(F.concat("folder", F.col("id").cast("string"))))


SQL = r"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
k AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.+$', '') AS site FROM p),
l AS (SELECT f || cast(n AS VARCHAR) AS page FROM (SELECT unnest(['blog.tionsh.example.com/', 'tionble.example.org/']) || unnest_folder AS f FROM (SELECT unnest(['de/', 'en/', 'es/', 'fr/']) AS unnest_folder)), range(0, 1000, 5) t(n)),
r AS (SELECT page_id, host, path, CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
 WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
 WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
 WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule,
 regexp_matches(site, '(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.example\.(com|net|org)$')
 OR coalesce(try_cast(regexp_extract(site, '(^|\.)site(0|[1-9][0-9]*)\.listed\.example$', 2) AS BIGINT) < 20000, FALSE)
 OR regexp_replace(site, '^www\.', '') || rtrim(path, '/') IN (SELECT page FROM l) AS listed FROM k)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM r
"""
