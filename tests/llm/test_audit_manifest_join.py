"""Operators 11 to 13 against literal versions: small tiles, several storeys, crowded keys, and odd rows."""

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import divergence, jaccard_join, merkle
from kinfold.operators.components import union_find
from kinfold.runtime import scratch_path
from test_edge_cases import ROWS, SCHEMA

SMALL = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


# Operator 11.


def literal_audit(rows, least=3):
    import re

    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for r in rows:
        lang, source = r["lang"] or "", r["source"] or ""
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or ""))
        groups.add((lang, source))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = {s: counts[lang, s] for of, s in groups if of == lang}
        whole = Counter()
        for c in own.values():
            whole.update(c)
        share = lambda c, v=len(kept), kept=kept: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + v) for t in kept}
        p, q = {s: share(c) for s, c in own.items()}, share(whole)
        for s in own:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in own if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 200)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def test_audit_in_small_tiles(spark):
    pick = random.Random(5)
    vocabulary = [f"w{i:x}{'é' * (i % 3)}".translate({48 + k: 103 + k for k in range(10)}) for i in range(300)]
    rows = []
    for i in range(260):
        source = None if i % 11 == 0 else f"s{pick.randrange(3) if i % 3 else pick.randrange(17)}"
        words = [vocabulary[min(int(pick.expovariate(0.03)), 299)] for _ in range(pick.randrange(60))]
        rows.append((i, " ".join(w.upper() if pick.random() < 0.2 else w for w in words) if i % 29 else None, None if i % 13 == 0 else pick.choice(["en", "de"]), source, 0))
    docs = spark.createDataFrame(rows, SMALL)
    wanted = literal_audit(docs.collect())
    for sources in (2, 5, 256):
        found = [tuple(r) for r in divergence.audit(docs, tile_sources=sources).collect()]
        assert len(found) == len(wanted) and set(found) == wanted


def test_audit_of_odd_rows(odd):
    found = {tuple(r) for r in divergence.audit(odd).collect()}
    assert found == literal_audit(odd.collect())
    # Groups without terms, and languages that keep none, have pairs of value 0.
    assert ("", "c", "pair", "", 0, 1) in found and ("de", "b", "pair", "", 0, 1) in found
    assert divergence.audit(odd.limit(0)).count() == 0


def test_shares_beyond_64_bits():
    n, total = np.array([10**11, 10**15]), 3 * 10**15
    assert divergence.shares(n, total).tolist() == [1 + 10**9 * (x + 1) // total for x in n.tolist()]


# Operator 12.


def literal_manifest(rows, altered):
    digest = lambda r, text: sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)).encode()).hexdigest()
    null_first = lambda v: (v is not None, v if isinstance(v, int) else (v or "").encode())

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha256("".join(out[-1][i : i + 3]).encode()).hexdigest() for i in range(0, len(out[-1]), 3)])
        return out

    def path(tree, at):
        out = []
        for nodes in tree[:-1]:
            first = at // 3 * 3
            out.append((nodes[first:at], nodes[at + 1 : first + 3]))
            at //= 3
        return out

    sources = defaultdict(list)
    for r in rows:
        sources[r["source"]].append((null_first(r["doc_id"]), digest(r, r["text"]), r))
    order = sorted(sources, key=null_first)
    for found in sources.values():
        found.sort(key=lambda x: x[:2])
    trees = [levels([x[1] for x in sources[s]]) for s in order]
    top = levels([t[-1][0] for t in trees])
    out = []
    for number, s in enumerate(order):
        for at, (_, leaf, r) in enumerate(sources[s]):
            whole = path(trees[number], at) + path(top, number)
            folded = digest(r, altered(r))
            for before, after in whole:
                folded = sha256("".join([*before, folded, *after]).encode()).hexdigest()
            proof = sha256("".join(x for b, a in whole for x in [*b, *a]).encode()).hexdigest()
            out.append((r["doc_id"], leaf, trees[number][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=str)


def without_breaks(r):
    return r["text"].replace("\n", "") if r["text"] is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 else r["text"]


def tampered():
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))


def test_manifest_of_odd_rows(odd, spark):
    assert sorted((tuple(r) for r in merkle.proofs(odd, tampered()).collect()), key=str) == literal_manifest(odd.collect(), without_breaks)
    assert merkle.proofs(odd.limit(0), tampered()).count() == 0
    one = odd.where("doc_id = 6")
    assert [tuple(r) for r in merkle.proofs(one).collect()] == literal_manifest(one.collect(), lambda r: r["text"])
    with pytest.raises(TypeError, match="whole numbers"):
        merkle.proofs(odd.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_manifest_of_several_storeys(spark):
    rows = [(i // 2 if i < 40 else i, f"line {i}\nnext" if i % 3 else f"line {i}", "en", "large" if i < 1700 else f"s{i % 900}" if i < 2600 else None, i) for i in range(2610)]
    docs = spark.createDataFrame(rows, SMALL).repartition(5)
    path = scratch_path(spark, "manifest")
    found = sorted((tuple(r) for r in merkle.proofs(docs, tampered(), path).collect()), key=str)
    assert found == literal_manifest(docs.collect(), without_breaks)
    assert 0 < sum(r[-1] for r in found) < len(found)
    # Over 729 leaves a tree has a second storey; the store holds each of its levels.
    assert {r["level"] for r in merkle.stored(spark, f"{path}/sources").select("level").distinct().collect()} == set(range(1, 8))
    assert {r["level"] for r in merkle.stored(spark, f"{path}/root").select("level").distinct().collect()} == set(range(1, 8))


# Operator 13.


def literal_sets(rows):
    out = []
    for r in rows:
        words = (r["text"] or "").encode().lower().split()
        out.append(frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset())
    return out


def literal_join(rows):
    sets = literal_sets(rows)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = union_find(links)
    members = defaultdict(list)
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            members[root.get(i, i)].append(r["doc_id"])
    return sorted(((r["doc_id"], len(sets[i]), min(members[root.get(i, i)], default=None)) for i, r in enumerate(rows)), key=str)


def test_any_sizes_that_may_link_share_a_family():
    for a in range(1, 700):
        for b in range(a, a * 5 // 4 + 1):
            most = (a + b) // 9
            # Two sets differ in an odd number of shingles if one size is odd.
            most -= (most + a + b) % 2
            shared = set(jaccard_join.families(a, (80, 100))) & set(jaccard_join.families(b, (80, 100)))
            assert most <= 0 or any(m - spare > most for _, m, spare in shared), (a, b)


def family_of_texts(pick, size, copies, edits):
    base = [f"t{pick.randrange(10**6)}" for _ in range(size)]
    for _ in range(copies):
        words = list(base)
        for _ in range(pick.randrange(edits + 1)):
            words[pick.randrange(len(words))] = f"e{pick.randrange(10**6)}"
        yield " ".join(words)


def test_join_against_all_pairs(spark):
    pick = random.Random(11)
    texts = [None, "", " ", "one", "One", "one two", "a b c d", "A B c d", "a b c d e", "b c d e f"]
    for size, edits in ((6, 1), (9, 1), (14, 1), (22, 1), (40, 2), (75, 3), (150, 5), (400, 12), (900, 25)):
        for copies in (2, 3, 14):
            texts += family_of_texts(pick, size, copies, edits)
    common = " ".join(f"c{i}" for i in range(12))
    texts += [common + " " + " ".join(f"u{pick.randrange(10**6)}" for _ in range(30)) for _ in range(30)]
    pick.shuffle(texts)
    rows = [(i if i % 17 else None if i % 2 else 5, t, None, None, 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SMALL).repartition(6)
    wanted = literal_join(docs.collect())
    assert sum(1 for r in wanted if r[0] != r[2]) > 80
    for crowd, group in ((jaccard_join.CROWD_ROWS, jaccard_join.GROUP_SHINGLES), (6, 3000)):
        found = jaccard_join.join(docs, crowd_rows=crowd, group_shingles=group).collect()
        assert sorted((tuple(r) for r in found), key=str) == wanted


def test_join_of_odd_rows(odd, spark):
    found = sorted((tuple(r) for r in jaccard_join.join(odd).collect()), key=str)
    assert found == literal_join(odd.collect())
    assert jaccard_join.join(odd.limit(0)).count() == 0
    with pytest.raises(TypeError, match="whole numbers"):
        jaccard_join.join(odd.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_sketches_bound_the_difference_and_fold():
    rng = np.random.default_rng(3)
    for n in (3, 40, 200, 700):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n * 9 // 10], rng.integers(0, 2**63, n // 4).astype(np.uint64)]))
        p, q = jaccard_join.folded([jaccard_join.sketch(a), jaccard_join.sketch(b)])
        assert int(np.bitwise_count(p ^ q).sum()) <= len(np.setxor1d(a, b))


def test_crowded_keys_leave_a_reducer_early(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HELD_ROWS", 50)
    rows = np.zeros(400, dtype=jaccard_join._KEYED)
    rows["key"], rows["node"] = np.arange(400) % 7 == 0, np.arange(400) % 150
    rows["key"][:40] = np.arange(100, 140) // 2
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([3] * 8), pa.array([x.tobytes() for x in np.split(rows, 8)], pa.binary())], names=["part", "rows"])
    out = pa.Table.from_batches(list(jaccard_join._shared([batch]))).to_pylist()
    crowd = {(r["key"], r["a"]) for r in out if r["key"] is not None}
    assert crowd == {(int(k), int(n)) for k, n in zip(rows["key"].tolist(), rows["node"].tolist(), strict=True) if k < 2}
    assert len([r for r in out if r["key"] is None]) == 20
