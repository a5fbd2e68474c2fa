"""The corpus pipeline against stages written out in plain Python, on planted cases."""

import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from kinfold import runtime
from kinfold.llm import mixing, simhash_wide
from kinfold.operators.components import union_find


def planted(rng):
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    clean = [prose(300) for _ in range(40)]
    passage, item = prose(60), prose(25)
    docs = [(i, t) for i, t in enumerate(clean)]
    docs += [(100 + i, clean[i]) for i in range(5)]
    docs += [(200 + i, prose(150) + " " + passage + " " + prose(150)) for i in range(4)]
    docs += [(300 + i, prose(100) + " " + item + " " + prose(100)) for i in range(3)]
    docs += [(400, "too short"), (401, "spam spam " * 200), (402, None)]
    return docs, passage, item


def test_planted_cases(spark, tmp_path):
    docs, passage, item = planted(random.Random(7))
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # The first document with the benchmark's passage goes; the others lost it to the first as a repeated passage.
    assert set(out) == set(range(40)) | {200, 201, 202, 203, 301, 302}
    assert item not in out[301]["text"] and item not in out[302]["text"]
    assert [passage in out[i]["text"] for i in (200, 201, 202, 203)] == [True, False, False, False]
    assert all(out[i]["text"] == docs[i][1] for i in range(40))
    sizes = {i: len(r["text"].split()) for i, r in out.items()}
    assert {i: r["size"] for i, r in out.items()} == sizes and out[201]["size"] == 300
    for source in ("src0", "src1", "src2"):
        own = [r for r in out.values() if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "substring dedup", "benchmark decontamination", "mixing sources to target weights"]


def test_one_of_each_group_stays(spark):
    rng = random.Random(11)
    prose = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    shingles = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    groups = []
    for _ in range(25):
        base = prose(300)
        copies = [base]
        for _ in range(4):
            copy = list(base)
            for k in rng.sample(range(300), 3):
                copy[k] = "changed"
            assert len(shingles(base) & shingles(copy)) / len(shingles(base) | shingles(copy)) >= 0.8
            copies.append(copy)
        groups.append(copies)
    texts = [(100 * g + k, " ".join(t)) for g, copies in enumerate(groups) for k, t in enumerate(copies)]
    texts += [(10_000 + i, " ".join(prose(200))) for i in range(100)] + [(20_000, None), (20_001, "  "), (20_002, "")]
    texts.append((10_000, texts[-103][1]))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for bucket_rows in (simhash_wide.BUCKET_ROWS, 8):
        kept = simhash_wide.keep_one(docs, bucket_rows=bucket_rows)
        assert kept.columns == docs.columns
        ids = sorted(r["doc_id"] for r in kept.collect())
        assert [i for i in ids if i >= 10_000] == [10_000 + i for i in range(100)] + [20_000]
        assert {100 * g for g in range(25)} <= set(ids) and sum(i < 10_000 for i in ids) <= 27
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def prints_of(rng, n):
    """Fingerprints and least shingles of ``n`` unrelated texts."""
    return [rng.integers(0, 2**64, (n, k), dtype=np.uint64) for k in (simhash_wide.PRINT_WORDS, simhash_wide.ORDERS)]


def test_plans_are_alike_at_any_size():
    rng = np.random.default_rng(2)
    prints, least = prints_of(rng, 1000)
    # A third of the texts share a least shingle and half of their bits: a template.
    least[::3] = least[0]
    prints[::3, :4] = prints[0, :4]
    for texts in (0, 1, 10**4, 10**6, 10**9, 10**11):
        p = simhash_wide.plan(prints, least, texts, 0.8)
        assert p.most == simhash_wide.plan(prints, least, 100, 0.8).most
        # 48 bytes a row: key, node and filter.
        assert p.rows * 48 <= 4096, texts
        apart = round(simhash_wide.BITS * simhash_wide.differing_share(0.8))
        missed = np.prod([1 - simhash_wide.meeting(0.8, len(bits), apart, t) for bits, t, _ in p.groups])
        assert missed <= 1 - simhash_wide.RECALL
    # The partitions of the template's bits bring unrelated texts together and cost more, so they are left out.
    used = {b for bits, _, _ in simhash_wide.plan(prints, least, 10**9, 0.8).groups for b in bits}
    assert sum(b < 256 for b in used) < sum(b >= 256 for b in used)


def test_all_members_of_a_crowded_bucket_are_compared(spark):
    rng = np.random.default_rng(5)
    prints, least = prints_of(rng, 2000)
    p = simhash_wide.plan(prints, least, 70_000, 0.8)
    # All share the least shingle and the bits of the first partition: one crowded bucket of unrelated texts. Among the last 20 are pairs that differ a little,
    # each in all other partitions, so they meet in this bucket only.
    bits = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little")
    for group, _, _ in p.groups[1:]:
        assert not set(group) & set(p.groups[0][0])
    bits[:, list(p.groups[0][0])] = 0
    least[:, p.groups[0][2]] = 7
    bits[1981::2] = bits[1980::2]
    for group, _, _ in p.groups[1:]:
        bits[1981::2, group[0]] ^= 1
    both = np.concatenate([np.packbits(bits, axis=1, bitorder="little").view(np.uint64), least], axis=1)
    rows = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(both)], "node bigint, print binary")
    found = {(min(r), max(r)) for r in simhash_wide.links(rows, p, bucket_rows=256).collect()}
    assert found == {(i, i + 1) for i in range(1980, 2000, 2)}


def test_a_repeated_line_does_not_link(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join(f"v{rng.randrange(5000)}" for _ in range(n))
    line = prose(10)
    texts = [" ".join([prose(200)] + [line] * 16) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert simhash_wide.keep_one(docs).count() == 20


def cosine(a, b):
    return len(a & b) / max(len(a) * len(b), 1) ** 0.5


def test_links_have_the_stated_similarity(spark):
    rng, pairs = random.Random(13), []
    # Tail changed: 200 shingles of which 40 (cosine 0.8) or 41 (0.795) are others.
    for n in [40] * 10 + [41] * 10:
        base = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        pairs += [" ".join(base), " ".join(base[: 204 - n] + [f"x{rng.randrange(10**6)}" for _ in range(n)])]
    docs = spark.createDataFrame(list(enumerate(pairs)), "doc_id bigint, text string")
    kept = {r["doc_id"] for r in simhash_wide.keep_one(docs).collect()}
    assert set(range(20, 40)) <= kept
    sets = [simhash_wide.shingle_set(t.encode(), 5) for t in pairs]
    sizes = np.array([len(x) for x in sets])
    spans = simhash_wide.similar_forest(np.arange(40), np.concatenate(sets), sizes, 0.8)
    assert sorted(zip(*spans, strict=True)) == [(i, i + 1) for i in range(0, 20, 2)]
    assert simhash_wide.similar_forest(np.arange(2), sets[0], np.array([len(sets[0]), 0]), 0.8) == ([], [])


def test_against_all_pairs(spark):
    """On the table of sf0.01: no pair at the similarity keeps both texts apart, and no text goes without a partner that is alike."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    sets = {i: set(simhash_wide.shingle_set(t.encode(), 5).tolist()) for i, t in texts.items()}
    holders: dict[int, list[int]] = {}
    for i, own in sets.items():
        for x in own:
            holders.setdefault(x, []).append(i)
    meets = {(a, b) for group in holders.values() for a in group for b in group if a < b}
    links = [(a, b) for a, b in meets if cosine(sets[a], sets[b]) >= 0.8] + [(a, b) for a in sets for b in sets if a < b and not sets[a] and not sets[b]]
    roots = union_find(links)
    wanted = {i for i in sets if roots.get(i, i) == i}
    kept = {r["doc_id"] for r in simhash_wide.keep_one(docs).collect()}
    assert wanted <= kept and len(kept - wanted) <= 0.01 * len(roots)


def test_large_candidate_components_are_compared_in_blocks(spark):
    rng = random.Random(17)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = []
    for _ in range(40):
        own = base[:110] + [f"x{rng.randrange(10**6)}" for _ in range(40)]
        texts += [" ".join(own), " ".join(own[:-1] + ["other"])]  # the pairs share three quarters of their words with all others
    held = spark.createDataFrame([(t, i, *_set(t)) for i, t in enumerate(texts)], "text string, place bigint, node bigint, size bigint")
    groups = held.select("node", "size", F.struct(F.col("place").alias("row")).alias("first"))
    nodes = [_set(t)[0] for t in texts]
    candidates = spark.createDataFrame([(n, nodes[0]) for n in nodes[1:]], "node bigint, root bigint")
    for most in (1 << 19, 1000):
        got = {frozenset((r["a"], r["b"])) for r in simhash_wide.verified_links(held, "place", groups, candidates, 0.8, 5, most).collect()}
        assert got == {frozenset(nodes[i : i + 2]) for i in range(0, 80, 2)}


def test_recall_at_the_stated_similarity():
    rng = np.random.default_rng(19)
    p = simhash_wide.plan(*prints_of(rng, 1000), 10**6, 0.8)
    for size, other, shared in ((5, 5, 4), (45, 45, 36), (180, 180, 144), (100, 64, 64)):
        found = 0
        for _ in range(400):
            every = rng.integers(0, 2**64, size + other - shared, dtype=np.uint64)
            a, b = (np.sort(x) for x in (every[:size], every[size - shared :]))
            both = np.stack([np.concatenate([simhash_wide.fingerprint(x), simhash_wide.least_shingles(x)]) for x in (a, b)])
            keys = simhash_wide.partition_keys(both, p)
            found += bool(set(keys[0].tolist()) & set(keys[1].tolist())) and np.bitwise_count(both[0] ^ both[1])[: simhash_wide.FILTER_WORDS].sum() <= p.most
        assert found >= 0.975 * 400, (size, other, shared, found)


def test_the_last_stage_follows_the_schedule(spark):
    rng = random.Random(23)
    docs = spark.createDataFrame([(i, "w " * rng.randrange(200), f"s{i % 3}") for i in range(300)], "doc_id bigint, text string, source string")
    out = corpus_pipeline.mixed(spark, docs, "").collect()
    sized = runtime.materialize(mixing.sizes(docs), "sized")
    first = {}
    for r in mixing.mix(sized, mixing.targets(sized)).where("words > 0").collect():
        first[r["doc_id"]] = min(r["position"], first.get(r["doc_id"], r["position"]))
    assert first and {r["doc_id"]: r["position"] for r in out if r["taken"]} == first
    assert all((r["position"] is None) == (r["taken"] == 0) for r in out)


def _set(text):
    hashes = simhash_wide.shingle_set(text.encode(), 5)
    return int(hashes.sum().view(np.int64)), len(hashes)


def test_odd_rows_pass_all_stages(spark, tmp_path):
    """Nulls, blanks, a very long text, repeated rows and ids, and columns whose names the stages use themselves."""
    rng = random.Random(41)
    prose = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    long = prose(150_000)
    texts = [(1, prose(100)), (None, prose(80)), (3, None), (4, " \n"), (5, long), (5, long), (6, prose(60)), (6, prose(60)), (7, "short")]
    clash = {"near_row": 1, "_near_row": 2, "node": 3, "size": 4, "first": 5, "place": 6, "key": 7, "block": 8, "payload": 9, "_mix_number": 10, "Position": 11}
    rows = [(i, t, None, None if k % 2 else "s", None, *clash.values()) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} int" for c in clash))
    spark.createDataFrame([(1, 1, 0), (1, 0, 0), (3, 0, 1), (None, 1, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "a b"), (2, "")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
    out = {(r["doc_id"], r["text"]): r for r in corpus_pipeline.mixed(spark, kept, str(tmp_path)).collect()}
    # The rules reject what has no 50 words; of the long text one copy stays; rows of one id don't take from each other.
    assert set(out) == {(i, t) for i, t in texts if t and len(t.split()) >= 50}
    assert sum(r["size"] for r in out.values()) == sum(len(t.split()) for _, t in out) and all(r["node"] == 3 for r in out.values())
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
