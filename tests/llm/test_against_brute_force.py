"""Operators that SQL can't express, against literal versions, and models on rows kept out of their training."""

import hashlib
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kinfold.llm import attention, language_id, language_model, quality_classifier, quality_rules, registry, simhash, substring_dedup
from kinfold.llm import textblocks as tb
from kinfold.operators.components import union_find

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def found(spark):
    held = {}

    def get(name, sf=SF):
        if (name, sf) not in held:
            held[name, sf] = registry.queries()[name](spark, sf).collect()
        return held[name, sf]

    return get


def test_sql_oracles(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, SF)
        cursor = con.execute(sql)
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(df.columns), name
        assert sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(str, cursor.fetchall())), name


def literal_print(text, shingle=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_query(texts, found):
    prints = {i: literal_print(t) for i, t in texts.items()}
    ids = sorted(prints)
    links = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    roots = union_find(links)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in found("op3_simhash")} == {(i, f"{prints[i]:016x}", roots.get(i, i)) for i in ids}


@pytest.mark.parametrize("distance", [2, 4, 5])
def test_search_finds_all_links(spark, distance):
    rng = random.Random(distance)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    prints = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for s in seeds for _ in range(25)}
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    df = spark.createDataFrame([(p, s) for p, s in zip(range(len(prints)), signed.values())], "doc_id bigint, fp bigint")
    ordered = list(signed.values())
    near = [(a, b) for a in range(len(ordered)) for b in range(a + 1, len(ordered)) if ((ordered[a] ^ ordered[b]) & (2**64 - 1)).bit_count() <= distance]
    want = union_find(near)
    for bucket_rows in (simhash.BUCKET_ROWS, 10):
        got = {r["fp"]: r["component_id"] for r in simhash.components(df, distance, bucket_rows).collect()}
        assert got == {fp: want.get(i, i) for i, fp in enumerate(ordered)}


def test_plans_cover_the_distance():
    rng = np.random.default_rng(0)
    prints = rng.integers(0, 2**63, 500, dtype=np.int64).view(np.uint64)
    for total in (100, 10**6, 10**10):
        for distance in (3, 4, 8):
            groups = simhash.plan(prints, total, distance)
            assert sorted(b for bits, _ in groups for b in bits) == list(range(64)) and sum(t + 1 for _, t in groups) == distance + 1


def test_difference_cover():
    cover = set(substring_dedup.COVER)
    assert {(a - b) % substring_dedup.PERIOD for a in cover for b in cover} == set(range(substring_dedup.PERIOD))


def test_word_hashes_stand_for_words():
    rng = random.Random(1)
    text = " ".join(rng.choice(["ab", "ba", "abab", "é", "è", "a", "b" * 40]) + "," * rng.randint(0, 1) for _ in range(3000)).encode()
    data = np.frombuffer(text, dtype=np.uint8)
    starts, ends, _ = tb.word_bounds(data, np.array([0, len(data)]))
    words = text.split()
    assert [text[a:b] for a, b in zip(starts, ends)] == words
    hashes = tb.span_hashes(data, starts, ends).tolist()
    assert len(set(zip(hashes, words))) == len(set(hashes)) == len(set(words))


def test_base_counts(texts, found):
    for r in found("op9_quality_rules"):
        text = texts[r["doc_id"]] or ""
        words = text.encode().split()
        triples = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {i + k for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [line for line in text.split("\n") if line.encode().split()]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_word_counts_of_the_language_model(texts, found):
    tokens = {i: (t or "").encode().lower().split() + [b"\n"] for i, t in texts.items()}
    counts = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r in found("op4_language_model"):
        own = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))


def test_gradients():
    rng = np.random.default_rng(3)
    net = attention.new_network()
    for name in ("embed", "query", "key", "value", "far", "hidden", "hidden_bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    rows = rng.integers(0, 50, (3, attention.KEYS))
    there = np.arange(attention.KEYS)[None, :] >= np.array([0, 16, 20])[:, None]
    aimed = there[:, attention.CONTEXT :]
    kinds = rng.integers(0, attention.CLASSES, (3, attention.STEP))

    def loss():
        logs = attention.class_log_probabilities(net, attention.attend(net, rows, there)[-1])
        return -(np.take_along_axis(logs, kinds[..., None], 2)[..., 0] * aimed).sum() / aimed.sum()

    for part, grad in zip(net.parts(), attention.gradients(net, rows, there, kinds, aimed)):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        old, step = part[at], 1e-5
        part[at] = old + step
        up = loss()
        part[at] = old - step
        down = loss()
        part[at] = old
        assert (up - down) / (2 * step) == pytest.approx(grad[at], rel=1e-3)


def spelling(pairs=None, net=None, voc=None):
    """A scorer over 300 subwords, of which every third begins a word."""
    net = net or attention.new_network()
    voc = voc or attention.vocabulary(np.append(np.arange(300, 0, -1.0), 20), np.arange(300) % 3 == 0)
    none = attention.Pairs(np.zeros((attention.ROWS, attention.CLASSES), dtype=np.float32), np.zeros(attention.ROWS, dtype=np.float32))
    return attention.Scorer(net, voc, pairs or none)


def test_each_subword_is_scored_once_and_probabilities_sum_to_one():
    scorer = spelling()
    end = scorer.voc.end
    first = [10 ** attention.log10_probabilities(scorer, np.array([x, end]) if x != end else np.array([x]), np.array([1 if x == end else 2]))[0][0] for x in range(301)]
    assert sum(first) == pytest.approx(1, abs=1e-4)
    begun = 10 ** attention.log10_probabilities(scorer, np.array([end]), np.array([1]))[1][0]
    assert begun == pytest.approx(sum(first[0:300:3]) + first[end], rel=1e-4)
    # Texts scored together score as they do alone.
    rng = np.random.default_rng(5)
    parts = [np.append(rng.integers(0, 300, n), end) for n in (0, 31, 32, 33, 200)]
    together = attention.log10_probabilities(scorer, np.concatenate(parts), np.array([len(p) for p in parts]), chunk=3)
    alone = [attention.log10_probabilities(scorer, p, np.array([len(p)])) for p in parts]
    for which in (0, 1):
        assert together[which] == pytest.approx(np.concatenate([a[which] for a in alone]), rel=1e-4)


def test_words_sum_to_one():
    # Subwords 0 and 3 begin words, 1 goes on; a word is 0 or 3 and any number of 1s. Their sum over all words, the end included, is one.
    counts = np.zeros(301)
    counts[[0, 3, 1, 300]] = 50, 20, 30, 10
    voc = attention.vocabulary(counts, np.arange(300) % 3 == 0)
    voc.log_share[np.flatnonzero(counts == 0)] = -np.inf
    held = np.where(counts > 0, 10.0**voc.log_share, 0)
    for k in np.unique(voc.kind):
        held[voc.kind == k] /= max(held[voc.kind == k].sum(), 1e-30)
    voc.log_share = np.log10(np.maximum(held, 1e-30)).astype(np.float32)
    voc.begins = np.bincount(voc.kind, weights=np.where(np.append(np.arange(300) % 3 == 0, True), held, 0), minlength=attention.CLASSES).astype(np.float32)
    scorer = spelling(voc=voc)
    # Classes without a subword get no probability in this corpus.
    scorer.out_bias = np.where(np.isin(np.arange(attention.CLASSES), voc.kind[counts > 0]), 0, -30).astype(np.float32)
    total = 0.0
    for head in (0, 3):
        for more in range(60):
            ids = np.array([head] + [1] * more + [voc.end])
            own, begins = attention.log10_probabilities(scorer, ids, np.array([len(ids)]))
            total += 10 ** attention.word_scores(own, begins, np.array([more + 1, 1]), np.array([False, True]))[0]
    own, begins = attention.log10_probabilities(scorer, np.array([voc.end]), np.array([1]))
    total += 10 ** attention.word_scores(own, begins, np.array([1]), np.array([True]))[0]
    assert total == pytest.approx(1, abs=2e-3)


def test_pair_counts_cover_all_learning_texts(spark):
    cycle = "red green blue black white brown".split()
    rng = random.Random(2)
    # A rare source among others: hardly a window of it is drawn for the network, the order of its words is known from the counts.
    learned = [(i, " ".join(rng.choice(("north", "east", "south", "west")) for _ in range(120))) for i in range(300)] + [(500, " ".join(cycle * 20))]
    docs = spark.createDataFrame([*learned, (1000, " ".join(cycle)), (1001, " ".join(cycle[::-1]))], "doc_id bigint, text string")
    scores = {r["doc_id"]: r["score"] for r in language_model.score(docs, docs["doc_id"] >= 1000, windows=20).collect()}
    assert scores[1000] > scores[1001] + 1, scores


def test_mixed_probabilities_sum_to_one():
    rng = np.random.default_rng(8)
    scorer = spelling()
    voc, net = scorer.voc, attention.new_network()
    texts = [np.append(rng.integers(0, 300, 50), voc.end) for _ in range(20)]
    ids, lengths = np.concatenate(texts), np.full(20, 51)
    counts = attention.pair_counts(voc, ids, lengths, np.arange(20) == 3)
    literal = Counter((0 if k == 0 else voc.row[t[k - 1]], voc.kind[t[k]]) for i, t in enumerate(texts) if i != 3 for k in range(51))
    assert {(r, k): counts[r, k] for r, k in zip(*np.nonzero(counts))} == literal
    rows, there, target, aimed = attention.window_inputs(voc, ids, *attention.windows(lengths))
    # Each text has two windows; those of the one that is not counted are left out.
    learns = np.arange(40) // 2 != 3
    level, parts = attention.pair_places(net, counts, *(x[learns] for x in (rows, there, voc.kind[target], aimed)))
    assert (level > 0).all() and (parts >= 0).all() and (parts <= 1).all()
    pairs = attention.pair_model(counts, np.full(attention.LEVELS, 0.4))
    assert pairs.share.sum(axis=1) == pytest.approx(1, abs=1e-4) and (pairs.weight[counts.sum(axis=1) > 0] > 0).any()
    mixed = spelling(pairs, net)
    assert sum(10 ** attention.log10_probabilities(mixed, np.array([5, x]), np.array([2]))[0][1] for x in range(301)) == pytest.approx(1, rel=1e-4)


def test_parts_of_a_words_probability(texts, spark):
    """Against counts by hand: shares of the corpus, of the text so far, of what followed the word before, and of the words of a class; and their mixture."""
    rows = [(1, "b a b a c"), (2, ""), (3, "a a a"), (4, "b a"), (10, "a b c a b"), (11, " ".join("defghijklmnopqrstuvwxyz" * 2))]
    held = {10}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    with open(language_model.TOKENIZER, "rb") as file:
        model = file.read()
    data, offsets = tb.column_bytes(docs.toArrow().column("text").combine_chunks())
    ids = np.array([r[0] for r in rows])
    block = language_model.unpack(language_model.block_of(data, offsets, ids, np.ones(6, dtype=np.int8), np.isin(ids, list(held)), language_model.tokenizer(model)))
    counts = Counter(w for i, t in rows if i not in held for w in t.split())
    total = sum(counts.values()) + 5
    order = np.argsort(block["hashes"])
    corpus = language_model.Corpus(total, len(counts) + 1, 5, block["hashes"][order], block["train"][order].astype(np.int64))
    size = language_model.tokenizer(model).get_piece_size()
    voc = attention.vocabulary(np.ones(size + 1), np.array([language_model.tokenizer(model).id_to_piece(i).startswith("\u2581") for i in range(size)]))
    none = attention.Pairs(np.zeros((attention.ROWS, attention.CLASSES), dtype=np.float32), np.zeros(attention.ROWS, dtype=np.float32))

    class Held:
        value = attention.Scorer(attention.new_network(), voc, none), corpus

    import pyarrow as pa

    nothing = pa.table({"bucket": pa.array([], pa.int64()), "counts": pa.array([], pa.binary())})
    opens = lambda w: voc.kind[(language_model.tokenizer(model).encode(w) or [0])[0]] if w else voc.kind[voc.end]
    classes = Counter()
    for w, c in [*counts.items(), (None, 5)]:
        classes[opens(w)] += c
    corpus.classes = np.array([classes[k] for k in range(attention.CLASSES)])
    weights = np.random.default_rng(3).dirichlet(np.ones(5), language_model.KINDS)
    for leave_out in (False, True):
        found = language_model.places(block, nothing, Held, leave_out)
        written = language_model._written(Held, ())(pa.table({"payload": pa.array([language_model.pack(**block)], pa.binary())}), nothing)
        read = language_model.read_places(language_model.unpack(written.column("payload")[0].as_buffer()), corpus, leave_out)
        assert (read.own == found.own).all() and (read.text == found.text).all() and (read.kind == found.kind).all()
        assert read.parts == pytest.approx(found.parts, rel=1e-4)
        at = 0
        for n, (i, t) in enumerate(rows):
            before: list[str] = []
            for word in [*t.split(), None]:
                less = int(leave_out and i not in held)
                c = counts[word] if word else 5
                follows = [b for a, b in zip(before, before[1:]) if before and a == before[-1]]
                want = max(c - less, 0) / (total - less), before.count(word) / max(len(before), 1), follows.count(word) / max(len(follows), 1)
                assert tuple(found.parts[[0, 2, 3], at]) == pytest.approx(want), (i, before, word)
                share = max(c - less, 0) / max(classes[opens(word)] - less, 1)
                assert 0 <= found.parts[4, at] <= share + 1e-9 and (found.parts[4, at] > 0) == (share > 0)
                far, met = sum(len(before) >= x for x in (16, 64, 256)), sum((before[:-1].count(before[-1]) if before else 0) >= x for x in (1, 2, 4))
                assert found.kind[at] == far * 4 + met
                assert language_model.mixed(found, weights)[at] == pytest.approx(sum(w * x for w, x in zip(weights[far * 4 + met], found.parts[:, at], strict=True)))
                assert found.text[at] == n and found.own[at] == c
                at += 1
                before.append(word)
        assert at == len(found.own)


def test_the_class_part_sums_to_one():
    """Over all words of a small vocabulary, by every class that has words."""
    scorer = spelling()
    voc, net = scorer.voc, attention.new_network()
    logs = {}
    for x in [*range(300), voc.end]:
        own, begins = attention.log10_probabilities(scorer, np.array([5, x, voc.end][: 2 if x == voc.end else 3]), np.array([2 if x == voc.end else 3]))
        logs[x] = own[1] - voc.log_share[x] - begins[1], voc.kind[x]
    shown = {kind: 10.0**v * voc.begins[kind] for v, kind in logs.values()}
    assert net.out.shape[1] == attention.CLASSES and sum(shown.values()) == pytest.approx(1, abs=1e-3)


def test_weights_are_the_likeliest(spark):
    """Rounds over packed places come to the weights that a search finds, however the places lie."""
    rng = np.random.default_rng(5)
    kind, parts = rng.integers(0, 2, 4000), rng.random((2, 4000)) ** 3
    for cut in (1, 7):
        rows = [(bytearray(language_model.pack(kind=k.astype(np.int16), parts=p.astype(np.float32).ravel())),) for k, p in zip(np.array_split(kind, cut), np.array_split(parts, cut, axis=1), strict=True)]
        table = spark.createDataFrame(rows, "payload binary").repartition(cut)
        found = language_model.fitted(table, 3, 2, rounds=60)
        for k in (0, 1):
            own = parts[:, kind == k]
            best = max(np.linspace(0.001, 0.999, 999), key=lambda w: np.log(w * own[0] + (1 - w) * own[1]).sum())
            assert found[k] == pytest.approx([best, 1 - best], abs=0.02)
        assert tuple(found[2]) == (0.5, 0.5)
        first = found if cut == 1 else first
        assert (found == first).all()


def test_all_texts_are_learned_from(spark, monkeypatch):
    """Every window of every learning text reaches the network once, and the places of all learning texts tell the weights; one in 16 did before."""
    rows = [(i, " ".join(f"w{i % 7} v{(i * k) % 11}" for k in range(1 + 9 * (i % 5)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    told, fit, cut = {}, language_model.fitted, language_model.learned

    def learned(shards, net, *more):
        told["windows"] = [language_model._inputs(r["payload"]) for r in shards.collect()]
        told["rounds"] = {r["shard"] % language_model.ROUNDS for r in shards.collect()}
        return cut(shards, net, *more)

    def fitted(table, kinds, parts, read, **more):
        told["places"] = sum(len(read(pa.py_buffer(bytes(r["payload"])))[0]) for r in table.collect())
        return fit(table, kinds, parts, read=read, **more)

    import pyarrow as pa

    monkeypatch.setattr(language_model, "learned", learned)
    monkeypatch.setattr(language_model, "fitted", fitted)
    found = language_model.score(docs, F.col("doc_id") % 10 == 0, windows=4, block_bytes=600).collect()
    with open(language_model.TOKENIZER, "rb") as file:
        pieces = language_model.tokenizer(file.read())
    sizes = [sum(len(p) for p in pieces.encode(t.split())) + 1 for i, t in rows if i % 10]
    assert sum(aimed.sum() for _, _, _, aimed in told["windows"]) == sum(sizes)
    assert sum(len(x[0]) for x in told["windows"]) == sum(-(-n // attention.STEP) for n in sizes) and told["rounds"] == {0, 1, 2}
    assert told["places"] == sum(r["n_tokens"] for r in found if not r["held_out"])


def test_weight_of_the_counts_from_bins():
    """Bins of the share of one part give the weights that rounds over all places give."""
    rng = np.random.default_rng(9)
    parts, bins = rng.random((2, 6000)) ** 2, 1024
    share = parts[0] / parts.sum(axis=0)
    at = np.minimum((share * bins).astype(int), bins - 1)
    counts = np.bincount(at, minlength=bins)
    means = np.bincount(at, weights=share, minlength=bins) / np.maximum(counts, 1)
    found = language_model.two_weights(np.stack([counts, 0 * counts]), np.stack([means, means]), rounds=10)
    weight = 0.5
    for _ in range(10):
        weight = (weight * parts[1] / (weight * parts[1] + (1 - weight) * parts[0])).mean()
    assert found == pytest.approx([weight, 0.5], abs=1e-5)


def test_scores_do_not_depend_on_the_layout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    two, seven = ({r["doc_id"]: (r["base_score"], r["score"]) for r in language_model.score(docs.repartition(n, F.rand(n)), F.col("doc_id") % 10 == 0, windows=50, block_bytes=b).collect()} for n, b in ((2, 1 << 20), (7, 20_000)))
    assert two.keys() == seven.keys()
    for i, own in two.items():
        assert seven[i] == pytest.approx(own, rel=1e-5), i


def test_the_network_carries_the_score(spark):
    """Without the parts that come from the network the held-out texts are clearly less likely."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    totals = []
    for without in ((), ("classes",), ("subwords", "classes")):
        rows = [r for r in language_model.score(docs, F.col("doc_id") % 10 == 0, without=without).collect() if r["held_out"]]
        totals.append(sum(r["score"] for r in rows) / sum(r["n_tokens"] for r in rows))
    assert totals[0] > totals[1] + 0.04 and totals[1] > totals[2] + 1, totals


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_the_model_beats_the_word_counts_on_held_out_texts(found, size):
    rows = [r for r in found("op4_language_model", f"/root/testdata/{size}") if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def literal_repeats(rows, width=13):
    """doc_id, words and kept words of each document, window by window."""
    least: dict[tuple, int] = {}
    for i, t in rows:
        words = t.split()
        for k in range(len(words) - width + 1):
            key = tuple(words[k : k + width])
            least[key] = min(i, least.get(key, i))
    for i, t in rows:
        words = t.split()
        gone = {k + j for k in range(len(words) - width + 1) if least[tuple(words[k : k + width])] < i for j in range(width)}
        yield i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)


def test_passages_of_every_block_and_of_a_few(spark):
    """Many small blocks: one passage is in all documents, so in the lists of frequent windows; others are in two or three, a few in one document twice."""
    rng = random.Random(31)
    prose = lambda n: " ".join(f"v{rng.randrange(4000)}" for _ in range(n))
    common, rare = prose(40), [prose(rng.randrange(13, 30)) for _ in range(60)]
    rows = []
    for i in range(240):
        parts = [prose(rng.randrange(5, 60)), common if i % 3 else prose(3), prose(20)]
        parts += [p for k, p in enumerate(rare) if k in (i % 97, (i * 7) % 211)]
        parts += [parts[0]] if i % 50 == 0 else []
        rows.append((1000 - 3 * i, " ".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    wanted = {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in literal_repeats(rows)}
    for block_bytes in (1500, substring_dedup.BLOCK_BYTES):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.repeats(docs, block_bytes).collect()}
        assert got == wanted
    blocks = substring_dedup._ingest(docs, 1500)
    known = substring_dedup._known(blocks, 1)
    assert blocks.count() > 60 and known.windows.shape[1] >= 28 and (known.least[known.least < 2**62].min() >= 1000 - 3 * 239)


def test_words_of_every_block_are_counted(spark):
    rng = random.Random(37)
    rows = [(i, " ".join(["the", "of", *(f"v{rng.randrange(3000)}" for _ in range(rng.randrange(1, 80))), "the"])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    counts = Counter(w for i, t in rows if i % 5 for w in t.split())
    n, v, texts = sum(counts.values()), len(counts), sum(1 for i, _ in rows if i % 5)
    n, v = n + texts, v + 1
    for r in language_model.score(docs, F.col("doc_id") % 5 == 0, windows=50, block_bytes=1000).collect():
        own = dict(rows)[r["doc_id"]].split()
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own) + 1, sum(counts[w] > 0 for w in own) + 1, n)
        assert r["base_score"] == pytest.approx(sum(np.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in [*(counts[w] for w in own), texts]))


def grams(spec, text):
    """For each section the features of a text's n-grams, one n-gram after the other."""
    raw = text.encode()
    if spec.lower:
        raw = raw.translate(tb.LOWER)
    for number, (section, start) in enumerate(zip(spec.sections, spec.starts(), strict=False)):
        found = []
        if section.kind == "byte":
            units = [raw[i : i + 1] for i in range(len(raw))]
            bucket = lambda own: tb.gram_indexes(np.frombuffer(b"".join(own), dtype=np.uint8), section.width, section.bits, number + 1)[0]  # noqa: B023, E731
        elif section.kind == "char":
            units = list(raw.decode())
            bucket = lambda own: tb.point_gram_indexes(np.array([ord(c) for c in own], dtype=np.uint32), section.width, section.bits, number + 1)[0]  # noqa: B023, E731
        else:
            units = raw.split()

            def bucket(own):
                data = np.frombuffer(b" ".join(own), dtype=np.uint8)
                begins, ends, _ = tb.word_bounds(data, np.array([0, len(data)]))
                return tb.window_hashes(tb.span_hashes(data, begins, ends), section.width)[0] >> np.uint64(64 - section.bits)  # noqa: B023

        for i in range(len(units) - section.width + 1):
            found.append(start + int(bucket(units[i : i + section.width])))
        yield found


def literal_margin(spec, weights, text):
    return sum(sum(weights[f] for f in found) / len(found) for found in grams(spec, text) if found)


ODD_TEXTS = ["", "a", "Ä b", "語言 模型 語言", "one two one two\nthree", "Привет, мир! " * 4, "$$$ ### %% 100 <b>", "x" * 90]


def test_scores_are_those_of_a_literal_predictor(spark):
    """Language ID, quality classifier and quality rules from their fitted parameters, n-gram by n-gram."""
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    some = [r["text"] for r in base.where("length(text) < 700").orderBy("doc_id").limit(12).collect()] + ODD_TEXTS
    rows = spark.createDataFrame(list(enumerate(some)), "doc_id bigint, text string")
    curve = lambda x: 1 / (1 + np.exp(-x))

    model = quality_rules.fit(base, labels)
    got = {r["doc_id"]: r["probability"] for r in quality_rules.judge(rows, model).collect()}
    for i, text in enumerate(some):
        assert got[i] == pytest.approx(curve(literal_margin(quality_rules.SPEC, model.weights[:, 0], text) * model.slope + model.offset), rel=1e-6)

    model = language_id.fit(base, F.lit(True))
    got = {r["doc_id"]: r for r in language_id.predict(rows, model).collect()}
    for i, text in enumerate(some):
        if got[i]["lang_pred"] == "und":
            assert not any(c.isalpha() for c in text)
            continue
        hidden = sum((np.mean([model.embeddings[f] for f in found], axis=0) for found in grams(language_id.SPEC, text) if found), np.zeros(language_id.DIMENSIONS))
        z = (hidden @ model.output + model.bias) * model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[i]["score"] == pytest.approx(p.max(), rel=1e-6) and got[i]["lang_pred"] == model.languages[int(p.argmax())]

    model = quality_classifier.fit(base, labels, F.lit(True))
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(rows, model).collect()}
    for i, text in enumerate(some):
        there = sorted({f for found in grams(quality_classifier.SPEC, text) for f in found})
        scaled = model.ratio[there]
        margin = float(model.weights[there] @ scaled) / max(float(np.sqrt((scaled**2).sum())), 1e-9) if there else 0.0
        assert got[i] == pytest.approx(curve((margin + model.intercept) * model.slope + model.offset), rel=1e-4)


def test_held_out_accuracy(found):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    langs = dict(con.execute(f"SELECT doc_id, lang FROM '{sf}/documents.parquet' WHERE len(text) > 100").fetchall())
    held = [r for r in found("op2_language_id", sf) if r["held_out"] and r["doc_id"] in langs]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) > 0.97
    quality = dict(con.execute(f"SELECT l.doc_id, quality FROM '{sf}/labels.parquet' l JOIN '{sf}/documents.parquet' d ON d.doc_id = l.doc_id WHERE n_chars > 400").fetchall())
    judged = [(r["score"], quality[r["doc_id"]]) for r in found("op5_quality_classifier", sf) if r["held_out"] and r["doc_id"] in quality]
    good, bad = [s for s, q in judged if q], [s for s, q in judged if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    kept = {r["doc_id"]: r["kept"] for r in found("op9_quality_rules", sf)}
    assert np.mean([kept[i] for i, q in quality.items() if q]) > 0.95 and np.mean([kept[i] for i, q in quality.items() if not q]) < 0.3


def test_windows_are_deleted_once_they_are_learned_from(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} v{i % 11} x y z") for i in range(60)], "doc_id bigint, text string")
    made, plain = [], language_model.runtime.scratch_path
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(language_model.runtime, "scratch_path", lambda *at: made.append(plain(*at)) or made[-1])
        assert language_model.score(docs, docs["doc_id"] >= 50, windows=20).count() == 60
    left = [os.path.basename(p).split("-")[0] for p in made if os.path.exists(p.removeprefix("file://"))]
    assert "windows" not in left and {"blocks", "places"} <= set(left)


def test_windows_travel_one_round_at_a_time(spark, monkeypatch):
    """A round's windows are dealt without those of the others, and no table of all windows is written; on 0.51 GB that table and its shuffle took more than the disk allowed."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i % 7} v{(i * k) % 11}" for k in range(40))) for i in range(60)], "doc_id bigint, text string").repartition(3)
    tags, met, write, cut = [], {}, language_model.runtime.materialize, language_model.learned

    def learned(shards, net, rounds, dealt):
        numbers = lambda rows: sorted(int(u) for r in rows for u in np.frombuffer(r["payload"], dtype=language_model._WINDOW)["u"])
        for seed in range(rounds):
            rows = dealt(seed).collect()
            assert {r["shard"] % rounds for r in rows} == {seed}
            met[seed] = numbers(rows)
        met["all"] = numbers(shards.collect())
        return cut(shards, net, rounds, dealt)

    monkeypatch.setattr(language_model.runtime, "materialize", lambda df, tag, *more, **named: tags.append(tag) or write(df, tag, *more, **named))
    monkeypatch.setattr(language_model, "learned", learned)
    language_model.score(docs, F.col("doc_id") % 10 == 0, windows=4, block_bytes=600).collect()
    assert sorted(tags) == ["blocks", "counts", "places"]
    assert sorted(u for seed in range(language_model.ROUNDS) for u in met[seed]) == met["all"] and len(met["all"]) == len(set(met["all"])) > 54


def test_shards_come_whole_and_in_order():
    """Rows of a shard, cut by blocks and batches, make its windows in the order of their numbers; a repeated window is one."""
    import pyarrow as pa

    def row(*numbers):
        own = np.zeros(len(numbers), dtype=language_model._WINDOW)
        own["u"], own["kinds"] = numbers, np.array(numbers)[:, None]
        return own.tobytes()

    batch = lambda shards, payloads: pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(payloads, pa.binary())], names=["shard", "payload"])
    found = list(language_model._shards([batch([3, 3], [row(9, 2), row(5)]), batch([3, 4], [row(2, 1), row(7)])]))
    assert [x["u"].tolist() for x in found] == [[1, 2, 5, 9], [7]]
    assert [x["kinds"][:, 0].tolist() for x in found] == [[1, 2, 5, 9], [7]]
