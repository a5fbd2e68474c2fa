"""Differential and property tests of grouping: against a literal single-process version, and on planted identities."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold import runtime
from kinfold.operators import clustering, similarity
from kinfold.operators.components import connected_components, union_find
from kinfold.operators.similarity import cosine_pairs, near_pairs


def identities(sizes, noise, seed, alike=0.0, dims=128):
    """Vectors of planted identities: centres with the cosine ``alike`` to each other, and noise of the length ``noise`` around them."""
    rng = np.random.default_rng(seed)
    basis = np.linalg.qr(rng.normal(size=(dims, len(sizes) + 1)))[0].T
    labels = np.repeat(np.arange(len(sizes)), sizes)
    centres = alike**0.5 * basis[-1] + (1 - alike) ** 0.5 * basis[:-1]
    around = rng.normal(scale=noise / dims**0.5, size=(len(labels), dims))
    return centres[labels] + around, labels.tolist()


def literal_linkage(unit, anchors, threshold):
    """All cluster pairs by the mean of their member similarities, again and again."""
    sim = unit @ unit.T
    clusters = [([i], anchors[i]) for i in range(len(unit))]
    while True:
        best = None
        for a in range(len(clusters)):
            for b in range(a + 1, len(clusters)):
                pa, pb = clusters[a][1], clusters[b][1]
                if pa is not None and pb is not None and pa != pb:
                    continue
                mean = sim[np.ix_(clusters[a][0], clusters[b][0])].mean()
                if best is None or mean > best[0] + 1e-12:
                    best = mean, a, b
        if best is None or best[0] < threshold - 1e-12:
            return sorted(sorted(c) for c, _ in clusters)
        _, a, b = best
        merged = clusters[a][0] + clusters[b][0], clusters[a][1] if clusters[a][1] is not None else clusters[b][1]
        clusters = [c for k, c in enumerate(clusters) if k not in (a, b)]
        clusters.insert(a, merged)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("threshold", [0.2, 0.363, 0.5])
def test_linkage_equals_literal(seed, threshold):
    x, _ = identities([6, 5, 5, 4], 0.9, seed, 0.4)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    anchors = [None] * len(x)
    anchors[seed], anchors[10] = 100, 200
    assert sorted(sorted(c) for c in clustering.average_linkage(unit, anchors, threshold)) == literal_linkage(unit, anchors, threshold)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("threshold", [0.2, 0.363, 0.5])
def test_linkage_without_a_matrix_is_the_same(seed, threshold):
    x, _ = identities([16, 15, 15, 14, 1, 1], 0.9, seed, 0.4)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    unit[3] = 0
    anchors = [None] * len(x)
    anchors[seed], anchors[20], anchors[21], anchors[50] = 100, 200, 100, 300
    same = lambda found: sorted(sorted(c) for c in found)
    assert same(clustering.chained_linkage(unit, anchors, threshold)) == same(clustering.average_linkage(unit, anchors, threshold))


def faces_of(spark, vectors, persons=None, pinned=()):
    rows = [(i + 1, None if persons is None else persons[i], i in pinned, [float(v) for v in x]) for i, x in enumerate(vectors)]
    return spark.createDataFrame(rows, "id bigint, person_id bigint, pinned boolean, embedding array<float>")


def test_recovers_planted_identities(spark):
    x, labels = identities([20, 15, 10, 5], 0.5, 1)
    found = clustering.recluster(faces_of(spark, x))
    truth = spark.createDataFrame([(i + 1, label) for i, label in enumerate(labels)], "face_id bigint, label int")
    row = clustering.quality(found, truth).first()
    assert (row["purity"], row["completeness"], row["same_partition"]) == (1.0, 1.0, True)


def test_components_give_the_global_result(spark):
    x, _ = identities([8, 7, 6], 0.9, 7, 0.3)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = {r["face_id"]: r["cluster_id"] for r in clustering.recluster(faces_of(spark, x), 0.4).collect()}
    whole = clustering.cluster_ids(np.asarray(np.float32(x), dtype=np.float64) / np.linalg.norm(np.float32(x).astype(np.float64), axis=1, keepdims=True), [None] * len(unit), np.arange(len(unit)), 0.4)
    assert found == {i + 1: int(c) for i, c in enumerate(whole)}


def test_pins_hold_and_regrouping_is_stable(spark):
    x, _ = identities([10, 10, 10], 0.5, 3)
    persons = [None] * 30
    pinned = {0: 100, 1: 100, 2: 100, 10: 200, 11: 200, 20: 100}
    for i, p in pinned.items():
        persons[i] = p
    faces = faces_of(spark, x, persons, set(pinned))
    people = spark.createDataFrame([(100, "Ann", "#e6194b"), (200, "Persona 7", "#3cb44b"), (300, "Persona 9", "#000001"), (301, "Grandma", "#000002")], "id bigint, name string, color string")
    once = clustering.regroup(faces, people)
    kept = {r["id"]: r for r in once.faces.collect()}
    assert all(kept[i + 1]["person_id"] == p and kept[i + 1]["pinned"] for i, p in pinned.items())
    names = {r["id"]: r["name"] for r in once.persons.collect()}
    assert 300 not in names and names[301] == "Grandma"
    twice = clustering.regroup(once.faces, once.persons)
    assert {r["id"]: r["person_id"] for r in twice.faces.collect()} == {i: r["person_id"] for i, r in kept.items()}
    assert {r["id"] for r in twice.persons.collect()} == set(names)


def test_vectors_without_direction_stay_alone(spark):
    x = [[0.0] * 4, [float("nan")] * 4, [1.0, 1, 1, 1], [1.0, 1, 1, 1]]
    found = {r["face_id"]: r["cluster_id"] for r in clustering.recluster(faces_of(spark, x)).collect()}
    assert found == {1: -1, 2: -2, 3: -3, 4: -3}


def test_stabilize_takes_the_largest_overlap(spark):
    faces = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 8), (5, None)], "id bigint, person_id bigint")
    assigned = spark.createDataFrame([(1, -1), (2, -1), (3, -3), (4, -3), (5, -5)], "face_id bigint, cluster_id bigint")
    done = {r["face_id"]: r["person_id"] for r in clustering.stabilize(faces, assigned).collect()}
    assert done == {1: 7, 2: 7, 3: 8, 4: 8, 5: -5}


def test_greedy_joins_the_near_and_opens_the_rest(spark):
    x, _ = identities([5, 5], 0.3, 5)
    faces = faces_of(spark, x, [9] * 3 + [None] * 7)
    done = {r["face_id"]: r["person_id"] for r in clustering.greedy_assign(faces.where("person_id IS NULL"), faces.where("person_id IS NOT NULL")).collect()}
    assert done[4] == done[5] == 9
    assert {done[i] for i in range(6, 11)} == {-1_000_001}


def test_greedy_equals_a_literal_walk(spark):
    x, _ = identities([30, 30, 30], 0.9, 8, 0.2)
    known = [1 + i % 3 if i % 4 else None for i in range(90)]
    faces = faces_of(spark, x, known)
    got = {r["face_id"]: r["person_id"] for r in clustering.greedy_assign(faces.where("person_id IS NULL"), faces.where("person_id IS NOT NULL")).collect()}
    means: dict[int, list] = {}
    for i, p in enumerate(known):
        if p:
            means.setdefault(p, []).append(x[i])
    for i in [i for i, p in enumerate(known) if not p]:
        sims = {p: np.mean(v, axis=0) @ x[i] / np.linalg.norm(np.mean(v, axis=0)) / np.linalg.norm(x[i]) for p, v in means.items()}
        best = max(sims, key=sims.get)
        name = best if sims[best] > 0.363 else -(len(means) + 1_000_000)
        means.setdefault(name, []).append(x[i])
        assert got[i + 1] == name


def test_components_by_rounds_of_contraction(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    found = {r["node"]: r["root"] for r in connected_components(df, finish_edges=5).collect()}
    want = union_find(e for e in edges if e[0] != e[1])
    groups = {}
    for node, top in want.items():
        groups.setdefault(top, set()).add(found.get(node, node))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_pairs_do_not_depend_on_blocks(spark):
    x, _ = identities([9, 8], 0.8, 2, 0.3, dims=16)
    faces = faces_of(spark, x).select("id", "embedding")
    got = [{(r["a"], r["b"]) for r in cosine_pairs(faces, 0.3, rows).collect()} for rows in (2048, 4)]
    assert got[0] == got[1] and got[0]


@pytest.mark.parametrize("seed", [0, 1])
def test_large_components_merge_in_rounds(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 12))
    rows, n = [], 150
    for i in range(n):
        vector = (centres[i % 6] + rng.normal(scale=1.1, size=12)).astype(np.float32).tolist()
        person = int(rng.integers(1, 5)) if rng.random() < 0.3 else None
        rows.append((3 * i + 1, person, bool(rng.random() < 0.5), vector if i != 40 else [0.0] * 12))
    faces = spark.createDataFrame(rows, "id bigint, person_id bigint, pinned boolean, embedding array<float>").repartition(5)
    for threshold in (0.1 + 0.25 * seed,):
        wanted = {r["face_id"]: r["cluster_id"] for r in clustering.recluster(faces, threshold).collect()}
        for most, block in ((20, 16), (2, 40)):
            found = {r["face_id"]: r["cluster_id"] for r in clustering.recluster(faces, threshold, most_rows=most, block_rows=block).collect()}
            assert found == wanted and len(found) == n
    assert len(set(wanted.values())) > 3


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("threshold", [0.2, 0.363, 0.5])
def test_linkage_over_links_is_the_same(seed, threshold):
    x, _ = identities([16, 15, 15, 14, 1, 1], 0.9, seed, 0.4)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    unit[3] = 0
    anchors = [None] * len(x)
    anchors[seed], anchors[20], anchors[21], anchors[50] = 100, 200, 100, 300
    held, tied = np.array([p is not None for p in anchors]), np.array([p or 0 for p in anchors])
    a, b = np.nonzero(np.triu(unit @ unit.T >= threshold, 1) & ~(held[:, None] & held & (tied[:, None] != tied)))
    same = lambda found: sorted(sorted(c) for c in found)
    found = clustering.linked_linkage(unit, np.ones(len(x)), held, tied, a, b, threshold)
    assert same(found) == same(clustering.average_linkage(unit, anchors, threshold))


def test_copies_do_not_take_a_round_each(spark, monkeypatch):
    """Of equal vectors only two are each other's first, so rounds alone would merge one pair at a time."""
    x = [[1.0, 0, 0, 0]] * 24 + [[0.8, 0.6, 0, 0]] * 3 + [[0, 0.6, 0.8, 0]] * 2 + [[0.0, 0, 0, 1]]
    persons = [None] * len(x)
    persons[5], persons[9], persons[12], persons[26] = 100, 200, 200, 300
    faces = faces_of(spark, x, persons, {5, 9, 12, 26})
    wanted = {r["face_id"]: r["cluster_id"] for r in clustering.recluster(faces).collect()}
    rounds, write = [], clustering.runtime.materialize
    monkeypatch.setattr(clustering.runtime, "materialize", lambda df, tag, narrow=1: (tag == "merges" and rounds.append(tag), write(df, tag, narrow))[1])
    found = {r["face_id"]: r["cluster_id"] for r in clustering.recluster(faces, most_rows=3, block_rows=8).collect()}
    assert found == wanted and len(found) == len(x) and found[10] == found[13] == 200 and found[1] == found[24] == 100
    assert 1 <= len(rounds) <= 8


def test_rounds_in_one_task_are_the_same(monkeypatch):
    """The rounds before the chain: few merges are left to it, pins are carried along, and the clusters are those of the matrix."""
    x, _ = identities([40, 30, 30, 20, 1, 1], 0.7, 3, 0.4)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    anchors = [None] * len(x)
    anchors[3], anchors[44], anchors[45], anchors[90] = 100, 200, 100, 300
    held, tied = np.array([p is not None for p in anchors]), np.array([p or 0 for p in anchors])
    a, b = np.nonzero(np.triu(unit @ unit.T >= 0.3, 1))
    top, p, q = clustering.mutual_rounds(unit.copy(), np.ones(len(x)), held.copy(), tied.copy(), a, b, 0.3)
    assert (top[top] == top).all() and (top <= np.arange(len(x))).all() and set(p) | set(q) <= set(top) and (p < q).all()
    wanted = sorted(sorted(c) for c in clustering.average_linkage(unit, anchors, 0.3))
    for share in (1, 64, 1 << 40):
        monkeypatch.setattr(clustering, "ROUND_SHARE", share)
        assert sorted(sorted(c) for c in clustering.linked_linkage(unit, np.ones(len(x)), held, tied, a, b, 0.3)) == wanted


def test_a_graph_that_fits_a_task_takes_no_round_of_jobs(spark, monkeypatch):
    """A component of more than 250 000 links went through rounds of Spark jobs."""
    x = np.eye(24)[np.arange(800) % 24 // 23] + np.random.default_rng(0).normal(scale=0.02, size=(800, 24))
    tags, write = [], clustering.runtime.materialize
    monkeypatch.setattr(clustering.runtime, "materialize", lambda df, tag, narrow=1: (tags.append(tag), write(df, tag, narrow))[1])
    found = {r["face_id"]: r["cluster_id"] for r in clustering.recluster(faces_of(spark, x.tolist())).collect()}
    assert len(set(found.values())) == 2 and "finished" in tags and "merges" not in tags


def test_near_pairs_of_32_bits_lose_nothing():
    """Pairs on the threshold to the last bits of 64 are told as products of 64 bits tell them."""
    rng = np.random.default_rng(5)
    unit = rng.normal(size=(300, 48))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    sim = np.array([[float(np.einsum("i,i", p, q)) for q in unit] for p in unit])
    for threshold in np.sort(sim[np.triu_indices(300, 1)])[[-5, -200, -20000]]:
        a, b, s = near_pairs(unit, np.arange(300), np.arange(300), threshold)
        keep = a < b
        want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(sim, 1) >= threshold - 1e-14), strict=True)}
        sure = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(sim, 1) >= threshold + 1e-14), strict=True)}
        got = set(zip(a[keep].tolist(), b[keep].tolist(), strict=True))
        assert sure <= got <= want and np.allclose(s, sim[a, b], atol=1e-15)


def crowded(spark, monkeypatch):
    """Two persons' faces with more than 250 000 links, and the names of the tables that are written from now on."""
    x = np.eye(24)[np.arange(800) % 24 // 23] + np.random.default_rng(0).normal(scale=0.02, size=(800, 24))
    tags, write = [], clustering.runtime.materialize
    monkeypatch.setattr(clustering.runtime, "materialize", lambda df, tag, narrow=1: (tags.append(tag), write(df, tag, narrow))[1])
    return faces_of(spark, x.tolist(), [7 if i % 24 == 23 else 8 for i in range(800)]), tags


def test_stable_ids_of_a_crowd_take_no_round_of_jobs(spark, monkeypatch):
    faces, tags = crowded(spark, monkeypatch)
    done = {r["face_id"]: r["person_id"] for r in clustering.stabilize(faces, clustering.recluster(faces)).collect()}
    assert done == {i + 1: 7 if i % 24 == 23 else 8 for i in range(800)} and "merges" not in tags


def test_persons_of_a_regrouped_crowd_take_no_round_of_jobs(spark, monkeypatch):
    faces, tags = crowded(spark, monkeypatch)
    persons = spark.createDataFrame([(7, "Alice", "#000000"), (8, "Bob", "#000001"), (9, "Persona 9", "#000002")], "id bigint, name string, color string")
    done = clustering.regroup(faces, persons)
    assert sorted(r["id"] for r in done.persons.collect()) == [7, 8] and "merges" not in tags


def test_faces_of_a_regrouped_crowd_take_no_round_of_jobs(spark, monkeypatch):
    faces, tags = crowded(spark, monkeypatch)
    persons = spark.createDataFrame([(8, "Bob", "#000001")], "id bigint, name string, color string")
    fresh = faces.withColumn("person_id", clustering.F.when(clustering.F.col("person_id") == 8, 8).cast("bigint"))
    done = {r["id"]: r["person_id"] for r in clustering.regroup(fresh, persons).faces.collect()}
    assert done == {i + 1: 9 if i % 24 == 23 else 8 for i in range(800)} and "merges" not in tags


@pytest.mark.parametrize("most", [2000, 300])
def test_more_links_than_a_task_holds_merge_level_by_level(spark, monkeypatch, most):
    """They went through rounds of jobs, of which each computed all links of merged clusters again."""
    x, _ = identities([40, 30, 30, 20, 1, 1], 0.7, 3, 0.4)
    persons = [None] * len(x)
    persons[3], persons[44], persons[45], persons[90] = 100, 200, 100, 300
    faces = faces_of(spark, x.tolist(), persons, {3, 44, 45, 90})
    wanted = {r["face_id"]: r["cluster_id"] for r in clustering.recluster(faces, 0.3).collect()}
    tags, write = [], clustering.runtime.materialize
    monkeypatch.setattr(clustering.runtime, "materialize", lambda df, tag, narrow=1: (tags.append(tag), write(df, tag, narrow))[1])
    monkeypatch.setattr(clustering, "LINKAGE_LINKS", most)
    monkeypatch.setattr(clustering, "LEVEL_SHARE", 1 << 40)
    found = {r["face_id"]: r["cluster_id"] for r in clustering.recluster(faces, 0.3, block_rows=32).collect()}
    assert found == wanted and len(set(found.values())) > 3 and "upper" in tags and "merges" not in tags


def test_a_chain_of_claims_takes_no_round_each(spark, monkeypatch):
    """Each claim of the chain rules out the one that would be next, and only then is the one after it free: 60 rounds of jobs."""
    rows = [(c, p, 200 - 2 * c - (p - c), c) for c in range(60) for p in (c, c + 1)]
    overlap = spark.createDataFrame(rows, "cluster_id bigint, person_id bigint, n bigint, first_face bigint")
    tags, write = [], clustering.runtime.materialize
    monkeypatch.setattr(clustering.runtime, "materialize", lambda df, tag, narrow=1: (tags.append(tag), write(df, tag, narrow))[1])
    whole, cut = ({tuple(r) for r in clustering.claims(overlap, most).collect()} for most in (1000, 110))
    assert whole == cut == {(c, c) for c in range(60)} and tags.count("won") <= 5


def test_blocks_of_vectors_of_any_length_meet(spark):
    """Blocks that hold shorter vectors, none at all or a single one."""
    x = [[1.0, 0.0], [1.0], [0.0, 0.0, 2.0], [], [3.0, 0.0, 0.0], None]
    faces = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id bigint, embedding array<float>")
    for rows in (100, 2, 1):
        assert {(r["a"], r["b"]) for r in cosine_pairs(faces, 0.9, rows).collect()} == {(0, 1), (0, 4), (1, 4)}


@pytest.mark.parametrize("seed", range(4))
def test_components_in_arrays_are_those_of_union_find(seed):
    from kinfold.operators.components import smallest_of

    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 400, (2, 250)) if seed else (np.arange(300), np.arange(300) + 1)
    assert dict(zip(*(v.tolist() for v in smallest_of(a, b)), strict=True)) == union_find(zip(a.tolist(), b.tolist(), strict=True))


def test_each_two_rows_of_a_block_are_compared_once(spark, monkeypatch):
    x, _ = identities([40, 30, 31], 0.6, 5)
    unit = np.asarray(x, dtype=np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    rows = np.arange(len(unit))
    wanted = {(a, b) for a, b in zip(*np.nonzero(unit @ unit.T >= 0.4), strict=True) if a < b}
    for tile in ((16, 24), (7, 13), (256, 1024)):
        monkeypatch.setattr(similarity, "PAIR_TILE", tile)
        a, b, _ = near_pairs(unit, rows, rows, 0.4)
        assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted(wanted)


def test_regrouping_writes_each_vector_once(spark, monkeypatch):
    x, _ = identities([10, 10, 10], 0.5, 3)
    written = []
    plain = runtime.materialize
    monkeypatch.setattr(runtime, "materialize", lambda df, tag, *rest, **more: (written.append((tag, df.columns)), plain(df, tag, *rest, **more))[1])
    people = spark.createDataFrame([(100, "Ann", "#e6194b")], "id bigint, name string, color string")
    done = clustering.regroup(faces_of(spark, x, [100] * 30), people)
    assert done.faces.count() == 30
    assert [tag for tag, columns in written if {"embedding", "sum"} & set(columns)] == ["clusters"]
