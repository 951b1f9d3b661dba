"""Near-duplicate vectors and SimHash groups against brute force."""

import random

import numpy as np
import pytest
import xxhash

from offerloom.llm import simhash
from offerloom.llm.components import connected_components, forest, local_roots
from offerloom.llm.embeddings import near_duplicate_vectors, shard_links
from offerloom.llm.hnsw import Graph


def roots_of(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(90)] + [(i, i + 1) for i in range(1000, 1030)] + [(5000, 5000 + i) for i in range(1, 60)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame([*edges, (None, 3), (7, 7)], "a long, b long")).collect()}
    want = roots_of(edges, {x for e in edges for x in e})
    assert got == {n: c for n, c in want.items() if n in got}
    assert all(want[n] == n for n in want if n not in got)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_connects_what_the_edges_connect():
    a, b = np.array([5, 5, 9, 2]), np.array([6, 7, 5, 2])
    fa, fb = forest(a, b)
    assert len(fa) == 3 and set(fb) == {5}
    assert list(local_roots(np.array([0, 1]), np.array([1, 2]), 4)) == [0, 0, 0, 3]


def test_shard_links_match_brute_force():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 16))
    near = base[:40].repeat(6, 0) + rng.normal(size=(240, 16)) * 0.08
    v = np.concatenate([base, near])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    true = v @ v.T >= 0.93
    np.fill_diagonal(true, False)
    ones = np.ones(len(v), np.int64)
    counts, _, a, b = shard_links(Graph(v), v, v, ones, ones, True)
    assert counts.sum() >= 0.98 * true.sum() and (counts <= true.sum(1)).all()
    q, index = v[:300], v[300:]
    cross = q @ index.T >= 0.93
    cq, ci, _, _ = shard_links(Graph(index), index, q, ones, ones, False)
    assert cq.sum() == ci.sum() and 0.98 * cross.sum() <= cq.sum() <= cross.sum()


def test_a_search_that_finds_only_the_query_fails_the_audit():
    rng = np.random.default_rng(14)
    v = rng.normal(size=(1500, 24))
    v[:30] = v[30:60] + rng.normal(size=(30, 24)) * 0.02
    v /= np.linalg.norm(v, axis=1, keepdims=True)

    class Crippled:
        def search(self, q, beam):
            ids = np.full((len(q), beam), -1, np.int64)
            ids[:, 0] = (q @ v.T.astype(np.float32)).argmax(axis=1)
            return np.where(ids >= 0, 1.0, -1.0), ids

    true = v @ v.T >= 0.93
    np.fill_diagonal(true, False)
    ones = np.ones(len(v), np.int64)
    assert true.sum() and (shard_links(Crippled(), v, v, ones, ones, True)[0] == true.sum(1)).all()


def unit_rows(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def true_links(v):
    true = v @ v.T >= 0.93
    np.fill_diagonal(true, False)
    return true


def test_a_shard_with_few_links_is_searched_once():
    rng = np.random.default_rng(21)
    v = rng.normal(size=(3000, 64))
    v[:15] = v[15:30] + rng.normal(size=(15, 64)) * 0.3
    v = unit_rows(v)
    graph, ones, work = Graph(v), np.ones(len(v), np.int64), []
    search = graph.search
    graph.search = lambda q, beam: (work.append(len(q) * beam), search(q, beam))[1]
    counts, _, _, _ = shard_links(graph, v, v, ones, ones, True)
    assert (counts == true_links(v).sum(1)).all() and counts.sum() == 30
    assert sum(work) <= 1.1 * 32 * len(v)  # nearest nodes that are no links are no reason for wider beams
    work.clear()
    apart = unit_rows(rng.normal(size=(3000, 64)))
    cq, ci, _, _ = shard_links(graph, v, apart, ones, ones, False)
    assert not (apart @ v.T >= 0.93).any() and not cq.any() and not ci.any()
    assert sum(work) <= 1.1 * 32 * len(v)


def test_searches_that_lose_their_way_or_miss_one_of_many_links_are_scanned():
    rng = np.random.default_rng(22)
    v = rng.normal(size=(2000, 32))
    v[:100] = v[100:200] + rng.normal(size=(100, 32)) * 0.02
    v[300:329] = v[300] + rng.normal(size=(29, 32)) * 0.02
    v = unit_rows(v)

    class Astray:
        def search(self, q, beam):
            sims = q.astype(np.float64) @ v.T
            own = sims.argmax(axis=1)
            sims[np.isin(own, (37, 137))[:, None] & (sims > 0.9)] = -1.0  # a linked pair: neither search comes near
            sims[np.ix_(own == 310, [320])] = sims[np.ix_(own == 320, [310])] = -1.0
            ids = np.argsort(-sims, axis=1)[:, :beam]
            return np.take_along_axis(sims, ids, 1), ids

    ones = np.ones(len(v), np.int64)
    counts, _, _, _ = shard_links(Astray(), v, v, ones, ones, True)
    assert (counts == true_links(v).sum(1)).all() and counts[37] == 1 and counts[310] == 28


def test_vectors_edge_cases(spark):
    big = [1e300, 2e300]
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.01], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0], 1), (8, [float("nan"), 1.0], 1),
        (9, [None, 1.0], 1), (10, [1.0, 0.0, 0.0], 1), (11, [0.0, 1.0], 1), (2, [1.0, 0.0], 1), (None, [5.0, 0.0], 1), (12, big, 3), (13, [1.0, 2.0], 3), (14, [], 1),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, node string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(df).collect()), key=str)
    alone = [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 14)]
    linked = [(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (3, 4, 1, False), (None, 4, 1, False), (12, 1, 12, True), (13, 1, 12, False)]
    assert got == sorted(alone + linked, key=str)
    assert near_duplicate_vectors(df.limit(0)).count() == 0


def test_vectors_over_several_shards(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 8))
    v = np.concatenate([base, base[:30] + rng.normal(size=(30, 8)) * 0.03, base[:5].repeat(8, 0) + rng.normal(size=(40, 8)) * 0.02])
    df = spark.createDataFrame([(i, [float(z) for z in x], i % 2) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicate_vectors(df, shard_rows=20).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    edges = [(i, j) for i in range(len(v)) for j in range(i) if i % 2 == j % 2 and u[i] @ u[j] >= 0.93]
    want = roots_of(edges, range(len(v)))
    links = {i: sum(i in e for e in edges) for i in range(len(v))}
    assert got == {i: (links[i], want[i]) for i in range(len(v))}


def slow_fingerprint(text):
    import re

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@pytest.mark.parametrize("text", [None, "", " \n", "One", "A b  C\td\x0be", "é É x y z w v", "a\x1cb \x85 c d e f", "x " * 9])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_fingerprint_is_the_engines_own_hash(spark):
    row = spark.createDataFrame([("the quick Brown fox",)], "t string").selectExpr("xxhash64(lower(t)) AS h").first()
    assert simhash.fingerprint("the quick Brown fox") == row.h % 2**64


@pytest.mark.parametrize("size", [20, 60])
def test_balls_find_every_link(monkeypatch, size):
    rng = np.random.default_rng(1)
    prints = [int(x) for x in rng.integers(0, 2**63, 300)]
    for k in (1, 2, 3, 4, 5):
        prints += [p ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for p in prints[:40]]
    p = np.unique(np.array(prints, np.uint64))
    buckets = simhash.Buckets(p[::3], size)
    met = {leaf: rows for leaf, rows in buckets.route(p, 2)}
    assert len(buckets.leaves) > 3
    monkeypatch.setattr(simhash, "SORT_ROWS", 1 << 14)  # buckets are cut further
    parts = [simhash.ball_edges(p[rows], *buckets.leaves[leaf]) for leaf, rows in met.items()]
    a, b = forest(np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]))
    pairs = [(i, j) for i in range(len(p)) for j in range(i) if int(np.bitwise_count(p[i] ^ p[j])) <= 4]
    want = roots_of(pairs, range(len(p)))
    got = local_roots(np.searchsorted(p, a), np.searchsorted(p, b), len(p))
    assert [want[i] for i in range(len(p))] == got.tolist()


def test_buckets_do_not_grow_with_the_corpus():
    """The most that one task sees stays near a fixed number when there are four times as many fingerprints."""
    rng = np.random.default_rng(3)
    seen = []
    for n in (20_000, 80_000):
        p = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        buckets = simhash.Buckets(p[::16], 32)  # about 512 of its own
        seen.append(max(len(rows) for _, rows in buckets.route(p, 2)))
    assert seen[1] < 1.8 * seen[0] and seen[1] < 0.3 * 80_000


def test_edges_over_many_buckets(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**62, 1500)
    near = base[:400] ^ np.array([sum(1 << int(b) for b in rng.choice(63, k, replace=False)) for k in rng.integers(1, 6, 400)])
    p = np.unique(np.concatenate([base, near]).astype(np.int64))
    monkeypatch.setattr(simhash, "SAMPLE_SHARE", 0.5)
    edges = simhash.near_print_edges(spark.createDataFrame([(int(x),) for x in p], "fp long"), bucket_prints=64).collect()
    got = roots_of([(r.a, r.b) for r in edges], p.tolist())
    pairs = [(int(p[i]), int(p[j])) for i in range(len(p)) for j in np.flatnonzero(np.bitwise_count(p[:i] ^ p[i]) <= 4)]
    assert pairs and got == roots_of(pairs, p.tolist())


def test_groups_and_dropping(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(1, long), (2, long), (3, long + " more"), (4, ""), (5, None), (6, "quite another text with some words"), (6, "quite another text with some words"), (None, "left alone here by all"), (8, " \t")]
    df = spark.createDataFrame([(i, t, "k", 1.5) for i, t in rows], "doc_id long, text string, fp string, component_id double")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.simhash_groups(df).collect()), key=str)
    prints = [slow_fingerprint(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 4]
    root = roots_of(near, range(len(rows)))
    low = {c: min((rows[i][0] for i in range(len(rows)) if root[i] == c and rows[i][0] is not None), default=None) for c in set(root.values())}
    assert got == sorted(((rows[i][0], low[root[i]]) for i in range(len(rows))), key=str)
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted({low[c] for c in low if low[c] is not None} | {None}, key=str)
    assert simhash.drop_near_copies(df.limit(0)).count() == 0
