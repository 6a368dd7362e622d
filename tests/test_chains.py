"""Searches from branching nodes against one linear search from every node, and pages of thousands of nodes in one task."""

import random

import numpy as np
import pytest

from quillspark.operators import chains, network, rounds

EDGE = "page_id long, src long, dst long, weight long"
LONG = 6000


def graphs(seed, count):
    """Random graphs, half of them with edges drawn out to chains: rings, loops, parallel chains and loose ends."""
    rng = random.Random(seed)
    for i in range(count):
        n, edges, fresh = rng.randint(1, 12), [], 100
        for _ in range(rng.randint(1, 2 * n)):
            at, end = rng.randrange(n), rng.randrange(n)
            for _ in range(rng.randint(0, 4) * (i % 2)):
                edges.append((at, fresh))
                at, fresh = fresh, fresh + 1
            edges.append((at, end))
        yield edges


def adjacent(edges):
    near = {v: set() for e in edges for v in e}
    for a, b in edges:
        near[a] |= {b} - {a}
    return near


def contracted(edges):
    return chains.contract(*(np.array(x) for x in zip(*edges, strict=True)))


def test_same_as_a_search_from_every_node(monkeypatch):
    monkeypatch.setattr(chains, "CELLS", 12)
    for edges in graphs(1, 300):
        near, g = adjacent(edges), contracted(edges)
        k = len(g.branch)
        parts = [chains.search(k, g.head, g.tail, g.length, low, min(k, low + 3), shares=True) for low in range(0, max(1, k), 3)]
        r, d, score = chains.spread(g, chains.Found(*(sum(getattr(p, c) for p in parts) for c in chains.FIELDS)))
        hops = {v: network.reach(near, v) for v in near}
        share = network.dependencies(near, near)
        for i, v in enumerate(g.names.tolist()):
            into = [h[v] for h in hops.values() if h.get(v)]
            assert (r[i], d[i]) == (len(into), sum(into)), edges
            assert score[i] == pytest.approx(share[v], abs=1e-9), edges


def test_more_paths_than_a_double_holds():
    """1,100 diamonds in a row have 2**1100 paths; each side of a diamond has half of those through it."""
    g = contracted([(3 * i + a, 3 * i + b) for i in range(1100) for a, b in ((0, 1), (0, 2), (1, 3), (2, 3))])
    k = len(g.branch)
    score = chains.spread(g, chains.search(k, g.head, g.tail, g.length, 0, k, shares=True))[2]
    n = 3 * 1100 + 1
    for i in (0, 500, 1099):
        before, after = 3 * i, n - 3 * i - 4
        assert score[3 * i + 1] == pytest.approx((before + 1) * (after + 1) / 2)


@pytest.fixture(scope="module")
def long_page(spark):
    """A path of 6,000 nodes, in one page beside a small one."""
    return spark.createDataFrame([(1, i, i + 1, 1) for i in range(LONG - 1)] + [(2, 1, 2, 1)], EDGE).cache()


@pytest.fixture(autouse=True)
def no_rounds(monkeypatch):
    def never(*args, **more):
        raise AssertionError("a page of thousands of nodes is worked on in rounds")

    for name in ("bit_search", "pair_distances", "path_shares", "weak_labels", "cut_nodes_by_rounds"):
        monkeypatch.setattr(rounds, name, never)
    monkeypatch.setattr(network, "min_reach", never)


def test_betweenness_of_a_long_page(long_page):
    got = {r.node: r.betweenness for r in network.betweenness_scores(long_page).where("page_id = 1").collect()}
    assert len(got) == LONG and all(got[i] == pytest.approx(i * (LONG - 1 - i) / (LONG - 1) / (LONG - 2), abs=1e-12) for i in got)


def test_distances_of_a_long_page(long_page):
    got = network.bfs_distances(long_page).where("page_id = 1").selectExpr("count(*) n", "count(distinct src, dst) p", "sum(distance) d", "max(dst - src - distance) a", "min(dst - src - distance) b").first()
    assert tuple(got) == (LONG * (LONG - 1) // 2, LONG * (LONG - 1) // 2, LONG * (LONG * LONG - 1) // 6, 0, 0)


def test_pairs_within_a_limit():
    rng = np.random.default_rng(3)
    for edges in graphs(2, 200):
        near, g = adjacent(edges), contracted(edges)
        for limit in (None, 3):
            want = sorted((v, w, h) for v in near for w, h in network.reach(near, v, limit).items() if h)
            parts = np.array_split(rng.permutation(len(g.names)), 3)
            assert want == sorted((int(g.names[s]), int(g.names[w]), int(h)) for p in parts for s, to, hops in chains.pairs(g, p, limit) for w, h in zip(to, hops, strict=True)), edges


def test_features_of_a_long_page(long_page):
    got = network.network_features(long_page).where("page_id = 1").first().asDict()
    n, want = LONG, {"num_edges": LONG - 1, "num_nodes": LONG, "triangles": 0, "in_degree_median": 1.0, "articulation_points": LONG - 2, "is_biconnected": 0}
    want |= {"weak_components": 1, "weak_large_components": 1, "weak_max_size": n, "strong_components": n, "strong_large_components": 0, "strong_max_size": 1}
    want |= {"betweenness_mean": sum(i * (n - 1 - i) for i in range(n)) / (n - 1) / (n - 2) / n, "out_degree_mean": (n - 1) / n, "density": 1 / n}
    assert {c: got[f"NETWORK_{c}"] for c in want} == pytest.approx(want)


def test_cut_nodes_of_a_long_page(long_page):
    assert {r.page_id: r.articulation_points for r in network.cut_counts(long_page).collect()} == {1: LONG - 2, 2: 0}


def test_closeness_of_a_long_page(long_page):
    got = network.closeness_stats(long_page).where("page_id = 1").first().closeness_mean
    assert got == pytest.approx(sum(2 / (i + 1) * i / (LONG - 1) for i in range(1, LONG)) / LONG)


def test_weak_components_of_a_long_page(long_page):
    got = network.component_summary(network.components(long_page), over=2, prefix="weak").orderBy("page_id").collect()
    assert [tuple(r) for r in got] == [(1, 1, 1, LONG), (2, 1, 0, 2)]


def test_a_long_ring_is_biconnected(spark):
    ring = spark.range(LONG).selectExpr("1L page_id", "id src", f"(id + 1) % {LONG} dst", "1L weight")
    assert network.cut_counts(ring).first().is_biconnected == 1


def test_strong_components_of_a_long_page(long_page):
    got = network.component_summary(network.components(long_page, directed=True), over=1, prefix="strong").orderBy("page_id").collect()
    assert [tuple(r) for r in got] == [(1, LONG, 0, 1), (2, 2, 0, 1)]
