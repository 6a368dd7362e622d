"""Graphs worked on by rounds of joins, against one linear search a page."""

import random

import pytest

from quillspark.operators import network, rounds

from .test_pages import EDGE, GRAPHS


@pytest.fixture(scope="module")
def graphs(spark):
    rng, rows = random.Random(4), []
    for i, name in enumerate(GRAPHS):
        rows += [(i, a, b, 1) for a, b in GRAPHS[name][0]]
    for page in range(100, 120):  # from forests to dense graphs, with self-edges and double edges
        n = rng.randint(2, 9)
        rows += [(page, rng.randrange(n), rng.randrange(n), 1) for _ in range(rng.randint(1, 3 * n))]
    for page in range(130, 134):  # rings and cliques in a row, joined by single nodes
        at = 0
        for _ in range(rng.randint(2, 5)):
            k = rng.randint(2, 6)
            rows += [(page, at + a, at + (a + 1) % k, 1) for a in range(k)] + [(page, at, at + 2, 1)] * (k > 3)
            at += k - rng.randint(0, 1)
    rows += [(140, a, (a + k) % 90, 1) for a in range(90) for k in (1, 11, 34)]  # over 64 sources
    return spark.createDataFrame(list(dict.fromkeys(rows)), EDGE).cache()


def by_page(df, *keys):
    return {tuple(r[k] for k in ("page_id", *keys)): r.asDict() for r in df.collect()}


def test_same_as_one_search_a_page(graphs, monkeypatch):
    jobs = {
        "cuts": (network.cut_counts, ()), "distances": (network.bfs_distances, ("src", "dst")), "closeness": (network.closeness_stats, ()), "shares": (network.betweenness_scores, ("node",)),
        "weak": (network.components, ("node",)),
    }
    small = {k: by_page(f(graphs), *keys) for k, (f, keys) in jobs.items()}
    monkeypatch.setattr(network, "NODES", 3)
    monkeypatch.setattr(rounds, "SOURCES", 40)
    for k, (f, keys) in jobs.items():
        got = by_page(f(graphs), *keys)
        assert got.keys() == small[k].keys(), k
        for key, row in got.items():
            assert row == pytest.approx(small[k][key], nan_ok=True), (k, key)
    near = by_page(network.bfs_distances(graphs, hops=3), "src", "dst")
    assert near == {k: r for k, r in small["distances"].items() if r["distance"] <= 3}


def test_edges_bound(graphs, monkeypatch):
    monkeypatch.setattr(network, "EDGES", 12)
    few, many = network.by_size(graphs)
    per = {r.page_id: r["count"] for r in graphs.groupBy("page_id").count().collect()}
    assert {r.page_id for r in many.collect()} == {p for p, n in per.items() if n > 12} and few.count() + many.count() == graphs.count()


def test_nothing_to_do(graphs):
    for f in (rounds.pair_distances, rounds.path_shares, rounds.cut_nodes_by_rounds, rounds.weak_labels):
        assert f(graphs.limit(0)).count() == 0
    alone = graphs.where("page_id = 6")  # a self-edge only
    assert rounds.pair_distances(alone).count() == 0
    [r] = rounds.cut_nodes_by_rounds(alone).collect()
    assert (r.articulation_points, r.is_biconnected) == (0, 0)
