"""Registered queries do the whole job of their operators."""

import pytest

from quillspark import catalog
from quillspark.operators import network

SF = "/root/testdata/sf0.01"


def adjacency(spark):
    near = {}
    for r in catalog.queries()["editor_edges"](spark, SF).collect():
        near.setdefault(r.page_id, {}).setdefault(r.src, set()).add(r.dst)
        near[r.page_id].setdefault(r.dst, set())
    return {p: {a: b - {a} for a, b in g.items()} for p, g in near.items()}


def distances(graph):
    out = {}
    for start in graph:
        front, seen, d = {start}, {start}, 0
        while front:
            d += 1
            front = {w for v in front for w in graph[v]} - seen
            seen |= front
            out |= {(start, w): d for w in front}
    return out


def test_distances(spark):
    want = {(p, *pair): d for p, g in adjacency(spark).items() for pair, d in distances(g).items()}
    assert {(r.page_id, r.src, r.dst): r.distance for r in catalog.queries()["bfs_distances"](spark, SF).collect()} == want
    assert max(want.values()) > 12


def test_closeness(spark):
    got = {r.page_id: r.closeness_mean for r in catalog.queries()["closeness_stats"](spark, SF).collect()}
    for p, g in adjacency(spark).items():
        into = {v: [] for v in g}
        for (_, t), d in distances(g).items():
            into[t].append(d)
        want = sum(len(x) / sum(x) * len(x) / (len(g) - 1) for x in into.values() if x) / len(g)
        assert got[p] == pytest.approx(want, abs=2e-6)


def test_page_is_split(spark, monkeypatch):
    """One page's sources go to several tasks; sums over blocks are those of the whole graph."""
    monkeypatch.setattr(network, "STEPS", 2000)
    near = {v: {(v * 7 + k) % 60 for k in (1, 2, 5)} - {v} for v in range(60)}
    e = spark.createDataFrame([(1, a, b, 1) for a in near for b in near[a]], "page_id long, src long, dst long, weight long")
    blocks = network.source_blocks(e).collect()
    assert len(blocks) > 3 and sorted(v for b in blocks for v in b.sources) == sorted(near)
    assert {(r.src, r.dst): r.distance for r in network.bfs_distances(e).collect()} == distances(near)
    want = network.betweenness(near)
    got = {r.node: r.betweenness for r in network.betweenness_scores(e).collect()}
    assert got.keys() == want.keys() and all(got[v] == pytest.approx(want[v], abs=1e-9) for v in want)
    whole = network.betweenness_stats(e).first()
    assert whole.betweenness_mean == pytest.approx(sum(want.values()) / 60, abs=1e-9)
