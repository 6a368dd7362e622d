"""Entropy balancing against a plain solution by bisection over all documents."""

import math
import re
from collections import defaultdict
from fractions import Fraction

import pytest

from quillspark.llm import mixing
from quillspark.llm.mixing import mix, repeated, shared_targets
from quillspark.llm.queries import op11_mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    """Round by round: every source above its bound gives its excess to the others."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    share = Fraction(3 * sum(sizes.values()), 2)
    target = {s: share * weight[s] / sum(weight.values()) for s in order}
    full = set()
    while over := {s for s in order if target[s] > 2 * sizes[s]}:
        excess = sum(target[s] - 2 * sizes[s] for s in over)
        full |= over
        target |= {s: Fraction(2 * sizes[s]) for s in over}
        free = [s for s in order if s not in full]
        for s in free:
            target[s] += excess * weight[s] / sum(weight[f] for f in free)
    return target


def plain_rates(sizes, target):
    """min(2, exp(x * size)) with the x that meets the target."""
    rate = lambda x, z: 2.0 if x * z > math.log(2) else math.exp(x * z)
    low, high = -50.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(rate(mid, z) * z for z in sizes) < target else (low, mid)
    return {z: rate(high, z) for z in sizes}


def check(rows, close):
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    target = plain_targets({s: sum(r.size for r in rs) for s, rs in by.items()})
    for s, rs in by.items():
        assert {r.source_size for r in rs} == {sum(r.size for r in rs)}
        assert all(abs(r.target - float(target[s])) < 1e-6 * max(1, r.target) for r in rs)
        want = plain_rates([r.size for r in rs if r.size], float(target[s]))
        for r in rs:
            assert r.taken == r.copies * r.size <= 2 * r.size
            assert math.floor(r.rate) <= r.copies <= math.ceil(r.rate)
            if r.size:
                assert abs(r.rate - want[r.size]) < 1e-4
        assert abs(sum(r.taken for r in rs) - float(target[s])) <= close * max(r.size for r in rs) + 1


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_brute_force(spark, sf):
    path = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rows = mix(docs, lambda z: shared_targets(z, (3, 1, 2), Fraction(3, 2), 2)).collect()
    text = {r.doc_id: r for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(text)
    assert all(r.size == len(WORD.findall(text[r.doc_id].text)) and r.source == text[r.doc_id].source for r in rows)
    check(rows, 1)
    again = {r.doc_id: r.taken for r in op11_mixing(spark, path).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_any_partitioning_gives_the_same(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    share = lambda z: shared_targets(z, (3, 1, 2), Fraction(3, 2), 2)
    a, b = (sorted(mix(docs.repartition(n), share).collect()) for n in (3, 7))
    assert a == b


def test_edges(spark, monkeypatch):
    share = lambda z: shared_targets(z, (3, 1, 2), Fraction(3, 2), 2)
    schema = "doc_id long, text string, source string, size string, rate int, s string, `key` int"
    assert mix(spark.createDataFrame([], schema), share).count() == 0
    rows = [(1, None, "a", "x", 1, "y", 2), (2, "", "a", "x", 1, "y", 2), (3, " \t", None, "x", 1, "y", 2)]
    assert {(r.doc_id, r.size, r.taken, r.target) for r in mix(spark.createDataFrame(rows, schema), share).collect()} == {(1, 0, 0, 0.0), (2, 0, 0, 0.0), (3, 0, 0, 0.0)}
    rows = [(i % 7 if i % 5 else None, "w " * (i % 11 + 1), (None, "a", "B", "é")[i % 4], "x", 1, "y", 2) for i in range(400)] + [(9, "v " * 90_000, "a", "x", 1, "y", 2)]
    check(mix(spark.createDataFrame(rows, schema), share).collect(), 2)
    monkeypatch.setattr(mixing, "CELL", 4)  # hot cells are dealt out
    monkeypatch.setattr(mixing, "BROADCAST", 3)
    got = mix(spark.createDataFrame([(i, "w w", "a" if i < 3000 else "b", "x", 1, "y", 2) for i in range(4000)], schema), share).collect()
    check(got, 60)
    monkeypatch.setattr(mixing, "SOURCES", 1)
    with pytest.raises(ValueError):
        mix(spark.createDataFrame(rows, schema), share)


def test_targets_of_one_source_and_above_the_cap(spark):
    docs = spark.createDataFrame([(i, "w " * (i + 1), "a") for i in range(50)], "doc_id long, text string, source string")
    total = sum(range(1, 51))
    for target, taken in ((9 * total, 2 * total), (2 * total, 2 * total), (0, 0)):
        assert sum(r.taken for r in mix(docs, lambda z, t=target: {"a": t}).collect()) == taken
    for target in (total, total // 7, total * 2 - 3, 5):
        assert abs(sum(r.taken for r in mix(docs, lambda z, t=target: {"a": t}).collect()) - target) <= 50


def test_copies_of_documents(spark):
    docs = spark.createDataFrame([(i, "w " * (i + 1), "a") for i in range(50)], "doc_id long, text string, source string")
    mixed = mix(docs, lambda z: {"a": 1.3 * z["a"]})
    out = repeated(docs, mixed)
    assert out.columns == docs.columns
    want = {r.doc_id: r.copies for r in mixed.collect() if r.copies}
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == want
