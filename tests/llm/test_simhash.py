"""Fingerprints and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from quillspark.llm import simhash as S


def plain(text, width=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    sh = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps, radius=3):
    """fp -> smallest fp reachable."""
    fps, seen = sorted(set(fps)), {}
    for f in fps:
        if f in seen:
            continue
        todo = [f]
        seen[f] = f
        while todo:
            x = todo.pop()
            for y in fps:
                if y not in seen and (x ^ y).bit_count() <= radius:
                    seen[y] = f
                    todo.append(y)
    return seen


def clustered(rng, n):
    out = [rng.getrandbits(64) for _ in range(n // 3)] + [0]
    while len(out) < n:
        x = rng.choice(out)
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return out


@pytest.mark.parametrize("text", ["", None, " \n\t", "One", "one two", "one two three", "A b C d e\x0bf  g", "x " * 9000, "é \x1c ü a b c \x85 d"])
def test_fingerprint(text):
    assert S.fingerprint(text) == plain(text)


@pytest.mark.parametrize("k", [4, 5, 6])
def test_plans_cover_all_links(k):
    plan = {4: S.block_plan(10, 3), 5: S.block_plan(1 << 22, 3), 6: S.block_plan(1 << 40, 3)}[k]
    assert len(plan) == {4: 4, 5: 10, 6: 20}[k]
    rng = random.Random(k)
    for _ in range(2000):
        bits = set(rng.sample(range(64), 3))
        assert any(all(not any(a <= b < a + w for b in bits) for a, w in c) for c in plan)


def test_batch_links():
    rng = random.Random(2)
    rows = [clustered(rng, n) for n in (2, 5, 60, 300)]
    rows = [list(dict.fromkeys(r)) for r in rows]
    a, b = S.batch_links([np.array(r, np.uint64) for r in rows], [None] * 4, 3)
    joined = {}
    for r in rows:
        joined |= {(x, y): None for x, y in brute(r).items() if x != y}
    want = brute([x for r in rows for x in r])
    got = {x: x for r in rows for x in r}

    def top(x):
        while got[x] != x:
            x = got[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        assert (x ^ y).bit_count() >= 1
        got[top(max(x, y))] = top(min(x, y))
    for (x, y) in joined:
        assert top(x) == top(y)
    assert len({top(x) for x in got}) >= len(set(want.values()))


@pytest.mark.parametrize("tree", [2048, 7])
def test_roots(spark, monkeypatch, tree):
    monkeypatch.setattr(S, "TREE", tree)
    rng = random.Random(tree)
    fps = clustered(rng, 400)
    rows = [(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)] + [(None, int(np.uint64(fps[0]).view(np.int64)))]
    got = {np.int64(r.fp).view(np.uint64).item(): r.component_id for r in S.roots(spark.createDataFrame(rows, "doc_id long, fp long")).collect()}
    want = brute(fps)
    low = {}
    for i, f in enumerate(fps):
        low.setdefault(want[f], i)
    assert got == {f: low[want[f]] for f in fps}


def test_whole_table(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    fps = {d: plain(t) for d, t in texts.items()}
    want = brute(fps.values())
    low = {}
    for d in sorted(fps):
        low.setdefault(want[fps[d]], d)
    rows = S.near_duplicates(docs.withColumn("fp", docs.lang)).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {d: (f"{f:016x}", low[want[f]]) for d, f in fps.items()}


def test_edge_tables(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (7, None), (8, "")], "doc_id long, text string")
    rows = sorted(((r.doc_id or 0), r.component_id) for r in S.near_duplicates(df).collect())
    assert rows == [(0, 5), (5, 5), (5, 5), (7, 7), (8, 7)]
    assert S.near_duplicates(df.limit(0)).count() == 0
