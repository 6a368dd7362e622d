"""Near-duplicates of the pipeline against brute-force Jaccard."""

import random

import corpus_pipeline as C
import numpy as np
import pytest

from quillspark.llm import jaccard as J


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def brute(texts):
    """Smallest id of each component of pairs with Jaccard 0.8 or more."""
    ids, sets, top = sorted(texts), {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}
    holders = {}
    for d in ids:
        for s in sets[d]:
            holders.setdefault(s, []).append(d)

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for d in ids:
        for e in {e for s in sets[d] for e in holders[s] if e > d}:
            both = len(sets[d] & sets[e])
            if 5 * both >= 4 * (len(sets[d]) + len(sets[e]) - both):
                a, b = sorted((root(d), root(e)))
                top[b] = a
    return {root(d) for d in ids}


def copies(rng, n):
    """Families of edited copies, a line that most texts share, exact copies, empty texts."""
    line = " ".join(f"l{i}" for i in range(9))
    out = ["", None, " \n", "One", "one", "a b c d e", "A B c d\te f"]
    for _ in range(n):
        base = [rng.choice("abcdefgh") + str(rng.randrange(60)) for _ in range(rng.randint(8, 120))]
        for _ in range(rng.choice([1, 1, 2, 12])):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = str(rng.random())
            out.append(" ".join(w) + (" " + line if rng.random() < 0.7 else ""))
    return {i: t for i, t in enumerate(out)}


@pytest.mark.parametrize("common, block", [(16, 512), (2, 512), (16, 3)])
def test_keep_one(spark, monkeypatch, common, block):
    monkeypatch.setattr(J, "COMMON", common)
    monkeypatch.setattr(J, "BLOCK", block)  # clusters then meet in pairs of blocks
    texts = copies(random.Random(common), 40)
    df = spark.createDataFrame([*texts.items(), (None, texts[5])], "doc_id long, text string")
    got = [r.doc_id for r in J.keep_one(df).collect()]
    assert sorted(got) == sorted(brute(texts)) and len(got) < len(texts)
    assert J.keep_one(df.limit(0)).count() == 0


@pytest.mark.parametrize("mark, block", [(4, 512), (2, 3), (1, 2)])
def test_hot_shards(spark, monkeypatch, mark, block):
    """Common shingles beyond HEAVY: hot shards go through the second round, copies of one text through the meetings."""
    monkeypatch.setattr(J, "HEAVY", 1)
    monkeypatch.setattr(J, "MARK", mark)
    monkeypatch.setattr(J, "BLOCK", block)
    rng = random.Random(mark)
    texts = copies(rng, 25)
    passage, base = " ".join(f"p{i}" for i in range(30)), [f"b{i}" for i in range(80)]
    for i in range(60):
        texts[1000 + i] = passage + " " + " ".join(f"{i}x{j}" for j in range(60))  # share a passage only
        w = list(base)
        w[rng.randrange(80)] = str(i)
        texts[2000 + i] = " ".join(w)  # copies of one text
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(5)
    assert sorted(r.doc_id for r in J.keep_one(df).collect()) == sorted(brute(texts))


@pytest.mark.parametrize("seed", range(4))
def test_streamed_shards(seed):
    """Whatever the batches, each shard's links are those of the shard alone; a hot one is starred or named."""
    rng = np.random.default_rng(seed)
    h = np.sort(rng.integers(0, 30, 400)).astype(np.int64)
    t, n = rng.integers(0, 40, 400), np.full(400, 10, np.int32)
    order = np.lexsort((t, h))
    columns = [h[order], t[order], n, *(np.zeros(400, np.int64) for _ in range(J.WORDS))]
    want = {}
    for a, b in zip(h, t, strict=True):
        want.setdefault(int(a), set()).add(int(b))
    for star in (True, False):
        shards, pairs, hot, at = J.Shards(star, 12), set(), [], 0
        while at < 400:
            step = int(rng.integers(0, 60))
            a, b, c = shards.links([x[at : at + step] for x in columns])
            pairs |= set(zip(a.tolist(), b.tolist(), strict=True))
            hot += c.tolist()
            at += step
        a, b, c = shards.links([x[:0] for x in columns], last=True)
        pairs |= set(zip(a.tolist(), b.tolist(), strict=True))
        hot += c.tolist()
        large = sorted(k for k, v in want.items() if len(v) > 12)
        assert large and hot == ([] if star else large)
        joined = {k: v for k, v in want.items() if star or k not in large}
        top = {x: x for v in want.values() for x in v}
        for v in joined.values():
            low = min(top[x] for x in v)
            for x in [y for y in top if top[y] in {top[x] for x in v}]:
                top[x] = low
        of = {x: x for x in top}
        for a, b in pairs:
            low, high = sorted((of[a], of[b]))
            of = {x: low if y == high else y for x, y in of.items()}
        groups = lambda d: {frozenset(x for x in d if d[x] == r) for r in d.values()}
        assert groups(of) == groups(top)


def test_stage_reaches_similarity(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    kept = {r.doc_id for r in C.near_dedup(spark, docs, sf_small).collect()}
    assert kept == brute({r.doc_id: r.text for r in docs.collect()})


def test_shingles_are_op5s():
    import xxhash

    for n in (0, 1, 4, 5, 6, 40):
        w = [f"w{i % 7}".encode() for i in range(n)]
        want = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 5]), 42) for i in range(max(1, n - 4))]
        assert J.shingle_hashes(w, 5).tolist() == want


def test_long_texts_in_steps(monkeypatch):
    w = [str(i % 31).encode() for i in range(50)]
    for width in (1, 5):
        whole = J.shingle_hashes(w, width).tolist()
        for step in (1, 7, 46, 47, 50):
            monkeypatch.setattr(J, "STEP", step)
            assert J.shingle_hashes(w, width).tolist() == whole and len(whole) == 51 - width
        monkeypatch.undo()


@pytest.mark.parametrize("seed, lookups", [(0, 1 << 18), (1, 1 << 18), (2, 9), (3, 1)])
def test_shards_are_bk_trees(monkeypatch, seed, lookups):
    """Links come from searches of the shards' BK-trees and join the same texts as comparisons of all pairs."""
    monkeypatch.setattr(J, "LOOKUPS", lookups)
    found, search = [], J.BkForest.search
    monkeypatch.setattr(J.BkForest, "search", lambda *a: found.append(search(*a)) or found[-1])
    rng = np.random.default_rng(seed)
    h = np.repeat(np.arange(60), rng.integers(1, 40, 60))
    flips = np.packbits(rng.random((len(h), 256)) < 0.12, axis=1).view(np.uint64)
    base = rng.integers(0, 1 << 63, (9, J.WORDS)).astype(np.uint64)
    fp = base[rng.integers(0, 9, len(h))] ^ np.where(rng.random((len(h), 1)) < 0.3, 0, flips).astype(np.uint64)
    n = rng.integers(4, 60, len(h)).astype(np.int32)
    order = np.lexsort((n, h))
    h, n, fp = h[order], n[order], fp[order]
    top = np.arange(len(h))
    for i in range(len(h)):
        for j in range(i):
            away = sum(int(x).bit_count() for x in fp[i] ^ fp[j])
            if h[i] == h[j] and 5 * n[j] >= 4 * n[i] and (n[j] < J.SMALL or away <= J.RADIUS):
                low, high = sorted((top[i], top[j]))
                top[top == high] = low
    assert J.shard_forest(h, n, fp).tolist() == top.tolist() and found
    assert 60 < len(set(top.tolist())) < len(h)
