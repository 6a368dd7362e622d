"""Importance resampling against a plain version: split words, joined n-grams, one sort."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm.queries import op12_resampling
from quillspark.llm.resampling import collapsed, drawn, importance_resample, spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def grams(text, n=2):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [" ".join(w[i : i + k]) for i in range(len(w)) for k in range(1, n + 1) if i + k <= len(w)]


def plain(docs, target, n=2, buckets=10_000, least=20, percent=25, seed=7):
    bucket = lambda g: crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for x in texts for g in grams(x, n)[1]) for texts in ([x for _, x in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for i, x in docs:
        w, g = grams(x, n)
        weight = sum(gain[bucket(k)] for k in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(w), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    may = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[5] = k + 1
    return sorted((tuple(r) for r in out), key=str)


@given(st.text(st.sampled_from("aB9 .-\té Ꙁ\x7f\x00"), max_size=30), st.integers(1, 4))
@settings(max_examples=300, deadline=None)
def test_spans_are_all_ngrams(text, n):
    raw = collapsed(text)
    assert [raw[a:b].decode() for a, b in spans(text, n)] == grams(text, n)[1]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_brute_force(spark, sf):
    path = f"/root/testdata/{sf}"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{path}/benchmark.parquet").select("text").collect()]
    want = sorted(((*r[:1], *r[2:]) for r in plain(docs, target)), key=str)
    got = op12_resampling(spark, path)
    assert [t for _, t in got.dtypes] == ["bigint"] * 5
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_edges(spark):
    schema = "doc_id long, text string, score string, `rank` int, s int"
    docs = [(1, None), (2, ""), (3, "--"), (None, "a b " * 20), (None, "a b " * 20), (4, "a b " * 20), (4, "a b " * 20), (5, "q " * 200_000), (6, "x y z " * 10), (7, "one")]
    df, goal = spark.createDataFrame([(*d, "k", 3, 4) for d in docs], schema), spark.createDataFrame([("a b c",), (None,)], "text string")
    for options in ({}, {"percent": 60}, {"percent": 100, "n": 3, "buckets": 50, "least": 0, "seed": 8}, {"n": 1}):
        names = {k if k != "least" else "least_words": v for k, v in options.items()}
        assert sorted((tuple(r) for r in importance_resample(df, goal, **names).collect()), key=str) == plain(docs, ["a b c", None], **options)
    none = spark.createDataFrame([], schema)
    assert importance_resample(none, goal).count() == 0
    assert sorted((tuple(r) for r in importance_resample(df, none).collect()), key=str) == plain(docs, [])
    with pytest.raises(ValueError):
        importance_resample(df, goal, buckets=1 << 17)


def test_drawn_documents(spark, sf_small):
    docs, goal = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "benchmark"))
    ranked = importance_resample(docs, goal)
    out = drawn(docs, ranked)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in ranked.where("rank is not null").collect()}
