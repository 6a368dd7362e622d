"""Decontamination against brute force over words."""

import hashlib
import re

import pytest

from quillspark.llm import decontamination as D

RE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return RE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, n=10):
    w, hit, who = low(text), set(), set()
    for item, t in items:
        x = low(t)
        wins = [x[i : i + n] for i in range(max(1, len(x) - n + 1))] if x else []
        for win in wins:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    who.add(item)
    return len(w), len(hit), sorted(str(i) for i in who if i is not None)


@pytest.mark.parametrize("shard", [1 << 20, 90])
def test_whole_table(spark, sf_small, shard):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    bench = spark.read.parquet(f"{sf_small}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = D.find_contamination(docs.withColumn("item_id", docs.lang), bench, shard=shard)
    got = {r.doc_id: r for r in D.digests(rows).collect()}
    some = 0
    for d, t in texts.items():
        n, h, who = brute(t, items)
        some += h > 0
        r = got[d]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, h, len(who), h > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(who).encode()).hexdigest()
    assert some
    for r in rows.where("n_hit > 0").collect():
        assert sum(len(low(r.text[s.start : s.end])) for s in r.spans) == r.n_hit


def test_edge_tables(spark):
    bench = spark.createDataFrame([(1, "Alpha-beta, gamma"), (2, None), (3, "..."), (None, "solo"), (4, "é a"), (1, "Alpha-beta, gamma")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x ALPHA beta\n gamma y alpha beta gamma"), (2, None), (3, "solo"), (4, "ÉÉ é—a"), (4, "é a"), (5, "alpha betagamma")], "doc_id long, text string")
    rows = [(r.doc_id, r.n_words, r.n_hit, r.item_ids, [(s.start, s.end) for s in r.spans]) for r in D.find_contamination(docs, bench).collect()]
    assert sorted(rows, key=str) == sorted(
        [(1, 8, 6, ["1"], [(2, 19), (22, 38)]), (2, 0, 0, [], []), (3, 1, 1, [], [(0, 4)]), (4, 2, 0, [], []), (4, 2, 2, ["4"], [(0, 3)]), (5, 2, 0, [], [])], key=str
    )
    assert D.find_contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert D.find_contamination(docs.limit(0), bench).count() == 0


def test_clashing_names_and_long_texts(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    long = "lorem " * 300_000 + "alpha beta gamma" + " ipsum" * 10
    docs = spark.createDataFrame([(1, long, 9, "k", "m")], "doc_id long, text string, n_hit int, Spans string, __text string")
    for shard in (1 << 20, 1):
        [r] = D.find_contamination(docs, bench, shard=shard).collect()
        assert (r.n_words, r.n_hit, r.spans[0].start, r["__text"]) == (300_013, 3, 1_800_000, "m")
        assert list(r.asDict()) == ["doc_id", "text", "__text", "n_words", "n_hit", "item_ids", "spans"]
