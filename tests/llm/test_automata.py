"""Automata of one benchmark are never used for another."""

from quillspark.llm import common
from quillspark.llm import decontamination as D


def test_two_benchmarks_in_one_worker(spark, monkeypatch):
    monkeypatch.setattr(D, "id", lambda x: 7, raising=False)  # two broadcasts at one address
    docs = spark.createDataFrame([(1, "x alpha beta y"), (2, "x gamma delta y")], "doc_id long, text string").coalesce(1)
    for text, doc in [("alpha beta", 1), ("gamma delta", 2)] * 3:
        bench = spark.createDataFrame([(1, text)], "item_id long, text string")
        assert [r.doc_id for r in D.find_contamination(docs, bench).where("n_hit > 0").collect()] == [doc]


def test_old_automata_go(monkeypatch):
    monkeypatch.setattr(common, "_held", {})
    D.scanner(("a", 0), [("1", "x")], 10)
    D.scanner(("b", 0), [("1", "y")], 10)
    D.scanner(("b", 1), [("1", "z")], 10)
    assert sorted(common._held) == [("decontamination b", 0), ("decontamination b", 1)]


def test_many_benchmarks_in_one_session(spark):
    docs = spark.createDataFrame([(k, f"x w{k} v{k} y") for k in range(25)], "doc_id long, text string").coalesce(1).cache()
    for k in range(25):
        bench = spark.createDataFrame([(1, f"w{k} v{k}")], "item_id long, text string")
        assert [r.doc_id for r in D.find_contamination(docs, bench).where("n_hit > 0").collect()] == [k]


def test_words_never_run_together():
    """Numbers are read as two symbols; neither a low part and the next high part nor an unknown word makes a window."""
    s = D.Scanner([("1", " ".join(f"w{i}" for i in range(600)))], 3)
    w = [b"w%d" % i for i in range(600)]
    assert len(s(w)) == 598 and not s(w[::2]) and not s([x for y in w for x in (y, b"zz")])
    assert s([b"zz", *w[7:10], b"zz"]) == [(1, 3, "1")]
