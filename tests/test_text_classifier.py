"""The fitted text classifier against plain numpy, on held-out rows and on edge cases."""

import hashlib
import random

import numpy as np
import pytest

from quillspark.operators import text_classifier as T

FILLER = "the page was moved and then some of its lines were changed by another user after a long talk about it".split()


def plain_buckets(text, n):
    w = [x for x in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % n for g in w + [f"{a} {b}" for a, b in zip(w, w[1:])]}


def plain_fit(rows, n, steps):
    """Weights by class and bucket, the constant last."""
    names = sorted({y for _, y in rows if y is not None})
    x = np.zeros((len(rows), n + 1))
    for i, (text, _) in enumerate(rows):
        ks = plain_buckets(text, n)
        x[i, list(ks)] = 1 / np.sqrt(max(1, len(ks)))
        x[i, n] = 1
    y = np.array([[float(lab == c) for c in names] for _, lab in rows])
    keep = y.sum(axis=1) > 0
    x, y = x[keep], y[keep]
    w = v = np.zeros((len(names), n + 1))
    for step in range(steps):
        e = np.exp(x @ v.T)
        new = v + T.RATE * ((y - e / e.sum(axis=1, keepdims=True)).T @ x / len(x) - T.DECAY * v)
        v, w = new + step / (step + 3) * (new - w), new
    return names, w


def made_up(n, seed):
    r, rows = random.Random(seed), []
    for _ in range(n):
        words, bad = r.choices(FILLER, k=r.randint(8, 30)), r.random() < 0.4
        if bad:
            words.insert(r.randrange(len(words)), r.choice(["Idiot", "loser you", "trash\nTALK"]))
        rows.append((" ".join(words), "1" if bad else "0"))
    return rows


def test_equals_plain_fit(spark):
    rows = made_up(60, 1) + [("", "0"), (None, "1"), ("unlabelled words", None), ("ÄÖ Çé\tx", "2"), ("ÄÖ Çé\tx", "2")]
    got = T.fit_text_classifier(spark.createDataFrame(rows, "text string, label string").repartition(3), n_buckets=64, steps=7).collect()
    names, w = plain_fit(rows, 64, 7)
    assert {(r["class"], r.bucket) for r in got} == {(c, k) for c in names for k in range(-1, 64)}
    for r in got:
        assert r.weight == pytest.approx(w[names.index(r["class"]), r.bucket], abs=1e-9)


def test_held_out_and_columns(spark):
    weights = T.fit_text_classifier(spark.createDataFrame(made_up(300, 2), "text string, label string"))
    held = [(i, t, y, "kept") for i, (t, y) in enumerate(made_up(200, 3))]
    out = T.score_with(spark.createDataFrame(held, "p long, text string, k string, row string"), weights)
    assert out.columns == ["p", "text", "k", "row", "scores"]
    scored = out.collect()
    assert all(r.scores["0"] + r.scores["1"] == pytest.approx(1) and r.row == "kept" for r in scored)
    good, bad = ([r.scores["1"] for r in scored if r.k == y] for y in "01")
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert auc > 0.95, auc


def test_edges(spark):
    empty = spark.createDataFrame([], "text string, label int")
    none = T.fit_text_classifier(empty)
    assert none.count() == 0
    texts = spark.createDataFrame([(1, None), (2, ""), (3, " \t\n"), (4, "word " * 50_000), (4, "word " * 50_000)], "id long, text string")
    assert [r.scores for r in T.score_with(texts, none).collect()] == [{}] * 5
    one = T.fit_text_classifier(spark.createDataFrame([("a b", 7), (None, 7), ("c", None)], "text string, label int"), steps=2)
    assert {r.scores["7"] for r in T.score_with(texts, one).collect()} == {1.0}
    two = T.fit_text_classifier(spark.createDataFrame([("word", 1), ("a", 0), ("b", 0)], "text string, label int"), steps=5)
    got = T.score_with(texts.repartition(2), two).orderBy("id").collect()
    assert got[0].scores == got[1].scores == got[2].scores and got[3].scores == got[4].scores
    assert got[3].scores["1"] > got[0].scores["1"]
    assert T.score_with(texts.limit(0), two).count() == 0
    with pytest.raises(ValueError, match="classes"):
        T.fit_text_classifier(spark.createDataFrame([("a", i) for i in range(T.CLASSES + 1)], "text string, label int"))
