"""Katz scores against a plain model kept in dictionaries."""

import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import katz as K
from quillspark.llm.common import remainder


def tokens(text):
    return (text or "").encode().lower().split() + [b" end"]


def good_turing(n, k):
    """Katz (1987): d_r = (r* / r - A) / (1 - A) with r* = (r + 1) n_(r+1) / n_r and A = (k + 1) n_(k+1) / n_1, for r up to k; the
    largest k for which all of them are proper discounts."""
    for top in range(k, 0, -1):
        if any(n.get(r, 0) == 0 for r in range(1, top + 2)) or (a := Fraction((top + 1) * n[top + 1], n[1])) >= 1:
            continue
        d = {r: (Fraction((r + 1) * n[r + 1], n[r]) / r - a) / (1 - a) for r in range(1, top + 1)}
        if all(0 < x <= 1 for x in d.values()):
            return d
    return {}


@pytest.mark.parametrize("seen", [[100, 40, 20, 12, 8, 5], [100, 40, 20, 12, 8, 50], [10, 10, 10, 10, 10, 10], [50, 10, 0, 3, 2, 1], [900, 300, 120, 70, 50, 1], [0] * 6, [7], [1, 1]])
def test_good_turing(seen):
    want = good_turing(dict(enumerate(seen, 1)), K.K)
    assert K.discounts(seen).tolist() == pytest.approx([1, *(float(want.get(r, 1)) for r in range(1, K.K + 1))])


class Plain:
    def __init__(self, texts):
        self.c, self.cc, self.of = Counter(), Counter(), defaultdict(Counter)
        for t in texts:
            h = b" start"
            for w in tokens(t):
                self.c[w] += 1
                self.cc[h, w] += 1
                self.of[h][w] += 1
                h = w
        own = lambda c: (lambda d: [float(d.get(r, 1)) for r in range(K.K + 1)])(good_turing(Counter(c.values()), K.K))
        self.d1, self.d2, self.n = own(self.c), own(self.cc), sum(self.c.values())

    def word(self, w):
        f = lambda c: (self.d1[c] if c <= K.K else 1) * c / (self.n + 1)
        return f(self.c[w]) if self.c[w] else 1 - sum(map(f, self.c.values()))

    def pair(self, h, w):
        total = sum(self.of[h].values()) if h in self.of else 0
        f = lambda c: (self.d2[c] if c <= K.K else 1) * c / (total + 1)
        if total and self.of[h][w]:
            return f(self.of[h][w])
        if not total:
            return self.word(w)
        seen = [x for x, c in self.of[h].items() if c]
        return (1 - sum(f(self.of[h][x]) for x in seen)) / (1 - sum(map(self.word, seen))) * self.word(w)

    def score(self, text):
        h, out = b" start", 0.0
        for w in tokens(text):
            out += math.log10(self.pair(h, w))
            h = w
        return out

    def base(self, text):
        return sum(math.log10((self.c[w] + 0.1) / (self.n + 0.1 * (len(self.c) + 1))) for w in tokens(text))


@pytest.mark.parametrize("sizes", [(K.BLOCK, K.BUCKET), (300, 700)])
def test_scores(spark, sizes):
    rng = random.Random(8)
    vocab = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    rows += [(200, None), (201, ""), (None, "W1 w2"), (3, rows[3][1]), (202, "new words only here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held", remainder("doc_id", 10) == 0).repartition(3)
    flags = {r.doc_id: r.held for r in df.collect()}
    model = Plain([t for d, t in rows if not flags[d]])
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.base_score, r.score) for r in K.score_texts(df, F.col("held"), block=sizes[0], bucket=sizes[1]).collect())
    want = sorted((d if d is not None else -1, len(tokens(t)), sum(model.c[w] > 0 for w in tokens(t)), model.base(t), model.score(t)) for d, t in rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3:] for g in got], [w[3:] for w in want], rtol=1e-9)


def test_distributions_sum_to_one():
    rng = random.Random(1)
    model = Plain([" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 20))) for _ in range(30)])
    types = [*model.c, b"never"]
    assert abs(sum(map(model.word, types)) - 1) < 1e-12
    for h in [*model.of, b"never"]:
        assert abs(sum(model.pair(h, w) for w in types) - 1) < 1e-12


def test_held_out_beats_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = K.score_texts(docs, remainder("doc_id", 10) == 0).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edge_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert K.score_texts(df.limit(0), F.lit(False)).count() == 0
    assert {r.score for r in K.score_texts(df, F.lit(True)).collect()} == {0.0}


def test_discounts():
    assert (K.discounts([0] * 6) == 1).all() and (K.discounts([10, 20, 30, 40, 50, 60]) == 1).all()
    d = K.discounts([1000, 300, 150, 90, 60, 40])
    assert ((d[1:] > 0) & (d[1:] < 1)).all()
