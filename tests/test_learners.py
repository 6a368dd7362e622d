"""Learners that fit all splits together, against plain fits of each split alone."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import logit as L
from quillspark.operators import modeling as B
from quillspark.operators import trees as T

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def splits(spark):
    rng, rows = random.Random(3), []
    for i in range(240):
        a, b, c = rng.gauss(0, 1), rng.choice([1.0, 2.0, 5.0, None]), rng.randint(-40, 900) * 1.0
        y = int(rng.random() < 1 / (1 + math.exp(-(a + (b or 2) / 2 - c / 400))))
        rows += [(f, i % 4 == f, i, y, a, b, c) for f in range(3)]
    return spark.createDataFrame(rows, "fold int, is_test boolean, id long, y int, a double, b double, c double").cache()


def plain_data(splits, fold):
    rows = [r for r in splits.collect() if r.fold == fold]
    train = [r for r in rows if not r.is_test]
    mean = [np.mean([r[f] for r in train if r[f] is not None]) for f in FEATURES]
    fill = lambda r: [m if r[f] is None else r[f] for f, m in zip(FEATURES, mean)]
    return rows, train, fill


def test_newton_steps_of_all_splits(splits):
    fits = L.fit_splits(splits, FEATURES, steps=25)
    p = {(r.fold, r.id): r.p for r in L.with_z(splits, FEATURES, fits).collect()}
    for fold, fit in fits.items():
        rows, train, fill = plain_data(splits, fold)
        x = np.array([fill(r) for r in train])
        known = [[r[f] for r in train if r[f] is not None] for f in FEATURES]
        centre, spread = np.array([np.mean(k) for k in known]), np.array([np.std(k) for k in known])
        z, y, w = np.c_[np.ones(len(x)), (x - centre) / spread], np.array([r.y for r in train]), np.zeros(4)
        pen = np.array([0, 1, 1, 1.0])
        for _ in range(3000):  # plain gradient steps
            w += 0.02 * (z.T @ (y - 1 / (1 + np.exp(-z @ w))) - pen * w) / 2
        assert fit.weights == pytest.approx(w, abs=1e-4)
        for r in rows[::7]:
            own = np.append(1, (np.array(fill(r)) - centre) / spread)
            assert p[fold, r.id] == pytest.approx(1 / (1 + math.exp(-own @ fit.weights)), abs=1e-9)


def test_standard_errors(spark):
    """One binary feature: the log odds ratio, and the root of the summed inverse counts."""
    cells = {(0, 0): 30, (0, 1): 12, (1, 0): 9, (1, 1): 25}
    rows = [(x * 4.0, y) for (x, y), n in cells.items() for _ in range(n)]
    [r] = B.univariate_logit(spark.createDataFrame([(*r, 1.0) for r in rows], "x double, y int, same double"), ["x", "same"]).collect()
    odds = math.log(cells[1, 1] * cells[0, 0] / cells[1, 0] / cells[0, 1])
    assert (r.feature, r.coefficient) == ("x", pytest.approx(odds / 4, rel=1e-4))
    assert r.p_value == pytest.approx(math.erfc(odds / math.sqrt(sum(1 / n for n in cells.values())) / math.sqrt(2)), rel=1e-3)


def bins_of(x, column):
    low, high = math.asinh(min(column)), math.asinh(max(column))
    return max(0, min(T.BINS - 1, math.floor((math.asinh(x) - low) / (high - low) * T.BINS)))


def plain_tree(rows, fits, value, score, depth, node=1, allowed=None):
    """rows: (bins, ...); a nested tree by trying all cuts."""
    best = (1e-9, None, None)
    if depth:
        for j in range(3) if allowed is None else allowed(node):
            for cut in sorted({r[0][j] for r in rows}):
                left, right = [r for r in rows if r[0][j] <= cut], [r for r in rows if r[0][j] > cut]
                if left and right and score(left) + score(right) - score(rows) > best[0]:
                    best = (score(left) + score(right) - score(rows), j, cut)
    if best[1] is None:
        return value(rows)
    j, cut = best[1:]
    sides = [[r for r in rows if (r[0][j] > cut) == side] for side in (False, True)]
    return (j, cut, *(plain_tree(s, fits, value, score, depth - 1, 2 * node + k, allowed) for k, s in enumerate(sides)))


def walk(tree, bins):
    while isinstance(tree, tuple):
        tree = tree[3 if bins[tree[0]] > tree[1] else 2]
    return tree


def test_boosting(splits):
    how = T.Boosted(trees=6, block=2)
    nodes = T.grow_splits(splits, FEATURES, how)
    got = {(r.fold, r.id): r.p for r in T.tree_scores(splits, FEATURES, nodes).collect()}
    all_rows = splits.collect()
    columns = [[r[f] for r in all_rows if r[f] is not None] for f in FEATURES]
    for fold in range(3):
        rows, train, fill = plain_data(splits, fold)
        bins = {r.id: [bins_of(x, c) for x, c in zip(fill(r), columns)] for r in rows}
        total = {r.id: 0 for r in rows}
        for _ in range(how.trees):
            own = []
            for r in train:
                p = 1 / (1 + math.exp(-total[r.id] / T.ONE))
                own.append((bins[r.id], round((r.y - p) * T.ONE), round(p * (1 - p) * T.ONE)))
            g, h = lambda s: sum(r[1] for r in s), lambda s: sum(r[2] for r in s) + how.ridge * T.ONE
            tree = plain_tree(own, None, lambda s: round(how.rate * T.ONE * g(s) / h(s)), lambda s: g(s) ** 2 / h(s), how.depth)
            for r in rows:
                total[r.id] += walk(tree, bins[r.id])
        for r in rows:
            assert got[fold, r.id] == pytest.approx(1 / (1 + math.exp(-total[r.id] / T.ONE)), abs=1e-6)


def test_forest_and_its_node_table(spark, splits, monkeypatch):
    monkeypatch.setattr(T, "CELLS", 3000)  # trees in several parts
    how = T.Bagged(trees=7, depth=3)
    nodes = T.grow_splits(splits, FEATURES, how)
    got = {(r.fold, r.id): r.p for r in T.tree_scores(splits, FEATURES, nodes).collect()}
    columns = [[r[f] for r in splits.collect() if r[f] is not None] for f in FEATURES]
    table = {}
    for r in nodes.table(spark).collect():
        table[r.fold, r.tree, r.node] = r
    for fold in range(3):
        rows, train, fill = plain_data(splits, fold)
        bins = {r.id: [bins_of(x, c) for x, c in zip(fill(r), columns)] for r in rows}
        out = {r.id: 0.0 for r in rows}
        for t in range(how.trees):
            n = T.draws(np.array([r.id for r in train]), t)
            own = [(bins[r.id], r.y, int(k)) for r, k in zip(train, n) if k]
            g, h = lambda s: sum(r[1] * r[2] for r in s), lambda s: sum(r[2] for r in s)
            tree = plain_tree(own, None, lambda s: g(s) / h(s), lambda s: g(s) ** 2 / h(s), how.depth, allowed=lambda node, t=t: T.allowed(t, node, 3))
            for r in rows:
                out[r.id] += walk(tree, bins[r.id]) / how.trees
                at = table[fold, t, 1]  # the stored table's thresholds are in the features' own units
                while at.feature is not None:
                    at = table[fold, t, at.right if fill(r)[FEATURES.index(at.feature)] > at.threshold else at.left]
                assert at.value == pytest.approx(walk(tree, bins[r.id]))
        for r in rows:
            assert got[fold, r.id] == pytest.approx(out[r.id])
    draws = T.draws(np.arange(200_000), 5)
    assert abs(draws.mean() - 1) < 0.02 and abs(draws.var() - 1) < 0.03
    share = dict(T.importances(nodes, FEATURES))
    assert sum(share.values()) == pytest.approx(3)
    gains = nodes.table(spark).where("feature is not null").groupBy("fold", "feature").agg(F.sum("gain").alias("g")).collect()
    per = {f: sum(r.g for r in gains if r.fold == f) for f in range(3)}
    assert share == pytest.approx({f: sum(r.g / per[r.fold] for r in gains if r.feature == f) for f in FEATURES})


def test_learners_on_odd_splits(spark, splits):
    """A split with one class, one without test rows, none at all, a feature of nulls, equal rows."""
    odd = splits.where("fold = 0 or (fold = 1 and y = 1) or (fold = 2 and not is_test)").withColumn("b", F.lit(None).cast("double")).withColumn("c", F.lit(3.0))
    for learner, trees in (("lr", 1), ("gbt", 3), ("rf", 3)):
        measures, predictions, weights = B.run_splits(odd, FEATURES, learner=learner, trees=trees)
        assert {r.fold for r in predictions.collect()} == {0, 1} and weights.count() == 3
        assert all(0 <= r.p <= 1 for r in predictions.collect())
        assert all(abs(r.importance) < 1e-6 for r in weights.where("feature <> 'a'").collect())
        assert B.run_splits(odd.limit(0), FEATURES, learner=learner, trees=trees)[1].count() == 0
        assert measures.where("measure = 'auc' and fold = 0").first().value > 0.5
