"""Tree ensembles of many splits at once: boosted trees and random forests.

Features are put into BINS bins of equal width on the asinh scale between their least and largest value. A level of a tree
needs, for every node, feature and bin, sums over the training rows; tasks add them up in arrays and Spark adds the
tasks' arrays. One grouped pass so serves a level of one boosted tree in all splits, or of all trees of a forest in all splits
(in parts of CELLS cells), and 100 replicates cost as many passes as one. Only these sums come to the driver, which
chooses the splits. Sums are of whole numbers (gradients in units of 1 / ONE), so they don't depend on the order of rows.

The trees are a table of nodes: fold, tree, node (root 1, children 2n and 2n + 1), feature (-1: leaf), bin, value, gain.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS, ONE, CELLS = 64, 1 << 20, 1 << 21
PART = 1 << 15  # training rows of a task
M31 = (1 << 31) - 1
#: Cumulated Poisson(1) probabilities of 0 .. 6 draws
DRAWS = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(7)]


@dataclass
class Boosted:
    """Second-order boosting of the logistic loss."""

    trees: int = 100
    depth: int = 3
    rate: float = 0.1
    ridge: float = 1.0
    block: int = 20  # trees after which the rows' scores are kept


@dataclass
class Bagged:
    """A random forest: trees of rows drawn with replacement (Poisson counts by a hash of id and tree), each node on a share of
    the features chosen by a hash; a leaf holds the share of class 1."""

    trees: int = 100
    depth: int = 5


@dataclass
class Nodes:
    """The node table as arrays (folds, trees, 2 ** (depth + 1)), with the bins that the features were put into."""

    how: Boosted | Bagged
    folds: list[int]
    low: list[float]
    high: list[float]
    means: dict[int, list[float]]
    features: list[str]
    feature: np.ndarray = field(init=False)
    cut: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)
    gain: np.ndarray = field(init=False)

    def __post_init__(self):
        shape = len(self.folds), self.how.trees, 2 << self.how.depth
        self.feature, self.cut = np.full(shape, -1, np.int16), np.zeros(shape, np.int16)
        self.value, self.gain = np.zeros(shape), np.zeros(shape)

    def leaves(self, fold: np.ndarray, tree: int | np.ndarray, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after so many levels; a row stays in a leaf."""
        node, at = np.ones(len(fold), np.int64), np.arange(len(fold))
        for _ in range(levels):
            f = self.feature[fold, tree, node]
            node = np.where(f < 0, node, 2 * node + (bins[at, np.maximum(f, 0)] > self.cut[fold, tree, node]))
        return node

    def table(self, spark) -> DataFrame:
        """fold, tree, node, feature, threshold (left: not above it), left, right, value, gain."""
        rows = []
        used = {1} | {c for n in range(1, 1 << self.how.depth) for c in (2 * n, 2 * n + 1)}
        for i, fold in enumerate(self.folds):
            for t in range(self.how.trees):
                alive = {1}
                for n in sorted(used):
                    if n not in alive:
                        continue
                    f = int(self.feature[i, t, n])
                    edge = self.low[f] + (int(self.cut[i, t, n]) + 1) / BINS * (self.high[f] - self.low[f]) if f >= 0 else None
                    alive |= {2 * n, 2 * n + 1} if f >= 0 else set()
                    rows.append((fold, t, n, self.features[f] if f >= 0 else None, math.sinh(edge) if f >= 0 else None, *((2 * n, 2 * n + 1) if f >= 0 else (None, None)), float(self.value[i, t, n]), float(self.gain[i, t, n])))
        return spark.createDataFrame(rows, "fold int, tree int, node int, feature string, threshold double, left int, right int, value double, gain double")


def draws(ids: np.ndarray, tree: int) -> np.ndarray:
    """How often each id is drawn for a tree."""
    x = ((ids % M31) * 48271 + tree * 69621 + 12345) % M31
    for _ in range(2):
        x = (x * x + (tree + 1) * 16807 + ids % 8191) % M31
    return np.searchsorted(np.array(DRAWS), x / M31, side="right")


def allowed(tree: int, node: int, d: int) -> list[int]:
    """The features that a node of a forest may split: the square root of their number, by a hash."""
    m = math.ceil(math.sqrt(d))
    return sorted(sorted(range(d), key=lambda f: hashlib.md5(f"{tree}|{node}|{f}".encode()).hexdigest())[:m])


def binned(rows: DataFrame, features: list[str], nodes: Nodes) -> DataFrame:
    """fold, i (number of the fold), is_test, id, y, b0 .. b<d-1>: rows with the bins of their features, missing values at the mean of the
    fold's training rows. Rows of folds without training rows are left out."""
    spark = rows.sparkSession
    state = [(k, i, nodes.means[k]) for i, k in enumerate(nodes.folds)]
    sent = spark.createDataFrame(state, "__fold int, i int, means array<double>")
    joined = rows.join(F.broadcast(sent), F.col("fold") == F.col("__fold"))
    bins = []
    for j, f in enumerate(features):
        low, wide = nodes.low[j], nodes.high[j] - nodes.low[j]
        x = F.asinh(F.coalesce(F.col(f"`{f}`").cast("double"), F.get("means", F.lit(j)), F.lit(0.0)))
        at = F.floor((x - low) / wide * BINS) if wide > 0 else F.lit(0)
        bins.append(F.greatest(F.lit(0), F.least(F.lit(BINS - 1), at)).cast("short").alias(f"b{j}"))
    return joined.select("fold", "i", "is_test", F.col("id").cast("long").alias("id"), F.col("y").cast("int").alias("y"), *bins)


def columns(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    fold, ids, y = (batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in ("i", "id", "y"))
    return fold.astype(np.int64), ids.astype(np.int64), y.astype(np.float64), np.stack([batch.column(batch.schema.names.index(f"b{j}")).to_numpy() for j in range(d)], axis=1).astype(np.int64)


def scores(nodes: Nodes, fold: np.ndarray, bins: np.ndarray, first: int, last: int) -> np.ndarray:
    """Summed leaf values of trees first .. last - 1."""
    out = np.zeros(len(fold))
    for t in range(first, last):
        out += nodes.value[fold, t, nodes.leaves(fold, t, bins, nodes.how.depth)]
    return out


def level_sums(rows: DataFrame, nodes: Nodes, trees: range, level: int, first: int) -> dict[str, np.ndarray]:
    """g, h and n of training rows as arrays (folds, trees, nodes of the level, features, bins). rows have the column `base`, the
    summed values of boosted trees before `first`."""
    d, wide = len(nodes.features), 1 << level
    shape = len(nodes.folds), len(trees), wide, d, BINS
    cells = math.prod(shape)
    sent, boosted = rows.sparkSession.sparkContext.broadcast(nodes), isinstance(nodes.how, Boosted)

    def run(batches):
        nodes = sent.value
        own_cells = cells // len(trees)
        sums = np.zeros((3, len(trees), own_cells), np.int64)  # tree by tree, so that a tree's counts are as small as its own cells
        for b in batches:
            fold, ids, y, bins = columns(b, d)
            own, each = np.unique(ids, return_inverse=True)  # an id is drawn alike in all folds
            for k, t in enumerate(trees):
                if boosted:
                    base = b.column(b.schema.names.index("base")).to_numpy()
                    p = 1 / (1 + np.exp(-(base + scores(nodes, fold, bins, first, t)) / ONE))
                    kept, weights = np.arange(len(y)), (np.rint((y - p) * ONE), np.rint(p * (1 - p) * ONE), np.ones(len(y)))
                else:
                    n = draws(own, t)[each].astype(np.float64)
                    kept = np.flatnonzero(n)
                    weights = n * y, n
                node = nodes.leaves(fold[kept], t, bins[kept], level)
                kept, node = kept[node >= wide], node[node >= wide]  # rows of leaves further up take no part
                at, some = (fold[kept] * wide + node - wide) * d, [w[kept] for w in weights]
                for j in range(d):
                    cell = (at + j) * BINS + bins[kept, j]
                    got = [np.bincount(cell, w, own_cells).astype(np.int64) for w in some]  # whole numbers below 2**53: exact
                    for row, x in zip(sums, got if boosted else (*got, got[1]), strict=True):
                        row[k] += x
        sums = sums.reshape(3, len(trees), len(nodes.folds), -1).swapaxes(1, 2).reshape(3, -1)
        at = np.flatnonzero(sums[2])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(s[at]) for s in sums)], ["cell", "g", "h", "n"])

    got = rows.where("not is_test").mapInArrow(run, "cell long, g long, h long, n long").groupBy("cell").agg(*(F.sum(c).alias(c) for c in "ghn")).toPandas()
    out = {}
    for c in "ghn":
        out[c] = np.zeros(cells, np.int64)
        out[c][got["cell"].to_numpy(np.int64)] = got[c].to_numpy(np.int64)
        out[c] = out[c].reshape(shape)
    return out


def choose(nodes: Nodes, sums: dict[str, np.ndarray], trees: range, level: int) -> None:
    """Set the splits of a level and the values of its nodes and their children. The best gain wins, then the first feature, then the first bin."""
    d, wide, boosted = len(nodes.features), 1 << level, isinstance(nodes.how, Boosted)
    ridge = nodes.how.ridge * ONE if boosted else 0.0
    left = {c: np.cumsum(sums[c], axis=-1).astype(np.float64) for c in "ghn"}
    whole = {c: left[c][..., :1, -1:] for c in "ghn"}  # the same for every feature
    right = {c: whole[c] - left[c] for c in "ghn"}

    def part(g, h):
        return np.divide(g * g, h + ridge, out=np.zeros_like(g), where=h + ridge > 0)

    gain = part(left["g"], left["h"]) + part(right["g"], right["h"]) - part(whole["g"], whole["h"])
    gain[(left["n"] < 1) | (right["n"] < 1)] = -1.0
    if not boosted:
        for k, t in enumerate(trees):
            for n in range(wide):
                gain[:, k, n, [f for f in range(d) if f not in allowed(t, wide + n, d)]] = -1.0
    flat = gain.reshape(*gain.shape[:3], -1)
    best = flat.argmax(-1)
    top = np.take_along_axis(flat, best[..., None], -1)[..., 0]
    span, here = slice(trees.start, trees.stop), slice(wide, 2 * wide)
    split = top > 1e-9
    nodes.feature[:, span, here] = np.where(split, best // BINS, -1)
    nodes.cut[:, span, here] = np.where(split, best % BINS, 0)
    nodes.gain[:, span, here] = np.where(split, top, 0.0)

    def values(g, h):
        v = np.divide(g, h + ridge, out=np.zeros_like(g), where=h + ridge > 0)
        return np.rint(nodes.how.rate * ONE * v) if boosted else v

    if level == 0:
        nodes.value[:, span, 1] = values(whole["g"], whole["h"])[:, :, 0, 0, 0]
    for side, sums_ in ((0, left), (1, right)):
        g, h = (np.take_along_axis(sums_[c].reshape(*flat.shape), best[..., None], -1)[..., 0] for c in "gh")
        nodes.value[:, span, 2 * wide + side : 4 * wide : 2] = np.where(split, values(g, h), 0.0)


def grow_splits(splits: DataFrame, features: list[str], how: Boosted | Bagged) -> Nodes:
    """Trees of every fold that has training rows. splits: fold, is_test, id (a whole number), y and the features."""
    train = splits.where("not is_test and y is not null")
    ends = splits.agg(*(f(F.col(f"`{c}`").cast("double")).alias(f"{n}{j}") for j, c in enumerate(features) for n, f in (("l", F.min), ("h", F.max)))).first()
    per = {r.fold: [r[f"m{j}"] for j in range(len(features))] for r in train.groupBy("fold").agg(*(F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{j}") for j, c in enumerate(features))).collect()}
    low, high = ([math.asinh(ends[f"{n}{j}"]) if ends[f"{n}{j}"] is not None else 0.0 for j in range(len(features))] for n in "lh")
    nodes = Nodes(how, sorted(per), low, high, per, list(features))
    if not per:
        return nodes
    n_rows = train.count()
    rows = binned(train, features, nodes).withColumn("base", F.lit(0.0)).coalesce(-(-n_rows // PART)).cache()  # small tables need no exchange of sums
    if isinstance(how, Boosted):
        first = 0
        for t in range(how.trees):
            if t - first == how.block:
                rows, old = with_base(rows, nodes, first, t).cache(), rows
                first = t
                rows.count()
                old.unpersist()
            for level in range(how.depth):
                choose(nodes, level_sums(rows, nodes, range(t, t + 1), level, first), range(t, t + 1), level)
    else:
        for level in range(how.depth):
            share = max(1, CELLS // (len(per) * (1 << level) * len(features) * BINS))
            for t in range(0, how.trees, share):
                some = range(t, min(how.trees, t + share))
                choose(nodes, level_sums(rows, nodes, some, level, 0), some, level)
    rows.unpersist()
    return nodes


def with_base(rows: DataFrame, nodes: Nodes, first: int, last: int) -> DataFrame:
    """rows with the values of trees first .. last - 1 added to `base`."""
    d, sent = len(nodes.features), rows.sparkSession.sparkContext.broadcast(nodes)

    def run(batches):
        for b in batches:
            fold, _, _, bins = columns(b, d)
            at = b.schema.names.index("base")
            base = b.column(at).to_numpy() + scores(sent.value, fold, bins, first, last)
            yield b.set_column(at, "base", pa.array(base))

    return rows.mapInArrow(run, rows.schema)


def tree_scores(splits: DataFrame, features: list[str], nodes: Nodes) -> DataFrame:
    """fold, is_test, id, y, p: the probability of class 1 by the row's fold's trees."""
    rows = binned(splits, features, nodes).withColumn("base", F.lit(0.0))
    total = with_base(rows, nodes, 0, nodes.how.trees)
    p = 1 / (1 + F.exp(-F.col("base") / ONE)) if isinstance(nodes.how, Boosted) else F.col("base") / nodes.how.trees
    return total.select("fold", "is_test", "id", "y", p.alias("p"))


def importances(nodes: Nodes, features: list[str]) -> list[tuple[str, float]]:
    """Each feature's share of a fold's gains, summed over the folds."""
    out = np.zeros(len(features))
    for i in range(len(nodes.folds)):
        per = np.array([nodes.gain[i][nodes.feature[i] == j].sum() for j in range(len(features))])
        out += per / per.sum() if per.sum() else 0
    return list(zip(features, out.tolist(), strict=True))
