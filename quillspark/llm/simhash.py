"""SimHash fingerprints and near-duplicate components through sharded BK-trees.

Fingerprints: word shingles hashed with XXH64 (seed 42); a bit is set if it is set in over half the hashes.

Links (at most `radius` differing bits): the 64 bits are cut into blocks of which radius + k exist; two fingerprints
within the radius agree on at least k blocks. Each distinct fingerprint goes to one shard for every choice of k blocks,
keyed by their bits. Each shard holds BK-trees (children keyed by integer Hamming distance to the parent) of at most
about TREE fingerprints. A shard above that is first split by its remaining bits, cut into radius + 1 blocks, one of which
linked fingerprints share; what is still above it is dealt into several trees, and the members of each tree are looked up
in their own and in all later trees. The trees of a batch of shards are built and searched together with array steps; a
search follows only edges within the radius of the distance at hand. A batch gives a spanning forest of the links
that it found, so a shard of m fingerprints never gives more than m - 1 links. Components of all links are found by
alternating star contractions, each cut by a checkpoint in the shared folder.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, to_table

TREE = 2048
PAIRS = 1 << 22


def shingle_array(w: list[bytes], width: int) -> np.ndarray:
    """XXH64 (seed 42) of every word shingle, repeats included; of a shorter sequence the whole, of none the empty text."""
    joined = b" ".join(w)
    if len(w) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.append(0, ends[:-1] + 1)
    f = xxhash.xxh64_intdigest
    return np.array([f(joined[a:b], 42) for a, b in zip(starts[: len(w) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)


def bits_of(h: np.ndarray) -> int:
    """64 bits, each set if it is set in over half the hashes."""
    bits = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        bits += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    w = (text or "").encode().lower().split()
    return bits_of(shingle_array(w, width)) if w else 0


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and the columns `keep` of every whole text."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *keep)

    def run(batches):
        for b in slices(batches, 1, 1 << 22):
            fps = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), *b.columns[2:]], ["doc_id", "fp", *keep])

    types = "".join(f", {k} {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.mapInArrow(run, f"doc_id long, fp long{types}")


def block_plan(n: int, radius: int) -> list[list[tuple[int, int]]]:
    """For n distinct fingerprints: lists of (first bit, bits) that make up a shard's key; about 16 in a shard or fewer."""
    for k in range(1, 64 - radius):
        cuts = [64 * i // (radius + k) for i in range(radius + k + 1)]
        spans = [(a, b - a) for a, b in itertools.pairwise(cuts)]
        plan = [list(c) for c in itertools.combinations(spans, k)]
        if n <= 16 << min(sum(w for _, w in c) for c in plan) or k == 3:
            return plan
    raise ValueError(f"no plan for radius {radius}")


def rest_plan(spans: list[tuple[int, int]], radius: int) -> list[list[tuple[int, int]]]:
    """The bits outside `spans` as radius + 1 lists of (first bit, bits): fingerprints of one shard within the radius agree on one of them."""
    taken = {x for first, width in spans for x in range(first, first + width)}
    left = [x for x in range(64) if x not in taken]
    out = []
    for i in range(radius + 1):
        part = left[len(left) * i // (radius + 1) : len(left) * (i + 1) // (radius + 1)]
        runs: list[tuple[int, int]] = []
        for x in part:
            runs = [*runs[:-1], (runs[-1][0], runs[-1][1] + 1)] if runs and sum(runs[-1]) == x else [*runs, (x, 1)]
        out.append(runs)
    return out


def key_of(fp: str, i: int, spans: list[tuple[int, int]]) -> Column:
    key = F.lit(i).cast("long")
    for first, width in spans:
        key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
    return key


def shard_keys(fp: str, plan: list[list[tuple[int, int]]]) -> Column:
    """Array of (i, key), one for each choice of blocks."""
    return F.array(*(F.struct(F.lit(i).alias("i"), key_of(fp, i, c).alias("key")) for i, c in enumerate(plan)))


def popcount(x: np.ndarray) -> np.ndarray:
    """Bits set in each value; of rows of several words, in each row."""
    n = np.bitwise_count(x)
    return n.astype(np.int64) if n.ndim == 1 else n.sum(1, dtype=np.int64)


class BkForest:
    """BK-trees over many groups at once; a group's first value is its root. Values are words of 64 bits or rows of such words."""

    def __init__(self, values: np.ndarray, group: np.ndarray):
        self.values, self.base = values, 64 * (1 if values.ndim == 1 else values.shape[1]) + 1
        roots, first = np.unique(group, return_index=True)
        self.root = dict(zip(roots.tolist(), first.tolist(), strict=True))
        inside = np.ones(len(values), bool)
        inside[first] = False
        todo = np.flatnonzero(inside)
        at = first[np.searchsorted(roots, group[todo])]
        keys, child = [], []
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # nodes of each depth, their parents
        while len(todo):
            key = at * self.base + popcount(values[todo] ^ values[at])
            new, index, back = np.unique(key, return_index=True, return_inverse=True)
            keys.append(new)
            child.append(todo[index])
            self.levels.append((todo[index], at[index]))
            rest = np.ones(len(todo), bool)
            rest[index] = False
            at, todo = todo[index][back][rest], todo[rest]
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(self.keys)
        self.inner = np.zeros(len(values), bool)
        self.inner[self.keys // self.base] = True
        self.keys, self.child = self.keys[order], (np.concatenate(child) if child else np.zeros(0, np.int64))[order]

    def bounds(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least `low` and greatest `high` of the nodes from each node down."""
        low, high = low.copy(), high.copy()
        for node, parent in reversed(self.levels):
            np.minimum.at(low, parent, low[node])
            np.maximum.at(high, parent, high[node])
        return low, high

    def search(self, queries: np.ndarray, group: np.ndarray, radius: int | np.ndarray, follow: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs within the radius (one for all or one a query). `follow`, of queries and nodes, tells from which
        nodes down there is something to find."""
        q, at = np.arange(len(queries)), np.array([self.root[g] for g in group.tolist()], np.int64)
        hits_q, hits_n = [], []
        while len(q):
            if follow is not None:
                go = follow(q, at)
                q, at = q[go], at[go]
            d, r = popcount(queries[q] ^ self.values[at]), radius if isinstance(radius, int) else radius[q]
            near = d <= r
            hits_q.append(q[near])
            hits_n.append(at[near])
            inner = self.inner[at]
            q, at, d = q[inner], at[inner], d[inner]
            r = r if isinstance(radius, int) else r[inner]
            lo = np.searchsorted(self.keys, at * self.base + np.maximum(d - r, 0), "left")
            hi = np.searchsorted(self.keys, at * self.base + np.minimum(d + r, self.base - 1), "right")
            n = hi - lo
            q = np.repeat(q, n)
            at = self.child[np.repeat(lo, n) + np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)]
        return np.concatenate(hits_q or [q]), np.concatenate(hits_n or [q])


def forest_links(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For links a-b among n nodes, each node's smallest reachable node."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        open_ = label[a] != label[b]
        a, b = label[a][open_], label[b][open_]
    while True:
        nxt = label[label]
        if (nxt == label).all():
            return label
        label = nxt


def batch_links(trees: list[np.ndarray], queries: list[np.ndarray | None], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (value, value) of each row's tree values, and its query values (None: its tree's) against them."""
    out_a, out_b, row = [], [], 0
    while row < len(trees):
        stop, work = row, 0
        while stop < len(trees) and (stop == row or work < PAIRS):
            work += len(trees[stop]) * len(trees[stop] if queries[stop] is None else queries[stop])
            stop += 1
        values = np.concatenate(trees[row:stop])
        group = np.repeat(np.arange(row, stop), [len(t) for t in trees[row:stop]])
        asked = [t if q is None else q for t, q in zip(trees[row:stop], queries[row:stop], strict=True)]
        other = np.concatenate(asked)
        other_group = np.repeat(np.arange(row, stop), [len(x) for x in asked])
        forest = BkForest(values, group)
        # node numbers: tree values first, then query values; a query that is its own tree's value is the same node
        own = np.array([q is None for q in queries[row:stop]])[other_group - row]
        number = np.arange(len(other)) + len(values)
        number[own] = np.flatnonzero(np.array([q is None for q in queries[row:stop]])[group - row])
        q, node = forest.search(other, other_group, radius)
        q = number[q]
        both = np.concatenate([values, other])
        apart = q != node
        label = forest_links(q[apart], node[apart], len(both))
        linked = np.flatnonzero(label != np.arange(len(both)))
        out_a.append(both[linked])
        out_b.append(both[label[linked]])
        row = stop
    none = np.zeros(0, np.uint64)
    return np.concatenate(out_a or [none]), np.concatenate(out_b or [none])


def with_size(keyed: DataFrame, key: list[str]) -> DataFrame:
    """Rows of keys that have two or more, with their number n."""
    return keyed.join(keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), key)


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """a, b: links that connect all distinct fingerprints fp whose links connect them, and no others."""
    plan = block_plan(fps.count(), radius)
    keyed = with_size(fps.select("fp", F.explode(shard_keys("fp", plan)).alias("k")).select("fp", "k.i", "k.key"), ["i", "key"])
    deeper = F.array(F.lit(None).cast("long"))
    for i, spans in enumerate(plan):  # a shard above TREE is split by one of the remaining blocks of bits, on which links agree too
        parts = [key_of("fp", j, rest) for j, rest in enumerate(rest_plan(spans, radius))]
        deeper = F.when((F.col("n") > TREE) & (F.col("i") == i), F.array(*parts)).otherwise(deeper)
    split = keyed.select("fp", "i", "key", F.explode(deeper).alias("sub")).withColumn("sub", F.coalesce("sub", F.lit(-1).cast("long")))
    dealt = with_size(split, ["i", "key", "sub"]).withColumn("trees", F.ceil(F.col("n") / TREE).cast("int"))
    dealt = dealt.withColumn("tree", F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int"))
    trees = dealt.groupBy("i", "key", "sub", "tree").agg(F.collect_list("fp").alias("fps"), F.first("trees").alias("trees"))
    trees = to_table(trees, "bk-trees")
    own = trees.select("fps", F.lit(None).cast("array<long>").alias("asked"))
    many = trees.where("trees > 1").select("i", "key", "sub", "fps", F.explode(F.expr("sequence(tree, trees - 1)")).alias("tree0"), "tree").where("tree0 > tree")
    later = trees.where("trees > 1").select("i", "key", "sub", F.col("tree").alias("tree0"), F.col("fps").alias("asked"))
    across = many.join(later, ["i", "key", "sub", "tree0"]).select("fps", "asked")

    def run(batches):
        as_list = lambda c: [None if x is None else np.array(x, np.int64).view(np.uint64) for x in c.to_pylist()]
        for b in batches:
            a, c = batch_links(as_list(b.column(0)), as_list(b.column(1)), radius)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c.view(np.int64))], ["a", "b"])

    return own.unionByName(across).mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) of all nodes in edges (a, b), by alternating large and small stars."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))).alias("e"))
        now = cut(small.select("e.*").where("a <> b").distinct())


def roots(prints: DataFrame, radius: int = 3) -> DataFrame:
    """fp, root, component_id (smallest id of a document in the component; null if all its ids are null)."""
    per = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    of = components(links(per.select("fp"), radius))
    rooted = per.join(of, per.fp == of.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    ids = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.select("fp", "root").join(ids, "root")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id of every document.

    Null, empty and blank texts have fingerprint zero and are linked like others. A text of fewer than `width` words
    is one shingle. Repeated rows and ids are kept; rows without id get a component through the others' ids. Other columns
    are ignored whatever their names; very long texts are read whole, one at a time; an empty table gives no rows.
    """
    prints = to_table(fingerprints(docs, doc_id=doc_id, text=text, width=width), "fingerprints")
    of = roots(prints, radius)
    out = prints.join(of, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
