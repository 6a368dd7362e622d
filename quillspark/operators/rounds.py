"""Graph work of pages that are too large for one task: rounds of joins over the edges, partitioned by page and node.

No row holds more than a node, an edge or 64 sources. Every round is written as a checkpoint, so neither plans nor what a lost
executor costs grow with the rounds. Searches need as many rounds as the longest distance.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SOURCES = 1024  # sources of a page whose path counts are held at once


def kept(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder of spark.checkpoint.dir; where it is unset, in a temporary one, on a single machine only."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        where = sc.getConf().get("spark.checkpoint.dir", None)
        if where is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def end_nodes(edges: DataFrame) -> DataFrame:
    return edges.select("page_id", F.explode(F.array("src", "dst")).alias("node")).distinct()


def steps_of(edges: DataFrame) -> DataFrame:
    return kept(edges.where("src <> dst").select("page_id", F.col("src").alias("node"), F.col("dst").alias("to")).distinct())


def numbered(edges: DataFrame) -> DataFrame:
    """page_id, node, i: the nodes of each page from 0."""
    return kept(end_nodes(edges).withColumn("i", F.row_number().over(Window.partitionBy("page_id").orderBy("node")) - 1))


def bit_search(edges: DataFrame, *, hops: int | None = None, fronts: list[DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(page_id, node, r, d: how many nodes reach a node, and their summed hops; the numbered nodes).

    64 sources are one long: a round sends the bits that are new at a node over its edges, and counts of set bits add up the
    sums, so no pairs arise. `fronts` gets the new bits of each round: page_id, node, block, fresh, distance."""
    number, step = numbered(edges), steps_of(edges)
    own = F.expr("shiftleft(1L, cast(i % 64 as int))")
    state = kept(number.select("page_id", "node", F.floor(F.col("i") / 64).cast("int").alias("block"), own.alias("seen"), F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("d"), own.alias("fresh")))
    n = 0
    while hops is None or n < hops:
        n += 1
        sent = state.where("fresh <> 0").select("page_id", "node", "block", "fresh").join(step, ["page_id", "node"])
        sent = sent.groupBy("page_id", F.col("to").alias("node"), "block").agg(F.bit_or("fresh").alias("bits"))
        both = state.drop("fresh").join(sent, ["page_id", "node", "block"], "full").na.fill(0, ["seen", "bits", "r", "d"])
        fresh = F.col("bits").bitwiseAND(F.bitwise_not("seen"))
        both = both.withColumn("fresh", fresh).withColumn("more", F.bit_count("fresh").cast("long"))
        state = kept(both.select("page_id", "node", "block", F.col("seen").bitwiseOR(F.col("bits")).alias("seen"), (F.col("r") + F.col("more")).alias("r"), (F.col("d") + n * F.col("more")).alias("d"), "fresh"))
        front = state.where("fresh <> 0")
        if front.isEmpty():
            break
        if fronts is not None:
            fronts.append(kept(front.select("page_id", "node", "block", "fresh", F.lit(n).alias("distance"))))
    return state.groupBy("page_id", "node").agg(F.sum("r").alias("r"), F.sum("d").alias("d")), number


def pair_distances(edges: DataFrame, *, hops: int | None = None) -> DataFrame:
    """page_id, src, dst, distance of all ordered pairs that reach each other (within `hops`)."""
    fronts: list[DataFrame] = []
    _, number = bit_search(edges, hops=hops, fronts=fronts)
    if not fronts:
        return edges.select("page_id", "src", "dst", F.lit(0).alias("distance")).limit(0)
    found = fronts[0]
    for f in fronts[1:]:
        found = found.unionByName(f)
    bit = F.expr("filter(sequence(0, 63), k -> (fresh & shiftleft(1L, k)) <> 0)")
    pairs = found.select("page_id", F.col("node").alias("dst"), "distance", "block", F.explode(bit).alias("k")).withColumn("i", F.col("block") * 64 + F.col("k"))
    return pairs.join(number.withColumnRenamed("node", "src"), ["page_id", "i"]).select("page_id", "src", "dst", "distance")


def path_shares(edges: DataFrame) -> DataFrame:
    """page_id, node, part: summed shares of the shortest paths through each node, not counting their ends.

    For SOURCES sources of each page at a time: path counts go forward level by level, shares go back level by level."""
    number, step = numbered(edges), steps_of(edges)
    last, out = number.agg(F.max("i")).first()[0], None
    back = step.select("page_id", F.col("node").alias("before"), F.col("to").alias("node"))
    for low in range(0, (last or 0) + 1, SOURCES):
        front = kept(number.where(F.col("i").between(low, low + SOURCES - 1)).select("page_id", F.col("node").alias("s"), "node", F.lit(1.0).alias("paths")))
        levels, known = [front], front.select("page_id", "s", "node")
        while True:
            nxt = levels[-1].join(step, ["page_id", "node"]).groupBy("page_id", "s", F.col("to").alias("node")).agg(F.sum("paths").alias("paths"))
            front = kept(nxt.join(known, ["page_id", "s", "node"], "left_anti"))
            if front.isEmpty():
                break
            levels.append(front)
            known = kept(known.unionByName(front.select("page_id", "s", "node")))
        share = None
        for k in range(len(levels) - 1, 0, -1):
            here = levels[k].withColumn("share", F.lit(0.0)) if share is None else levels[k].join(share, ["page_id", "s", "node"], "left").na.fill(0.0, ["share"])
            here = kept(here)
            score = here.groupBy("page_id", "node").agg(F.sum("share").alias("part")).where("part > 0")
            out = score if out is None else out.unionByName(score)
            up = here.withColumn("each", (1 + F.col("share")) / F.col("paths")).join(back, ["page_id", "node"]).groupBy("page_id", "s", F.col("before").alias("node")).agg(F.sum("each").alias("each"))
            share = up.join(levels[k - 1], ["page_id", "s", "node"]).select("page_id", "s", "node", (F.col("each") * F.col("paths")).alias("share"))
        out = kept(out.groupBy("page_id", "node").agg(F.sum("part").alias("part"))) if out is not None else None
    return out if out is not None else number.select("page_id", "node", F.lit(0.0).alias("part")).limit(0)


def weak_labels(edges: DataFrame) -> DataFrame:
    """page_id, node, component: smallest label of the neighbours, then of the label's own label, until nothing changes."""
    both = both_ways(edges)
    label = kept(end_nodes(edges).withColumn("component", F.col("node")))
    while True:
        near = both.join(label, ["page_id", "node"]).select("page_id", F.col("to").alias("node"), "component")
        low = label.unionByName(near).groupBy("page_id", "node").agg(F.min("component").alias("component"))
        jump = label.select("page_id", F.col("node").alias("component"), F.col("component").alias("top"))
        nxt = kept(low.join(jump, ["page_id", "component"]).select("page_id", "node", F.col("top").alias("component")))
        if nxt.join(label, ["page_id", "node", "component"], "left_anti").isEmpty():
            return nxt
        label = nxt


def both_ways(edges: DataFrame) -> DataFrame:
    some = edges.where("src <> dst")
    one = some.select("page_id", F.col("src").alias("node"), F.col("dst").alias("to"))
    return kept(one.unionByName(one.select("page_id", F.col("to").alias("node"), F.col("node").alias("to"))).distinct())


def cut_nodes_by_rounds(edges: DataFrame) -> DataFrame:
    """page_id, articulation_points, is_biconnected of undirected graphs.

    A breadth-first spanning forest gives every node its parent; subtree sizes (from the leaves up) and places in preorder (from
    the roots down) make a subtree an interval, and the lowest and highest places that a subtree's other edges lead to go up
    again. Tree edges, each known by its lower node, lie in one block if an edge outside the tree joins their nodes, or if the lower
    one's subtree leads out of the upper one's interval; the blocks are the components of these links. A node whose tree
    edges lie in several blocks is a cut node. Three passes over the levels of the forest, then joins."""
    both, label = both_ways(edges), weak_labels(edges)
    kind = label.schema["node"].dataType
    level = kept(label.where("node = component").select("page_id", "node", F.lit(None).cast(kind).alias("parent")))
    levels, known = [level], level.select("page_id", "node")
    while True:
        nxt = levels[-1].select("page_id", "node").join(both, ["page_id", "node"]).groupBy("page_id", F.col("to").alias("node")).agg(F.min("node").alias("parent"))
        level = kept(nxt.join(known, ["page_id", "node"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
        known = kept(known.unionByName(level.select("page_id", "node")))
    sized, below = [], None
    for level in reversed(levels):
        own = level.withColumn("size", F.lit(1).cast("long"))
        if below is not None:
            own = level.join(below, ["page_id", "node"], "left").select("page_id", "node", "parent", (1 + F.coalesce("sum", F.lit(0))).cast("long").alias("size"))
        sized.append(kept(own))
        below = sized[-1].groupBy("page_id", F.col("parent").alias("node")).agg(F.sum("size").alias("sum"))
    placed = [kept(sized[-1].withColumn("pre", F.lit(0).cast("long")))]
    before = F.coalesce(F.sum("size").over(Window.partitionBy("page_id", "parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    for level in reversed(sized[:-1]):
        up = placed[-1].select("page_id", F.col("node").alias("parent"), F.col("pre").alias("up"))
        placed.append(kept(level.withColumn("before", before).join(up, ["page_id", "parent"]).select("page_id", "node", "parent", "size", (F.col("up") + 1 + F.col("before")).alias("pre"))))
    tree = placed[0]
    for level in placed[1:]:
        tree = tree.unionByName(level)
    tree = kept(tree)
    ends = both.join(tree.select("page_id", "node", "parent"), ["page_id", "node"]).join(tree.select("page_id", F.col("node").alias("to"), F.col("parent").alias("to_parent"), F.col("pre").alias("to_pre")), ["page_id", "to"])
    free = kept(ends.where("not (parent <=> to) and not (to_parent <=> node)"))
    reach = free.groupBy("page_id", "node").agg(F.min("to_pre").alias("low"), F.max("to_pre").alias("high"))
    spans, below = [], None
    for level in reversed(placed):
        own = level.join(reach, ["page_id", "node"], "left").withColumns({"low": F.least("pre", "low"), "high": F.greatest("pre", "high")})
        if below is not None:
            own = own.join(below, ["page_id", "node"], "left").withColumns({"low": F.least("low", "a"), "high": F.greatest("high", "b")}).drop("a", "b")
        spans.append(kept(own))
        below = spans[-1].groupBy("page_id", F.col("parent").alias("node")).agg(F.min("low").alias("a"), F.max("high").alias("b"))
    span = spans[0]
    for level in spans[1:]:
        span = span.unionByName(level)
    span = kept(span)
    upper = span.where("parent is not null").select("page_id", F.col("node").alias("parent"), F.col("pre").alias("p"), F.col("size").alias("s"))
    out_of = span.join(upper, ["page_id", "parent"]).where("low < p or high >= p + s").select("page_id", F.col("parent").alias("src"), F.col("node").alias("dst"))
    links = free.select("page_id", F.col("node").alias("src"), F.col("to").alias("dst")).unionByName(out_of)
    block = weak_labels(links).withColumnRenamed("component", "block")
    low = span.where("parent is not null").join(block, ["page_id", "node"], "left").select("page_id", "node", "parent", F.coalesce("block", "node").alias("block"))
    touching = low.select("page_id", "node", "block").unionByName(low.select("page_id", F.col("parent").alias("node"), "block"))
    cuts = touching.groupBy("page_id", "node").agg((F.min("block") < F.max("block")).cast("long").alias("cut")).groupBy("page_id").agg(F.sum("cut").alias("articulation_points"))
    per = label.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("node") == F.col("component"), 1)).alias("parts"))
    out = per.join(cuts, "page_id", "left").na.fill(0, ["articulation_points"])
    return out.select("page_id", "articulation_points", ((F.col("n") > 1) & (F.col("parts") == 1) & (F.col("articulation_points") == 0)).cast("int").alias("is_biconnected"))
