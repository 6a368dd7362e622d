"""Near-duplicates of five-word shingles, similarity 0.8 or more: SimHash fingerprints in sharded BK-trees, then shingles.

Two sets of similarity s or more, each sorted by one order of all shingles, share one of their first n - ceil(s n) + 1
elements (their prefix). So a shard is keyed by a prefix shingle, and no pair above the threshold is missed. The order
is that of the hashes, with common shingles (at most HEAVY, by their counts in a first pass over whole texts) behind all
others: any order finds the same pairs, this one keeps passages that many documents share out of the shards.

Each shard holds a BK-tree of its texts' XXH64 SimHash fingerprints (WORDS times 64 bits). Linked are texts of the tree whose
sizes allow the threshold and whose fingerprints differ in at most RADIUS bits. At similarity 0.8 a bit differs with probability
0.15, so 39 of 256 are expected and 68 is five deviations away (about one lost pair in three millions at 0.8, fewer above it).
That holds for small sets too, as every bit is a vote of its own (0.12 to 0.16 from 8 shingles on, 0.19 for 4 against 5); below
SMALL shingles the search takes the whole tree. Unrelated fingerprints lie half their bits apart, so at this radius the
distances alone spare few branches; a search also leaves out branches of other sizes and those that can link nothing new. A
shard gives a spanning forest of its links, not all pairs, and the components of all forests are clusters of candidates.

Spark sorts the shards, and a task streams over them: it holds one shard of at most MARK texts at a time. A larger shard is hot:
its shingle is common although it isn't among HEAVY. Pairs that meet in hot shards only are found in a second round, among
the texts of hot shards alone, whose shingles are counted in full and put in order of their counts, the rarest first. What is
then still above MARK holds texts all of whose shingles are common, that is, copies of each other: they are one cluster.

The texts of a cluster meet with the hashes of all their shingles, where the similarities of all pairs are computed and only
links come out, at most one for each text. A cluster above BLOCK texts or BYTES is dealt into blocks; where a first round
inside the blocks leaves more than one component, one text of each component meets others in rounds as long as that joins
components, and then every two blocks that do not yet belong together meet. So no pair is left out, no text is sent
more than once but in such clusters, and a large group of copies costs about its own size. Shingles are told apart by 64-bit
hashes, texts by 64-bit hashes of their words (0.03 clashes expected among 10**9 different texts).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST, held, keep_winners, slices, to_table
from .minhash import mix
from .simhash import BkForest, bits_of, components, forest_links, popcount, shingle_array

HEAVY, COMMON = 1 << 16, 16
WORDS, RADIUS, SMALL = 4, 68, 16
MARK = 8192  # texts of a shard, above which it is hot
LOOKUPS = 1 << 18  # pairs of a text and a tree's node that are looked at together, about
TURNS = 2  # rounds in which one text of each component meets others, at most; then all meet
STEP = 1 << 16  # words whose shingles are hashed together
SLICE = 8 << 20  # bytes of text whose shingles are counted together
SHARE = 64 << 20  # bytes of text to a shuffle partition, whose prefix rows are about 100 MB
BLOCK, BYTES, CELLS = 512, 16 << 20, 1 << 22
#: Similarity of 4 / 5, as whole numbers
OVER, UNDER = 4, 5


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def text_id(w: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(w))


def shingle_hashes(w: list[bytes], width: int) -> np.ndarray:
    """XXH64 of the shingles in order, repeats included, as op5 takes them; of a long text STEP words at a time."""
    parts = [shingle_array(w[at : at + STEP + width - 1], width) for at in range(0, max(1, len(w) - width + 1), STEP)]
    return np.concatenate(parts)


def overlap_links(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): links that connect all sets that pairs of similarity OVER / UNDER or more connect, at most one for each set."""
    m, n = len(sets), np.array([len(x) for x in sets], np.int64)
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    keep = shared[col]
    row, col = np.repeat(np.arange(m), n)[keep], (np.cumsum(shared) - 1)[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both, wide = np.zeros((m, m), np.float32), max(1, CELLS // m)
    for at in range(0, int(shared.sum()), wide):
        i, j = np.searchsorted(col, [at, at + wide])
        dense = np.zeros((m, wide), np.float32)
        dense[row[i:j], col[i:j] - at] = 1
        both += dense @ dense.T
    like = (OVER + UNDER) * both.astype(np.float64) >= OVER * (n[:, None] + n[None, :])
    a, b = np.nonzero(np.triu(like, 1))
    label = forest_links(a, b, m)
    linked = np.flatnonzero(label != np.arange(m))
    return linked, label[linked]


def prefix(h: np.ndarray, late: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of sorted distinct hashes, the first n - ceil(s n) + 1, those in late = (sorted hashes, places) behind all others, by place."""
    n, (heavy, place) = len(h), late
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)
        is_late = heavy[at] == h
        if is_late.any():
            back = h[is_late]
            h = np.concatenate([h[~is_late], back[np.argsort(place[at[is_late]])]])
    return h[: n - -(-OVER * n // UNDER) + 1]


def by_count(texts: DataFrame, width: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` most frequent of all shingles, by the sum of counts of 2 or more in each SLICE of text (a common shingle stands
    in every slice; any order is right, this one is fast): (sorted hashes, places by count)."""

    def run(batches):
        held("jaccard", 0, object)
        for b in slices(batches, 0, SLICE):
            hs = [np.unique(shingle_hashes(w, width)) for w in {text_id(w): w for w in map(words, b.column(0).to_pylist())}.values()]
            h, n = np.unique(np.concatenate([*hs, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1])], ["h", "n"])

    counts = texts.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    got = counts.where(F.col("n") > COMMON).orderBy(F.desc("n"), "h").limit(most).collect()
    h = np.array([r.h for r in got], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], len(h) - order


def fingerprint(h: np.ndarray) -> list[int]:
    """WORDS SimHash words of a text's distinct shingle hashes."""
    return [bits_of(h if k == 0 else mix(h + np.uint64(k))) for k in range(WORDS)]


def may_match(n: np.ndarray, fp: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Pairs (at, to) of rows with sizes n (that of `at` is not larger) and fingerprints fp that need a test."""
    fits = UNDER * n[at].astype(np.int64) >= OVER * n[to].astype(np.int64)
    return fits & ((n[at] < SMALL) | (popcount(fp[at] ^ fp[to]) <= RADIUS))


def prefix_rows(texts: DataFrame, width: int, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """h, t, n, f0 ..: a row for each prefix shingle of each text, once a task for equal texts."""
    sent = texts.sparkSession.sparkContext.broadcast(heavy)

    def rows(batches):
        late, seen = sent.value, set()
        held("jaccard", 0, object)
        for b in slices(batches, 0, 1 << 21):
            hs, ts, ns, fs = [], [], [], []
            for text in b.column(0).to_pylist():
                w = words(text)
                t = text_id(w)
                if t in seen:
                    continue
                seen.add(t)
                h = np.unique(shingle_hashes(w, width))
                hs.append(prefix(h, late))
                ts.append(t)
                ns.append(len(h))
                fs.append(fingerprint(h))
            if not hs:
                continue
            count, fp = [len(x) for x in hs], np.array(fs, np.uint64).view(np.int64)
            cols = [np.concatenate(hs).view(np.int64), *(np.repeat(x, count) for x in (np.array(ts, np.uint64).view(np.int64), np.array(ns, np.int32), *fp.T))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h", *names])

    names = ["t", "n", *(f"f{k}" for k in range(WORDS))]
    return texts.select("text").mapInArrow(rows, "h long, t long, n int, " + ", ".join(f"f{k} long" for k in range(WORDS)))


def shard_forest(h: np.ndarray, n: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Of rows whose shards h are runs, each sorted by n: for every row the first that links of the shard's BK-tree connect it to.

    All texts of a shard are looked up in its tree, in turns of 1, 1, 2, 4 .. texts spread over its sizes. A search leaves out what
    cannot link: branches of other sizes, and branches whose texts were all looked up or belong to its own component.
    """
    whole, shard = len(h), np.cumsum(np.append(True, h[1:] != h[:-1])[: len(h)])
    order = np.lexsort((*fp.T, n, shard))  # stable: of equal rows, the first leads
    new = np.ones(whole, bool)
    new[1:] = (shard[order][1:] != shard[order][:-1]) | (n[order][1:] != n[order][:-1]) | (fp[order][1:] != fp[order][:-1]).any(1)
    lead = np.empty(whole, np.int64)
    lead[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    rows = np.flatnonzero(lead == np.arange(whole))  # a tree holds different values only
    shard, n, fp = shard[rows], n[rows].astype(np.int64), fp[rows]
    forest, label, done = BkForest(fp, shard), np.arange(len(rows)), np.zeros(len(rows), bool)
    least, most = forest.bounds(n, n)
    size = np.bincount(shard, minlength=1)
    at = np.arange(len(rows)) - (np.cumsum(size) - size)[shard]
    turn = np.where(at > 0, np.frexp(size[shard] - 1)[1] - np.frexp(at & -at)[1] + 2, 1)
    radius = np.where(OVER * n <= UNDER * (SMALL - 1), 64 * WORDS, RADIUS)  # below SMALL shingles all of the tree
    for k in range(1, int(turn.max(initial=0)) + 1):
        ask, a, b = np.flatnonzero((turn == k) & (size[shard] > 1)), [label[:0]], [label[:0]]
        low, high = forest.bounds(np.where(done, len(rows), label), np.where(done, -1, label))
        part = np.cumsum(size[shard[ask]]) // LOOKUPS
        for some in np.split(ask, np.flatnonzero(part[1:] != part[:-1]) + 1):

            def follow(q, at, some=some):
                own, sized = label[some][q], n[some][q]
                return (low[at] <= high[at]) & ((low[at] != own) | (high[at] != own)) & (OVER * least[at] <= UNDER * sized) & (UNDER * most[at] >= OVER * sized)

            q, node = forest.search(fp[some], shard[some], radius[some], follow)
            q = some[q]
            apart = label[q] != label[node]
            q, node = q[apart], node[apart]
            hit = may_match(n, fp, np.minimum(q, node), np.maximum(q, node))
            a.append(label[q[hit]])
            b.append(label[node[hit]])
        label = forest_links(np.concatenate(a), np.concatenate(b), len(rows))[label]
        done[ask] = True
    of = np.empty(whole, np.int64)
    of[rows] = rows[label]
    return of[lead]


class Shards:
    """Links of a sorted stream of shards. Holds the last, unfinished shard; of a hot one only its first text."""

    def __init__(self, star: bool, mark: int):
        self.star, self.mark, self.hot, self.first, self.last = star, mark, None, 0, None
        self.rest: list[np.ndarray] | None = None

    def links(self, columns: list[np.ndarray], last: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, hot shingles) of the shards that end in these columns h, t, n and fingerprints; with `last`, of the rest as well."""
        h, t = columns[:2]
        new = np.ones(len(h), bool)
        if len(h):
            new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
            new[0] = self.last != (h[0], t[0])
            self.last = h[-1], t[-1]
        out_a, out_b, hot = [], [], []
        if self.hot is not None:
            more = new & (h == self.hot)
            if self.star and more.any():
                out_a.append(t[more])
                out_b.append(np.full(int(more.sum()), self.first))
            new &= h != self.hot
            if len(h) and h[-1] != self.hot:
                self.hot = None
        columns = [c[new] for c in columns]
        if self.rest is not None:
            columns = [np.concatenate([r, c]) for r, c in zip(self.rest, columns, strict=True)]
            self.rest = None
        h, t = columns[:2]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(h)))
        keep = (size > 1) & (size <= self.mark)  # shards of one text are most
        for i in np.flatnonzero(size > self.mark):
            run = slice(first[i], first[i] + size[i])
            if self.star:
                out_a.append(t[run][1:])
                out_b.append(np.full(size[i] - 1, t[first[i]]))
            else:
                hot.append(h[first[i]])
        if len(h) and not last:
            if size[-1] > self.mark:
                self.hot, self.first = h[-1], t[first[-1]]
            else:
                keep[-1] = False
                self.rest = [c[first[-1] :].copy() for c in columns]
        some = np.repeat(keep, size)
        h, t, n, *fp = (c[some] for c in columns)
        label = shard_forest(h, n, np.stack(fp, axis=1).view(np.uint64))
        linked = np.flatnonzero(label != np.arange(len(label)))
        pair = np.unique(np.stack([np.concatenate([t[linked], *out_a]), np.concatenate([t[label[linked]], *out_b])]), axis=1)
        return pair[0], pair[1], np.array(hot, np.int64)


def candidates(texts: DataFrame, width: int, heavy: tuple[np.ndarray, np.ndarray], parts: int, star: bool) -> DataFrame:
    """a, b: links that connect the different texts that comparisons in their shards connect. Of a hot shard, with `star`, links
    of all to one; else a row of its shingle a and null."""
    mark = MARK

    def gather(batches):
        held("jaccard", 0, object)
        shards = Shards(star, mark)
        for b in batches:
            yield rows(*shards.links([c.to_numpy() for c in b.columns]))
        yield rows(*shards.links([np.zeros(0, k) for k in (np.int64, np.int64, np.int32, *[np.int64] * WORDS)], last=True))

    def rows(a, b, hot):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, hot])), pa.array(np.concatenate([b, hot]), mask=np.repeat([False, True], [len(b), len(hot)]))], ["a", "b"])

    return prefix_rows(texts, width, heavy).repartition(parts, "h").sortWithinPartitions("h", "n", "t").mapInArrow(gather, "a long, b long")


def touched(texts: DataFrame, width: int, heavy: tuple[np.ndarray, np.ndarray], hot: np.ndarray | None) -> DataFrame:
    """t, text: the different texts with a prefix shingle in `hot` (None: all)."""
    sent = texts.sparkSession.sparkContext.broadcast((heavy, hot))

    def run(batches):
        held("jaccard", 0, object)
        late, some = sent.value
        for b in slices(batches, 0, 1 << 21):
            t, keep = [], []
            for text in b.column(0).to_pylist():
                w = words(text)
                keep.append(some is None or bool(np.isin(prefix(np.unique(shingle_hashes(w, width)), late), some).any()))
                t.append(text_id(w))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(t, np.uint64).view(np.int64)), b.column(0)], ["t", "text"]).filter(pa.array(keep, pa.bool_()))

    return texts.select("text").mapInArrow(run, "t long, text string").groupBy("t").agg(F.first("text").alias("text"))


def dealt(clusters: DataFrame, sets: DataFrame) -> DataFrame:
    """h, t, k, i: texts of each cluster h in block i of its k blocks."""
    members = clusters.join(sets.select("t", F.octet_length("set").cast("long").alias("bytes")), "t")
    size = members.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.sum("bytes").alias("bytes"))
    k = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("bytes") / BYTES)).cast("int")
    return members.select("h", "t").join(size.select("h", k.alias("k")), "h").withColumn("i", F.pmod(F.xxhash64("t"), F.col("k")).cast("int"))


def across(blocks: DataFrame, of: DataFrame) -> DataFrame:
    """h, i, j, t: the pairs of blocks in which the texts of a cluster of more than one component meet, but for two blocks of
    one and the same component."""
    rooted = blocks.where("k > 1").join(of, F.col("t") == F.col("node"), "left").withColumn("root", F.coalesce("root", "t")).drop("node")
    per = rooted.groupBy("h", "k", "i").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    some = per.groupBy("h").agg(F.min("low").alias("a"), F.max("high").alias("b")).where("a <> b").select("h")
    per = per.join(some, "h").select("h", "i", F.when(F.col("low") == F.col("high"), F.col("low")).alias("only"))
    both = per.join(per.withColumnsRenamed({"i": "j", "only": "other"}), "h").where("i < j and not coalesce(only = other, false)").select("h", "i", "j")
    sides = both.select("h", "i", "j", F.explode(F.array("i", "j")).alias("x"))
    return rooted.select("h", "t", F.col("i").alias("x")).join(sides, ["h", "x"]).select("h", "i", "j", "t")


def block_links(meet: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: links among the texts that meet. sets: t and set, the bytes of its shingles' hashes."""
    meet = to_table(meet, "shingle-meetings")
    if meet.count() <= BROADCAST:  # else the sets are exchanged once more
        meet = F.broadcast(meet)
    rows = meet.join(sets, "t").groupBy("h", "i", "j").agg(F.collect_list(F.struct("t", "set")).alias("m")).where(F.size("m") > 1).select("m.t", "m.set")

    def run(batches):
        held("jaccard", 0, object)
        for b in batches:
            out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for t, own in zip(*(b.column(i) for i in range(2)), strict=True):
                t = t.values.to_numpy(zero_copy_only=False)
                x, y = overlap_links([np.frombuffer(s.as_buffer(), np.uint64) for s in own.values])
                out_a.append(t[x])
                out_b.append(t[y])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def with_text_id(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text) with t."""

    def run(batches):
        for b in slices(batches, 1, 1 << 22):
            t = np.array([text_id(words(x)) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(t)], ["doc_id", "text", "t"])

    return rows.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, t long")


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """t, set: the sorted distinct hashes of each text's shingles, as bytes."""

    def run(batches):
        held("jaccard", 0, object)
        for b in slices(batches, 1, 1 << 21):
            sets = [np.unique(shingle_hashes(words(x), width)).tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["t", "set"])

    return texts.select("t", "text").mapInArrow(run, "t long, set binary")


def meetings(blocks: DataFrame, of: DataFrame, turn: int) -> DataFrame:
    """h, i, j, t: one text of each component of a dealt cluster of more than one, about BLOCK of them in a block."""
    rooted = blocks.where("k > 1").join(of, F.col("t") == F.col("node"), "left").select("h", "t", F.coalesce("root", "t").alias("root"))
    one = rooted.groupBy("h", "root").agg(F.min("t").alias("t"))
    k = one.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("h", F.ceil(F.col("m") / BLOCK).cast("int").alias("k"))
    i = F.pmod(F.xxhash64("t", F.lit(turn)), F.col("k")).cast("int")
    return one.join(k, "h").select("h", i.alias("i"), i.alias("j"), "t")


def linked(rows: DataFrame, width: int) -> DataFrame | None:
    """node, root of all texts that have near-duplicates (None: there are no candidates). rows has doc_id and text."""
    spark = rows.sparkSession
    heavy = by_count(rows, width, HEAVY)
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARE))
    maybe = to_table(candidates(rows, width, heavy, parts, star=False).distinct(), "shingle-candidates")
    hot = maybe.where("b is null").select("a").distinct().limit(BROADCAST + 1).toPandas()["a"].to_numpy(np.int64)
    maybe = maybe.where("b is not null")
    if len(hot):
        texts = to_table(touched(rows, width, heavy, np.sort(hot).view(np.uint64) if len(hot) <= BROADCAST else None), "shingle-hot-texts")
        more = candidates(texts, width, by_count(texts, width, BROADCAST), parts, star=True)
        maybe = to_table(maybe.unionByName(more).distinct(), "shingle-candidates")
    if maybe.isEmpty():
        return None
    clusters = to_table(components(maybe).select(F.col("root").alias("h"), F.explode(F.array("node", "root")).alias("t")).distinct(), "shingle-clusters")
    members = clusters.select("t")
    if clusters.count() <= BROADCAST:  # else texts are exchanged
        members = F.broadcast(members)
    one = with_text_id(rows).join(members, "t", "left_semi").groupBy("t").agg(F.first("text").alias("text"))
    sets = to_table(shingle_sets(one, width), "shingle-sets")
    blocks = to_table(dealt(clusters, sets), "shingle-blocks")
    links = to_table(block_links(blocks.select("h", "i", F.col("i").alias("j"), "t"), sets), "shingle-links")
    of = components(links)
    if blocks.where("k > 1").isEmpty():
        return of
    for turn in range(1, TURNS + 1):
        more = to_table(block_links(meetings(blocks, of, turn), sets), "shingle-links")
        if more.isEmpty():
            break
        of = components(more.unionByName(of.toDF("a", "b")))
    return components(block_links(across(blocks, of), sets).unionByName(of.toDF("a", "b")))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """docs with one row of each component of links of Jaccard similarity 0.8 or more between sets of `width`-word shingles:
    that of the smallest doc_id (nulls last; of a doc_id's several texts one, of rows equal in both one).

    Words are told apart by ASCII blanks, without ASCII case. Null, empty and blank texts are one component; a text of
    fewer words than `width` is one shingle. Very long texts are read whole, one at a time. An empty table stays empty. All
    columns pass through; columns of any other name may be there, none is replaced.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    of = linked(rows, width)
    prints = to_table(with_text_id(rows).select("doc_id", "t"), "text-ids")
    rooted = prints.withColumn("root", F.col("t")) if of is None else prints.join(of, prints.t == of.node, "left").select("doc_id", "t", F.coalesce("root", "t").alias("root"))
    return keep_winners(docs, rooted, lambda x: text_id(words(x)), doc_id=doc_id, text=text)
