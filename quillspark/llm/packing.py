"""Sequence packing: first-fit decreasing on a tournament tree of bin capacities, in randomised groups of documents.

Documents are encoded where they are read and dealt by a hash of id and text into groups of about GROUP documents;
each group is packed on its own, so no task holds more than its group. A document's whole sequences of `size` tokens
stand alone. The remainders go, longest first, into the first open sequence with room, which a tournament tree (each
node holds the larger free capacity of its two children) finds in log2(bins) steps. What is then still open is topped
up: pieces of the emptiest sequences are cut to fill the fullest ones, so one sequence of a group at most has padding.

No token limit cuts a document: every id lies in exactly one piece.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, slices, to_table
from .token_counts import SLICE, class_ranges, encode_texts, machine

GROUP = 4096
SHARE = 8  # groups in a partition, at most on average
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """Free capacities of bins; find the first bin with at least `need` free."""

    def __init__(self, bins: int, size: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [size] * (2 * self.leaves)

    def first(self, need: int) -> int:
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < need:
                node += 1
        return node - self.leaves

    def take(self, bin_: int, n: int) -> None:
        free, node = self.free, bin_ + self.leaves
        free[node] -= n
        node >>= 1
        while node:
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                return
            free[node] = best
            node >>= 1


def pack(lengths: list[int], size: int) -> list[list[tuple[int, int, int]]]:
    """Sequences, each a list of (document, start, length), of documents with these lengths."""
    whole, rest = [], []
    for d, n in enumerate(lengths):
        whole += [[(d, s, size)] for s in range(0, n - size + 1, size)]
        if n % size:
            rest.append((n % size, d))
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree, bins = Tournament(len(rest), size), []
    for n, d in rest:
        b = tree.first(n)
        if b == len(bins):
            bins.append([])
        tree.take(b, n)
        bins[b].append((d, lengths[d] - n, n))
    return whole + top_up(bins, size)


def top_up(bins: list[list[tuple[int, int, int]]], size: int) -> list[list[tuple[int, int, int]]]:
    """Cut pieces of the emptiest sequences to fill the fullest; all but one are full then."""
    fill = [sum(n for _, _, n in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (-fill[b], b))
    i, j = 0, len(order) - 1
    while i < j:
        to, source = order[i], order[j]
        gap = size - fill[to]
        if gap == 0:
            i += 1
        elif not bins[source]:
            j -= 1
        else:
            d, s, n = bins[source].pop()
            cut = min(gap, n)
            bins[to].append((d, s + n - cut, cut))
            if cut < n:
                bins[source].append((d, s, n - cut))
            fill[to] += cut
            fill[source] -= cut
    return [b for b in bins if b]


def dealt(docs: DataFrame) -> tuple[DataFrame, int]:
    """(docs with grp, the number of groups): about GROUP documents in each group, by a hash of id and text. Rows that
    repeat more than GROUP times, which one hash would put together, are spread over as many groups as they fill."""
    h = F.xxhash64("doc_id", "text")
    per = to_table(docs.select(h.alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).groupBy((F.col("n") > GROUP).alias("hot"), F.when(F.col("n") > GROUP, F.col("h")).alias("h")).agg(F.sum("n").alias("n")), "packing-groups")
    groups = max(1, -(-(per.agg(F.sum("n")).first()[0] or 0) // GROUP))
    hot = per.where("hot").select("h", F.ceil(F.col("n") / GROUP).alias("k"))
    if hot.isEmpty():
        return docs.withColumn("grp", F.pmod(h, F.lit(groups))), groups
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("k"))
    salted = docs.withColumn("h", h).join(F.broadcast(hot), "h", "left").withColumn("grp", F.pmod(F.col("h") + F.coalesce(salt, F.lit(0)), F.lit(groups)))
    return salted.select("doc_id", "text", "grp"), groups


def encoded(docs: DataFrame, path: str, *, doc_id: str, text: str, end_id: int) -> DataFrame:
    """doc_id, grp, ids: 16-bit (or 32-bit) little-endian ids with end_id last, of every whole text (null: empty)."""
    rows, groups = dealt(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")))
    ranges = class_ranges()

    def run(batches):
        m = machine(path, ids=True, ranges=ranges)
        kind = "<u2" if len(m.size) <= 1 << 16 else "<u4"
        for b in slices(batches, 1, SLICE):
            ids = [np.append(x, end_id).astype(kind).tobytes() for x in encode_texts(b.column(1).to_pylist(), m)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(ids, pa.binary()), pa.array([int(kind[2])] * len(ids), pa.int32())], ["doc_id", "grp", "ids", "width"])

    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups // SHARE)
    return rows.mapInArrow(run, "doc_id long, grp long, ids binary, width int").repartition(parts, "grp")


def pack_documents(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", size: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all documents, with their ids as little-endian unsigned 32-bit numbers.

    doc_id; start, the document's ids before the piece; length; ids; doc_tokens, with end_id; sequence_id; offset in
    the sequence, gapless from 0. A null or empty text is end_id alone. Repeated rows are packed each (docs must be a
    table that a retried task reads the same again); null ids are kept; other columns are ignored whatever their names;
    a very long text is cut into whole sequences; an empty table gives no pieces.
    """

    def run(group: pa.Table) -> pa.Table:
        held("packing", 0, object)  # a reused worker lets go of the transducer
        grp, width = group["grp"][0].as_py(), group["width"][0].as_py()
        docs = sorted(zip(group["doc_id"].to_pylist(), group["ids"].to_pylist(), strict=True), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        lengths = [len(x) // width for _, x in docs]
        out = []
        for k, sequence in enumerate(pack(lengths, size)):
            offset = 0
            for d, s, n in sequence:
                piece = np.frombuffer(docs[d][1], f"<u{width}", n, s * width).astype("<u4").tobytes()
                out.append((docs[d][0], s, n, piece, lengths[d], grp << 32 | k, offset))
                offset += n
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return encoded(docs, path, doc_id=doc_id, text=text, end_id=end_id).groupBy("grp").applyInArrow(run, PIECES)


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
