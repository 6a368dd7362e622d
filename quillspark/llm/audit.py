"""Filter interaction audit: what each filter removes, in every order of the filters.

Documents are reduced to counts by part and mask, the set of filters that they fail; there are at most 2**m masks for m
filters, so the rest doesn't depend on the number of documents. For a part, the mask matrix (0 where a mask fails a
filter, infinity elsewhere) and the matrix of inverse permutations (the place of each filter in each order) are combined by
a min-plus product: the least place of a failed filter is the step that removes the mask. Counts are scattered by that
step; what fails a filter but went at an earlier step is redundant.

Equal texts are found by 128-bit hashes (BLAKE2b). A document's mask is joined with the least id of its text by an
aggregate over (text, part, mask, labels), which is summed up before it is exchanged, so a text with many copies is a few rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from hashlib import blake2b
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held, slices

SIGNS = re.compile(rb"[#$%&*|]")
CAPITALS = bytes(range(0x41, 0x5B))
#: (letter, text and its words as bytes -> fails); the last letter is for repeated texts
RULES: tuple[tuple[str, Callable[[str, bytes, list[bytes]], bool]], ...] = (
    ("A", lambda text, raw, words: len(words) < 200),
    ("B", lambda text, raw, words: 100 * len(set(words)) < 50 * len(words)),
    ("C", lambda text, raw, words: 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > 3 * len(text)),
    ("D", lambda text, raw, words: SIGNS.search(raw) is not None),
)
REPEATED = "E"
FILTERS = 7  # at most: 5,040 orders


def removal_steps(fails: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Min-plus product: fails (masks x filters, bool), place (orders x filters, from 1) -> step that removes each mask in each
    order, filters + 1 where none does."""
    m = fails.shape[1]
    cost = np.where(fails, 0, m + 1)
    out = np.full((len(fails), len(place)), m + 1)
    for f in range(m):
        np.minimum(out, cost[:, f, None] + place[None, :, f], out=out)
    return out


def interactions(fails: np.ndarray, weights: dict[str, np.ndarray], names: str) -> pd.DataFrame:
    """The table of one part. weights: `n` and others, one whole number for each mask."""
    m = len(names)
    orders = np.array(list(permutations(range(m))))
    place = np.argsort(orders, axis=1) + 1
    step = removal_steps(fails, place)
    removed = {}
    for k, w in weights.items():
        at = np.zeros((len(orders), m + 2), np.int64)
        np.add.at(at, (np.arange(len(orders))[None, :], step), w[:, None])
        removed[k] = at[:, 1 : m + 1]
    n = weights["n"]
    failing = (fails * n[:, None]).sum(0)
    only = (fails & (fails.sum(1) == 1)[:, None]).astype(np.int64).T @ n
    shapley = np.zeros(m, np.int64)
    np.add.at(shapley, orders, removed["n"])
    kept = n.sum() - np.cumsum(removed["n"], axis=1)
    out = {
        "filter_order": np.repeat(["".join(names[f] for f in o) for o in orders], m), "step": np.tile(np.arange(1, m + 1, dtype=np.int32), len(orders)),
        "kept": kept.ravel(), "removed": removed["n"].ravel(), "redundant": (failing[orders] - removed["n"]).ravel(), "unique_fails": only[orders].ravel(),
    }
    out |= {f"{k}_lost": v.ravel() for k, v in removed.items() if k != "n"}
    return pd.DataFrame(out | {"shapley": shapley[orders].ravel()})


def audit(masks: DataFrame, names: str, weights: tuple[str, ...] = ()) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, a `<weight>_lost` for each weight, shapley.

    masks: part, mask (bit i: fails names[i]), n (rows) and the named weights (whole numbers, such as the rows of a label). A row
    for each part, order and step, zeros included; no parts, no rows. Up to FILTERS filters, each named by one letter.
    """
    m = len(names)
    if not 0 < m <= FILTERS:
        raise ValueError(f"1 to {FILTERS} filters")
    cells = masks.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(w).alias(w) for w in weights))

    def table(cells: pd.DataFrame) -> pd.DataFrame:
        fails = (cells["mask"].to_numpy()[:, None] >> np.arange(m)) % 2 == 1
        out = interactions(fails, {w: cells[w].to_numpy(np.int64) for w in ("n", *weights)}, names)
        out.insert(0, "part", cells["part"].iloc[0])
        return out

    longs = ["kept", "removed", "redundant", "unique_fails", *(f"{w}_lost" for w in weights), "shapley"]
    return cells.groupBy("part").applyInPandas(table, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in longs))


def text_masks(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """doc_id, part, mask (of RULES), text_hash: one row for each row of docs, whole texts."""

    def run(batches):
        held("audit", 0, object)
        for b in slices(batches, 2, 1 << 22):
            mask, digest = [], []
            for t in b.column(2).to_pylist():
                t = t or ""
                raw = t.encode()
                words = raw.split()
                mask.append(sum(rule(t, raw, words) << i for i, (_, rule) in enumerate(RULES)))
                digest.append(blake2b(raw, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(mask, pa.int32()), pa.array(digest, pa.binary())], ["doc_id", "part", "mask", "text_hash"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, part string, mask int, text_hash binary")


def audit_filters(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The audit of RULES and of repeated texts (REPEATED: a smaller id has the same text) by `part`, with the labels good
    (quality = 1) and toxic (toxic = 1).

    Null texts count as empty, null parts as the empty string. Very long texts are read whole, one at a time. Rows repeated
    with their id are counted each; of a text, those of the least id don't fail REPEATED (null ids come last). Of several labels
    of an id any 1 counts. An empty table gives no rows. Other columns aren't read.
    """
    rows = text_masks(docs, doc_id=doc_id, text=text, part=part).groupBy("doc_id", "part", "mask", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(marks, F.col("doc_id") == F.col("__id"), "left").na.fill(0, ["good", "toxic"])
    least = F.min(F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("i"), F.col("n").alias("n")))
    per = rows.groupBy("text_hash", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), least.alias("first"))
    first = F.min(F.struct("first.x", "first.i")).over(Window.partitionBy("text_hash"))
    per = per.withColumn("whole", first)
    same = F.when(F.col("first.i").eqNullSafe(F.col("whole.i")), F.col("first.n")).otherwise(F.lit(0))
    two = F.array(F.struct(F.col("mask"), same.alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(1 << len(RULES))).alias("mask"), (F.col("n") - same).alias("n")))
    cells = per.select("part", "good", "toxic", F.inline(two)).where("n > 0").select("part", "mask", "n", *((F.col("n") * F.col(w)).alias(w) for w in ("good", "toxic")))
    return audit(cells, "".join(k for k, _ in RULES) + REPEATED, ("good", "toxic"))
