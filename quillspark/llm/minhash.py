"""Document fingerprints: one-permutation MinHash, optimally densified, packed to low-order bits.

A text's word shingles (WIDTH words, A-Z lower-cased; a shorter text is one shingle) are hashed once to 64 bits. The
top bits choose one of BINS bins, whose value is the smallest rest. An empty bin borrows from a filled one: every bin has its
own fixed pseudo-random order of all bins and takes the first filled one in it, which is what probing by a 2-universal
hash until a filled bin is met gives. The BITS low bits of each bin are packed. Two fingerprints that agree on a share
p of their bins have the estimated likeness (p - c) / (1 - c), c = 2 ** -BITS being the chance agreement of low bits.

A text without words has the empty fingerprint, like only to itself.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chosen, slices, to_table

WIDTH, BINS, BITS = 5, 256, 4
ROWS = 1 << 16  # documents in a range of ids, about, where the session's number of partitions does not make ranges smaller
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiply and shift."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=1)
def constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value of each byte, powers of an odd number, rank of every bin in each bin's order), all from a fixed seed."""
    rng = np.random.Generator(np.random.PCG64(1984))
    letters = rng.integers(0, 1 << 64, 256, np.uint64)
    power = np.cumprod(np.full(1 << 10, 0x9E3779B97F4A7C15, np.uint64))
    rank = np.argsort(rng.random((BINS, BINS)), axis=1).argsort(axis=1).astype(np.int16)
    return letters, power, rank


def shingle_hashes(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every shingle of all texts."""
    letters, power, _ = constants()
    data = [t.encode().lower().split() for t in texts]
    n_words = np.array([len(w) for w in data], np.int64)
    joined = b"".join(b"".join(w) for w in data)
    sizes = np.array([len(x) for w in data for x in w], np.int64)
    if not len(sizes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.cumsum(sizes) - sizes
    raw = np.frombuffer(joined, np.uint8)
    place = np.arange(len(raw)) - np.repeat(first, sizes)
    word = mix(np.add.reduceat(letters[raw] * power[place & 1023] + (place >> 10).astype(np.uint64), first) + sizes.astype(np.uint64))
    # shingle i: words i .. i + width - 1, or all words of a shorter text
    begin = np.cumsum(n_words) - n_words
    per = np.where(n_words > 0, np.maximum(n_words - width + 1, 1), 0)
    text = np.repeat(np.arange(len(texts)), per)
    at = np.repeat(begin, per) + np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    left = (begin + n_words)[text] - at
    h = np.zeros(len(at), np.uint64)
    for k in range(width):
        h += np.where(left > k, word[np.minimum(at + k, len(word) - 1)] * power[k], np.uint64(0))
    return mix(h), text


def fingerprints(texts: list[str], width: int = WIDTH) -> np.ndarray:
    """Low bits of every bin [text, BINS]; 255 in all bins of a text without words."""
    h, text = shingle_hashes(texts, width)
    none = np.uint64((1 << 64) - 1)
    low = np.full(len(texts) * BINS, none)
    shift = np.uint64(64 - (BINS.bit_length() - 1))
    np.minimum.at(low, text * BINS + (h >> shift).astype(np.int64), h & ((np.uint64(1) << shift) - np.uint64(1)))
    low = low.reshape(-1, BINS)
    rank = constants()[2]
    filled = low != none
    n = filled.sum(1)
    for row in np.flatnonzero((n > 0) & (n < BINS)).tolist():
        have, lack = np.flatnonzero(filled[row]), np.flatnonzero(~filled[row])
        low[row, lack] = low[row, have[rank[np.ix_(lack, have)].argmin(1)]]
    out = (low & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    out[n == 0] = 255
    return out


def packed(bins: np.ndarray) -> list[str]:
    """Hexadecimal digits, one for each bin; empty for a text without words."""
    bits = (bins[:, ::2] << BITS | bins[:, 1::2] & 15).astype(np.uint8)
    return ["" if row[0] == 255 else packed_row.tobytes().hex() for row, packed_row in zip(bins, bits, strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated resemblance of the texts behind each pair of fingerprints, corrected for chance agreement."""
    chance = 2.0**-BITS
    p = ((a == b).mean(1) - chance) / (1 - chance)
    p[(a[:, 0] == 255) != (b[:, 0] == 255)] = 0
    return np.clip(p, 0, 1)


def ranges(docs: DataFrame, rows: int) -> tuple[np.ndarray, DataFrame]:
    """(inner bounds of id ranges of about `rows` documents, descending; ids, nulls included, that fill several ranges on
    their own, with their number of ranges). Bounds are every 16th id of a sample by a hash of id and text; the driver
    holds 16 numbers for each range, and there are no more ranges than the cluster would have partitions of `rows`."""
    n = docs.count()
    parts = max(min(n, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), n // rows, 1)
    every = max(1, n // (16 * parts))
    got = docs.where(F.pmod(F.xxhash64("doc_id", "h", F.lit(3)), F.lit(every)) == 0).select(F.col("doc_id").cast("double").alias("d")).toPandas()["d"].to_numpy()
    got = np.sort(np.nan_to_num(got, nan=-np.inf))[::-1]
    cuts = got[16::16]
    ids, times = np.unique(cuts, return_counts=True)
    hot = [(None if d == -np.inf else int(d), int(k)) for d, k in zip(ids, times, strict=True) if k > 1]
    return ids, docs.sparkSession.createDataFrame(hot, "hot long, k int")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows pid, tail, doc_id, text, sorted so that each row's next document (descending doc_id, nulls last; ties by the
    hash of the text, then by text; after the last the first) follows it in its partition. Rows with tail are copies of the
    first of the next range. Ranges are dealt by one shuffle; of their first rows only ids and hashes are gathered, by Spark."""
    docs = docs.withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 1))
    bounds, hot = ranges(docs, ROWS)
    d = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))
    splits = [float("-inf"), *(float(x) for x in bounds if x != -np.inf), float("inf")]
    docs = docs.withColumn("d", d)
    docs = Bucketizer(splits=splits, inputCol="d", outputCol="b").transform(docs) if len(splits) > 2 else docs.withColumn("b", F.lit(0.0))
    docs = docs.join(F.broadcast(hot), docs.doc_id.eqNullSafe(hot.hot), "left")
    sub = F.coalesce((F.col("h") / F.lit(2.0**63) * F.col("k")).cast("int"), F.lit(0))  # of an id with several ranges: by hash
    own = F.when(F.col("k").isNotNull(), F.when(F.col("doc_id").isNull(), 2).otherwise(0)).otherwise(1)  # apart from its neighbours
    docs = docs.withColumn("range", F.struct((-F.col("b")).cast("int").alias("b"), (F.col("doc_id").isNull()).alias("null"), own.alias("own"), sub.alias("sub"))).drop("d", "b", "hot", "k")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), (-F.col("doc_id")).alias("y"), "h")).alias("m")
    heads = docs.groupBy("range").agg(first)
    w = Window.orderBy("range")  # one small row for each range
    heads = heads.select("range", "m", (F.row_number().over(w) - 1).alias("pid"), F.coalesce(F.lag("range").over(w), F.last("range").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("prior"))
    heads = to_table(heads, "id-ranges")
    order = heads.select(F.col("range").alias("prior"), F.col("pid").alias("before"))
    small = heads.join(order, "prior").select("range", "pid", "before", F.col("m.y").alias("y"), F.col("m.h").alias("first"))
    parts = max(1, heads.count())
    both = docs.join(F.broadcast(small), "range")
    is_first = (-F.col("doc_id")).eqNullSafe(F.col("y")) & (F.col("h") == F.col("first"))
    here, copy = F.struct("pid", F.lit(False).alias("tail")), F.struct(F.col("before").alias("pid"), F.lit(True).alias("tail"))
    both = both.select(F.explode(F.when(is_first, F.array(here, copy)).otherwise(F.array(here))).alias("p"), "doc_id", "h", "text")
    rows = both.select("p.pid", "p.tail", "doc_id", "text", "h").repartition(parts, "pid")
    return rows.sortWithinPartitions("pid", "tail", F.col("doc_id").desc_nulls_last(), "h", "text").drop("h")


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, n_chars, fingerprint, and, for the edited text (the last floor(n_chars / 2) characters replaced by the first
    as many of the next document), edited_sha256 and edited_fingerprint; near_edited and near_next, estimated likeness
    to the edited text and to the next document.

    The next document is the next in descending doc_id (nulls last; ties by a hash of the text); the last is followed by
    the first. Null texts are empty; a single document follows itself; repeated rows are kept, and of equal rows each is
    followed by the next of them; other columns are ignored whatever their names; very long texts are read whole, one at a
    time; an empty table gives no rows.
    """

    def run(batches):
        held: list[tuple] = []
        for b in slices(batches, 3, 1 << 21):
            rows = held + list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            held = rows[-1:]
            pairs = [(i, i + 1) for i, r in enumerate(rows[:-1]) if not r[1]]
            if not pairs:
                continue
            texts = [r[3] or "" for r in rows]
            changed = [edited(texts[i], texts[j]) for i, j in pairs]
            own, new = fingerprints(texts, width), fingerprints(changed, width)
            i, j = map(list, zip(*pairs, strict=True))
            names = packed(own)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[k][2] for k in i], pa.int64()), pa.array([len(texts[k]) for k in i], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array([names[k] for k in i]), pa.array(packed(new)),
                    pa.array(likeness(own[i], new)), pa.array(likeness(own[i], own[j])),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return with_next(chosen(docs, doc_id, text)).mapInArrow(run, OUT)
