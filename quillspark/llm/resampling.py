"""Importance resampling to a target distribution over hashed n-grams.

A text is scanned once: ASCII letters are lowered and every run of separators becomes one space, both in one table lookup of
its bytes; an overlapped regular expression, bounded on both sides, then gives a match at each word with the spans of all
n-grams that begin there, whose CRC-32 are counted by bucket. The bucket numbers of each text are written as 16-bit numbers,
so that corpus counts and weights need no second scan.

A text's weight is the floored mean, over its n-grams, of the log ratio of target and corpus frequency of the n-gram's
bucket. Gumbel noise from a hash of the id makes the highest sums a draw without replacement. The draw's size is known from
the counts, its lowest score and the ranks before each score from the histogram of scores, so only documents that may
be drawn are exchanged, by score.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST, held, slices, to_table

_WORD = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_LOWER = [c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)]
TABLE = bytes(c if c in _WORD else 0x20 for c in _LOWER)


def collapsed(text: str | None) -> bytes:
    """Lower-cased (A-Z only) words of a text, with one space between."""
    return b" ".join((text or "").encode().translate(TABLE).split())


def scanner(n: int) -> regex.Pattern:
    """Matches at each word; group k is the k-th word of the n-gram that begins there, with the space before it."""
    return regex.compile(rb"(?<![^ ])([^ ]+)" + rb"( [^ ]+)?" * (n - 1) + rb"(?![^ ])")


def spans(text: str | None, n: int) -> list[tuple[int, int]]:
    """(start, end) in the collapsed text of all runs of 1 to n words, by start, then length."""
    found = scanner(n).finditer(collapsed(text), overlapped=True)
    return [(m.start(), m.end(k)) for m in found for k in range(1, n + 1) if m.end(k) >= 0]


def feature_buckets(text: str | None, pattern: regex.Pattern, buckets: int) -> tuple[int, np.ndarray]:
    """(number of words, buckets of all n-grams). The CRC of an n-gram goes on from that of the n-gram one word shorter."""
    out: list[int] = []
    put, n_words = out.append, 0
    if pattern.groups == 2:
        for m in pattern.finditer(collapsed(text), overlapped=True):
            n_words += 1
            h = crc32(m[1])
            put(h)
            if m[2]:
                put(crc32(m[2], h))
    else:
        for m in pattern.finditer(collapsed(text), overlapped=True):
            n_words += 1
            h = 0
            for word in m.groups():
                if not word:
                    break
                h = crc32(word, h)
                put(h)
    return n_words, (np.array(out, np.uint32) % buckets).astype(np.uint16)


def features(docs: DataFrame, n: int, buckets: int, *, doc_id: str, text: str) -> DataFrame:
    """doc_id, n_words, n_features, features (16-bit bucket numbers as bytes)."""

    def run(batches):
        held("resampling", 0, object)
        pattern = scanner(n)
        for b in slices(batches, 1, 1 << 20):
            got = [feature_buckets(t, pattern, buckets) for t in b.column(1).to_pylist()]
            cols = [b.column(0), pa.array([w for w, _ in got], pa.int64()), pa.array([len(f) for _, f in got], pa.int64()), pa.array([f.tobytes() for _, f in got], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_features", "features"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, features binary")


def bucket_counts(scanned: DataFrame, buckets: int) -> np.ndarray:
    """N-grams of all rows by bucket; a task sums its own up first."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for f in b.column(0):
                total += np.bincount(np.frombuffer(f.as_buffer(), np.uint16), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in scanned.select("features").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored log ratios, in thousandths, of smoothed target and corpus frequencies."""
    all_s, all_t, k = int(corpus.sum()), int(target.sum()), len(corpus)
    ratio = (float(t + 1) * float(all_s + k) / (float(s + 1) * float(all_t + k)) for s, t in zip(corpus.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def importance_resample(
    docs: DataFrame, target: DataFrame, *, n: int = 2, buckets: int = 10_000, least_words: int = 20, percent: int = 25, seed: int = 7, doc_id: str = "doc_id", text: str = "text", target_text: str = "text"
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of docs; rank is null for rows that aren't drawn.

    Null, empty and other texts without words have no features and weight 0. Very long texts are scanned whole, one at a time.
    Repeated rows count each, have one score and different ranks; ties go to the smaller id, nulls last (a null id is
    hashed as the empty text). An empty table gives no rows; an empty target is uniform over the buckets. Other columns
    aren't read. `buckets` is at most 65,536.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must lie in 1 .. 65536")
    scanned = to_table(features(docs, n, buckets, doc_id=doc_id, text=text), "resample-features")
    wanted = features(target.withColumn("__id", F.lit(0)), n, buckets, doc_id="__id", text=target_text)
    gain = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(scanned, buckets), bucket_counts(wanted, buckets)))

    def weigh(batches):
        for b in batches:
            got = [np.frombuffer(f.as_buffer(), np.uint16) for f in b.column(3)]
            weight = [int(gain.value[f].sum()) // len(f) if len(f) else 0 for f in got]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    rows = scanned.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = to_table(rows.withColumn("score", F.col("weight") + noise), "resample-scores")
    return with_ranks(scored, F.col("n_words") >= least_words, percent)


def with_ranks(scored: DataFrame, eligible, percent: int) -> DataFrame:
    """scored with rank: 1, 2, .. of the highest `percent` of the eligible rows."""
    per = scored.where(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    # Distinct whole scores in thousandths of a logarithm: they span a few 100,000 values however many rows there are
    counts = sorted(((r.score, r.n) for r in per.collect()), reverse=True)
    size = sum(n for _, n in counts) * percent // 100
    before, at = [], 0
    for score, n in counts:
        if at >= size:
            break
        before.append((score, at))
        at += n
    spark = scored.sparkSession
    if not before:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    lowest = before[-1][0]
    first = spark.createDataFrame(before, "s long, first long")
    maybe = eligible & (F.col("score") >= lowest)
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight", "n_words")
    top = scored.where(maybe).withColumn("place", F.row_number().over(order))
    top = top.join(F.broadcast(first) if len(before) <= BROADCAST else first, F.col("score") == F.col("s")).withColumn("rank", F.col("first") + F.col("place"))
    top = top.withColumn("rank", F.when(F.col("rank") <= size, F.col("rank")).cast("long"))
    rest = scored.where(~F.coalesce(maybe, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return top.select(*scored.columns, "rank").unionByName(rest)


def drawn(docs: DataFrame, ranked: DataFrame, *, doc_id: str = "doc_id") -> DataFrame:
    """The drawn documents with all their columns. Ids must be unique and not null."""
    ids = ranked.where("rank is not null").select(F.col("doc_id").alias("__id"))
    return docs.join(ids, F.col(f"`{doc_id}`").cast("long") == F.col("__id"), "left_semi")
