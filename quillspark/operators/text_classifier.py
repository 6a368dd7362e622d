"""A softmax classifier of texts on hashed word n-grams, fitted from a labelled table and stored as a weight table.

A text's features are the distinct buckets of its words and pairs of consecutive words, each 1 / sqrt(their number), and a
constant. All of them stay in the text's row, so neither scoring nor a step of the fit shuffles texts: a step adds up the
residuals by bucket, with partial sums in each task, and exchanges at most BUCKETS sums a task. These sums (buckets times
classes) come to the driver, which takes one accelerated gradient step. Number and length of steps are fixed, so a fit is a
function of its rows.

Words are told apart without ASCII case, by ASCII blanks. Null and empty texts have the constant only.
"""

from __future__ import annotations

import string

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, STEPS, RATE, DECAY = 4096, 20, 1.0, 1e-4  # features have a norm of sqrt(2) at most, for which a RATE of 1 is stable
CLASSES = 64  # more labels than this are an error
BLANKS = r"[\x20\x09-\x0D]+"
CONSTANT = -1  # bucket of the constant


def buckets(text: Column, n: int = BUCKETS) -> Column:
    """The distinct buckets of a text's words and pairs of words: the first 8 hex digits of their MD5, modulo n."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    words = F.filter(F.split(low, BLANKS), lambda x: x != "")
    pairs = F.filter(F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)), lambda x: x.isNotNull())
    return F.array_distinct(F.transform(F.concat(words, pairs), lambda g: F.pmod(F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")))


def with_scores(rows: DataFrame, weights: np.ndarray, names: list[str]) -> DataFrame:
    """rows (with k, their buckets) with p, the probabilities of the classes in order. weights: by class and bucket, the constant last.

    The weights are one broadcast row of bounded size.
    """
    k = rows.sparkSession.createDataFrame([([[float(x) for x in w] for w in weights],)], "__w array<array<double>>")
    rows = rows.crossJoin(F.broadcast(k))  # one row
    size = F.sqrt(F.greatest(F.size("k"), F.lit(1)).cast("double"))
    constant = weights.shape[1] - 1
    logit = lambda w: F.aggregate("k", F.lit(0.0), lambda a, i: a + F.get(w, i)) / size + F.get(w, F.lit(constant))
    rows = rows.withColumn("__l", F.transform("__w", logit))
    rows = rows.withColumn("__e", F.transform("__l", lambda x: F.exp(x - F.array_max("__l"))))
    total = F.aggregate("__e", F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("p", F.transform("__e", lambda x: x / total)).drop("__w", "__l", "__e")


def fit_text_classifier(rows: DataFrame, *, text: str = "text", label: str = "label", n_buckets: int = BUCKETS, steps: int = STEPS) -> DataFrame:
    """The weight table (class, bucket, weight; bucket -1 is the constant) of labelled rows.

    Rows without label don't count, repeated rows count as often as they stand. Without labelled rows the table is empty; with
    one class its probability is 1. Other columns of rows are not read.
    """
    spark = rows.sparkSession
    data = rows.select(F.col(f"`{label}`").cast("string").alias("y"), buckets(F.col(f"`{text}`").cast("string"), n_buckets).alias("k")).where("y is not null")
    data = data.persist(StorageLevel.DISK_ONLY)
    try:
        counts = data.groupBy("y").agg(F.count(F.lit(1)).alias("n")).limit(CLASSES + 1).collect()
        if len(counts) > CLASSES:
            raise ValueError(f"more than {CLASSES} classes")
        names, total = sorted(r.y for r in counts), sum(r.n for r in counts)
        w = v = np.zeros((len(names), n_buckets + 1))
        for step in range(steps if names else 0):
            residual = F.zip_with(F.array(*(F.when(F.col("y") == c, 1.0).otherwise(0.0) for c in names)), "p", lambda y, p: y - p)
            each = with_scores(data, v, names).select("k", residual.alias("r"), F.sqrt(F.greatest(F.size("k"), F.lit(1)).cast("double")).alias("size"))
            at = F.explode(F.concat(F.col("k"), F.array(F.lit(CONSTANT)))).alias("bucket")
            one = each.select(at, "r", "size").withColumn("v", F.when(F.col("bucket") == CONSTANT, 1.0).otherwise(1 / F.col("size")))
            g = np.zeros_like(w)
            for r in one.groupBy("bucket").agg(*(F.sum(F.get("r", F.lit(j)) * F.col("v")).alias(f"g{j}") for j in range(len(names)))).collect():
                g[:, r.bucket] = r[1:]  # the constant's bucket is the last
            new = v + RATE * (g / total - DECAY * v)
            v, w = new + step / (step + 3) * (new - w), new
    finally:
        data.unpersist()
    table = [(c, k if k < n_buckets else CONSTANT, float(w[j, k])) for j, c in enumerate(names) for k in range(n_buckets + 1)]
    return spark.createDataFrame(table, "class string, bucket int, weight double")


def score_with(rows: DataFrame, weights: DataFrame, *, text: str = "text", out: str = "scores") -> DataFrame:
    """rows with `out`, a map from each class of a weight table to its probability; an empty weight table gives empty maps.

    All columns pass through, `out` replaces one of its name. Null texts count as empty; repeated rows get equal scores.
    """
    table = weights.orderBy("class", "bucket").collect()  # classes times buckets, both bounded
    names = sorted({r["class"] for r in table})
    n = 1 + max((r.bucket for r in table), default=0)
    w = np.zeros((len(names), n + 1))
    for r in table:
        w[names.index(r["class"]), r.bucket] = r.weight
    kept = [c for c in rows.columns if c != out]
    packed = rows.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), buckets(F.col(f"`{text}`").cast("string"), n).alias("k"))
    if names:
        scored = with_scores(packed, w, names).withColumn("s", F.map_from_arrays(F.array(*map(F.lit, names)), "p"))
    else:
        scored = packed.withColumn("s", F.expr("cast(map() as map<string, double>)"))
    return scored.select(*(F.col(f"row.`{c}`").alias(c) for c in kept), F.col("s").alias(out))
