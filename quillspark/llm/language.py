"""Language identification by rank-order profiles of character n-grams.

Every word (a run of letters, lower-cased, with a border mark at both ends) gives its n-grams of 1 to 3 characters. A
language's profile is the TOP most frequent n-grams of its training texts in order. A document's own most frequent
n-grams are compared to each profile by the out-of-place distance: the sum of the differences of ranks, TOP for an n-gram
that a profile lacks. Counts cover all training texts: they are summed in each task and then by Spark.

An n-gram is kept as one number of three 21-bit code points (missing ones are 0), so that counting is sorting.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, slices

TOP = 400
LANGUAGES = 2000  # profiles that are broadcast, at most
BORDER = ord("_")
HELD = 1 << 20  # counts that a task holds before it adds them up


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-grams in order, counts) of a text's words."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = letters()[codes]
    after = np.append(False, letter)[:-1]
    c = np.where(letter, codes, BORDER)[letter | after].astype(np.int64)
    c = np.concatenate([[BORDER], c, [BORDER]])
    word = c != BORDER
    first, second = c << 42, c << 21
    one = first[word]
    two = (first[:-1] | second[1:])[word[:-1] | word[1:]]
    three = (first[:-2] | second[1:-1] | c[2:])[word[1:-1]]
    return np.unique(np.concatenate([one, two, three]), return_counts=True)


def spell(key: int) -> str:
    return "".join(chr(x) for x in (key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF) if x)


def number(gram: str) -> int:
    a, b, c = (ord(x) for x in gram.ljust(3, "\0"))
    return a << 42 | b << 21 | c


def profiles(docs: DataFrame, *, text: str = "text", lang: str = "lang", top: int = TOP) -> DataFrame:
    """lang, gram, rank (from 0) of the `top` most frequent n-grams of each language; ties in the order of the n-grams.
    Rows with null text or lang are left out."""

    def run(batches):
        held: dict[str, list] = {}

        def add_up() -> None:
            for k, parts in held.items():
                keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                held[k] = [(keys, np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64))]

        for b in slices(batches, 1, 1 << 22):
            texts: dict[str, list[str]] = {}
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                texts.setdefault(k, []).append(t)
            for k, ts in texts.items():
                held.setdefault(k, []).append(grams("\n".join(ts)))
            if sum(len(p[0]) for parts in held.values() for p in parts[1:]) > HELD:
                add_up()
        add_up()
        for k, [(keys, n)] in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(keys), pa.string()), pa.array(keys), pa.array(n)], ["lang", "key", "n"])

    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))
    best = counts.withColumn("place", place).where(F.col("place") <= top).withColumn("rank", F.col("place") - 1)  # each task keeps its first `top` only
    parts = (F.shiftright("key", 42), F.shiftright("key", 21).bitwiseAND(F.lit(0x1FFFFF)), F.col("key").bitwiseAND(F.lit(0x1FFFFF)))
    gram = F.concat(*(F.when(p > 0, F.decode(F.unhex(F.lpad(F.hex(p), 8, "0")), "UTF-32")).otherwise("") for p in parts))
    return best.select("lang", gram.alias("gram"), "rank")


class Ranker:
    """Out-of-place distances of texts to profiles."""

    def __init__(self, table: list[tuple[str, str, int]], top: int):
        self.top, self.langs = top, sorted({k for k, _, _ in table})
        self.keys = np.array(sorted({number(g) for _, g, _ in table}), np.int64)
        self.rank = np.full((len(self.keys) + 1, len(self.langs)), -1)
        for k, g, r in table:
            self.rank[np.searchsorted(self.keys, number(g)), self.langs.index(k)] = r

    def predict(self, text: str | None) -> tuple[str, float]:
        keys, n = grams(text) if text else (self.keys[:0], None)
        if not len(keys) or not self.langs:
            return "und", 0.0
        own = keys[np.argsort(-n, kind="stable")[: self.top]]
        at = np.searchsorted(self.keys, own)
        at[self.keys[np.minimum(at, len(self.keys) - 1)] != own] = len(self.keys)  # the row of unknown n-grams
        ranks = self.rank[at]
        away = np.where(ranks < 0, self.top, np.abs(ranks - np.arange(len(own))[:, None])).sum(0)
        best = int(away.argmin())
        return self.langs[best], 1 - float(away[best]) / (self.top * len(own))


def predict_languages(docs: DataFrame, table: DataFrame, *, text: str = "text", top: int = TOP) -> DataFrame:
    """docs with lang_pred and score (1 - distance / the largest possible, 0 to 1).

    `und` with score 0 where a text is null or has no letter, or no profile was learned. Equal distances go to the first
    language by name. Repeated rows get equal results; very long texts are read whole, one at a time; columns of docs named
    lang_pred or score are replaced, all others pass through; an empty table stays empty. The profiles (top rows a
    language) are sent to all tasks; more than LANGUAGES of them are refused.
    """
    learned = [tuple(r) for r in table.select("lang", "gram", "rank").limit(LANGUAGES * top + 1).collect()]
    if len(learned) > LANGUAGES * top:
        raise ValueError(f"profiles of more than {LANGUAGES} languages: `lang` does not seem to hold languages")
    sent = docs.sparkSession.sparkContext.broadcast(learned)

    def make():
        ranker = Ranker(sent.value, top)

        def f(texts):
            got = [ranker.predict(t) for t in texts]
            return [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]

        return f

    return annotate(docs, text, T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]), make)
