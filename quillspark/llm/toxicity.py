"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned: words and word beginnings (4 to 8 letters) whose document frequency is far higher in toxic than
in other labelled texts, after common letter substitutions are undone. Features: lexicon densities and weights, the
nearness of lexicon hits to second-person words, capitals, punctuation and obfuscation rates. Trees and calibration are
fitted on separate parts of a bounded sample of labelled rows (SAMPLE at most, the first by a hash of the id).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, packed, to_table
from .quality import labelled_sample

SAMPLE = 16384
LEXICON = 2048
FEATURES = [
    "density", "weight", "top", "hits", "kinds", "near_you", "you", "capitals", "shouted", "punctuation", "exclaimed",
    "obfuscated", "stretched", "length",
]
# Second-person words in English, German, French and Spanish.
YOU = set("you your yours yourself ur u du dich dir dein deine deiner euch euer tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split())
# Signs written in place of letters.
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
TOKEN = re.compile(r"[\w@$][\w@$'*!-]*")
MIXED = re.compile(r"[^\W\d_][\d@$*!]+[^\W\d_]")
NOT_ASCII = re.compile(r"[^\x00-\x7f]")
STRETCH = re.compile(r"([^\W\d_])\1\1")


def plain(token: str) -> str:
    """A lower-case word with substitutions and inner signs undone."""
    t = token.lower().strip("'*!-_")
    if not t.isalpha():
        t = t.translate(SIGNS)
        t = "".join(c for c in t if c.isalpha())
    return t


def entries(word: str) -> list[str]:
    """The word, and its beginnings as `xxxx*`."""
    return [word, *(word[:n] + "*" for n in range(4, 9) if len(word) > n)]


def lexicon(sample: DataFrame, *, size: int = LEXICON) -> DataFrame:
    """entry, weight: log odds of entries that are typical of label 1, the strongest `size`."""

    def run(batches):
        for b in batches:
            found = [sorted({e for w in {plain(t) for t in TOKEN.findall(x or "")} for e in entries(w) if w}) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), b.column(1)], ["e", "label"])

    rows = sample.select("text", "label").mapInArrow(run, "e array<string>, label int")
    totals = sample.agg(F.sum("label").alias("n1"), F.sum(1 - F.col("label")).alias("n0")).first()
    n1, n0 = totals.n1 or 0, totals.n0 or 0
    counts = rows.select(F.explode("e").alias("entry"), "label").groupBy("entry").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    weight = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    strong = counts.where("a >= 4").withColumn("weight", weight).where("weight > 2.2")
    return strong.orderBy(F.desc(F.col("weight") * F.sqrt("a")), "entry").limit(size).select("entry", "weight")


class Featurizer:
    """Features of texts; what depends on a token alone is kept for tokens seen before."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.known = weights, {}

    def look(self, token: str) -> tuple[float, bool, int, int, bool]:
        """(lexicon weight, second person, letter substitutions, stretched letters, all capitals) of a token."""
        got = self.known.get(token)
        if got is None:
            w = plain(token)
            if len(self.known) > 1 << 17:
                self.known.clear()
            shouted = len(token) > 2 and token.isupper()
            got = self.known[token] = (max((self.weights.get(e, 0.0) for e in entries(w)), default=0.0), w in YOU, len(MIXED.findall(token)), len(STRETCH.findall(token)), shouted)
        return got

    def __call__(self, text: str | None) -> list[float]:
        text = text or ""
        tokens = TOKEN.findall(text)
        n, chars = max(1, len(tokens)), max(1, len(text))
        weights, persons, mixed, stretched, shouted = zip(*map(self.look, tokens), strict=True) if tokens else ((),) * 5
        hits = [i for i, w in enumerate(weights) if w]
        you = [i for i, y in enumerate(persons) if y] if any(persons) else []
        near = 0.0
        if hits and you:
            h, y = np.array(hits), np.array(you)
            at = np.searchsorted(y, h)
            away = np.minimum(np.abs(h - y[np.minimum(at, len(y) - 1)]), np.abs(h - y[np.maximum(at - 1, 0)]))
            near = float((1 / (1 + away)).max())
        words = [weights[i] for i in hits]
        raw = text.encode()
        capitals = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        if not text.isascii():
            capitals += sum(map(str.isupper, NOT_ASCII.findall(text)))
        marks = len(raw) - len(raw.translate(None, b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
        return [
            len(hits) / n, sum(words) / n, max(words, default=0.0), float(np.log1p(len(hits))), float(np.log1p(len({tokens[i] for i in hits}))),
            near, len(you) / n, capitals / chars, sum(shouted) / n, marks / chars,
            text.count("!") / chars, sum(mixed) / n, sum(stretched) / n, float(np.log1p(len(tokens))),
        ]


def features(docs: DataFrame, words: DataFrame, *, text: str = "text", column: str = "__features") -> DataFrame:
    """docs with `column`, the dense features in the order of FEATURES. The lexicon (LEXICON rows at most) is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast({r.entry: r.weight for r in words.collect()})

    def make():
        f = Featurizer(sent.value)
        return lambda texts: [pa.array([f(t) for t in texts], pa.list_(pa.float64()))]

    return annotate(docs, text, T.StructType([T.StructField(column, T.ArrayType(T.DoubleType()))]), make)


class Model:
    """Lexicon, trees and calibration; `constant` is the score where the sample has one label only."""

    def __init__(self, words, trees, calibration, constant=None):
        self.words, self.trees, self.calibration, self.constant = words, trees, calibration, constant

    def score(self, docs: DataFrame, *, text: str = "text", column: str = "score") -> DataFrame:
        """docs with `column`, the calibrated probability of label 1.

        Null and empty texts have features of zero; equal texts get equal scores; very long texts are read whole, one at a
        time. All rows and columns pass through, but a column of docs that has the name of `column` is replaced; nothing is
        shuffled; an empty table stays empty. Where the sample had one label only, that is every text's score."""
        if self.constant is not None:
            return docs.withColumn(column, F.lit(float(self.constant)))
        rows, back = packed(docs, text, [column])
        out = calibrated(features(rows, self.words), self.trees, self.calibration, "__score")
        return out.select(*back(), F.col("__score").alias(column))


def raw_scores(rows: DataFrame, trees) -> DataFrame:
    rows = rows.withColumn("__v", array_to_vector("__features"))
    return trees.transform(rows).withColumn("__p", vector_to_array("__prob")[1]).drop("__v", "__raw", "__prob", "__features")


def calibrated(rows: DataFrame, trees, calibration, column: str) -> DataFrame:
    out = calibration.transform(raw_scores(rows, trees)).drop("__p")
    return out.withColumn(column, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__c")))).drop("__c")


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", size: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", rounds: int = 20) -> Model:
    """Fit on labelled rows; three quarters of the sample, by a hash of the id, for lexicon and trees, the rest for calibration."""
    sample = to_table(labelled_sample(docs, labels, label, size, doc_id=doc_id, text=text), "toxicity-sample")
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4))
    seen = {r.label for r in sample.where(part != 0).select("label").distinct().collect()}
    if len(seen) < 2:
        return Model(None, None, None, next(iter(seen), 0))
    words = to_table(lexicon(sample.where(part != 0)), "lexicon")
    rows = to_table(features(sample, words).drop("text"), "toxicity-features").withColumn("label", F.col("label").cast("double"))
    gbt = GBTClassifier(featuresCol="__v", labelCol="label", predictionCol="__y", maxIter=rounds, maxDepth=3, stepSize=0.3, seed=1984)
    gbt = gbt.setProbabilityCol("__prob").setRawPredictionCol("__raw")
    trees = gbt.fit(rows.where(part != 0).withColumn("__v", array_to_vector("__features")))
    trees.setPredictionCol("")
    held = rows.where(part == 0)
    if held.isEmpty():
        held = rows
    fitted = IsotonicRegression(featuresCol="__p", labelCol="label", predictionCol="__c").fit(raw_scores(held, trees))
    return Model(words, trees, fitted)
