"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A text's terms describe its form in any language: the shape of each token (runs of capitals, small letters, digits and
signs; a long shape is cut into pieces, so that every character counts), repeated tokens, repeated runs of three tokens,
repeated lines, and distinct tokens in windows of WINDOW. Weights are the logarithm of the
relative frequency times the inverse document frequency. A truncated singular value decomposition of a bounded sample
of labelled texts (SAMPLE rows at most, the first by a hash of the id) gives the latent space; the sample's labelled
vectors are broadcast. Every text is projected, its cosines to all labelled vectors are computed exactly, in blocks,
and the labels of the nearest vote with their similarity as weight.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, remainder

SAMPLE = 4096
TERMS, DIMENSIONS, NEIGHBOURS = 1024, 48, 15
PIECE, WINDOW = 12, 200
WEIGHT, BASIS, UNIT = 16, 18, 17  # binary digits of weights, of the latent space's entries, of vectors


class Classes(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        out = self[code] = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isnumeric() else c
        return out


_classes, _shapes = Classes(), {}
LIKE = re.compile(r"([Aa0])\1+")
SIGNS = re.compile(r"([^Aa0])\1{3,}")


def shapes(token: str) -> tuple[tuple[str, ...], int]:
    """(the token's shape in pieces of PIECE characters, signs beyond the third of a run). Runs of capitals, small letters
    and digits are one character each; of a run of like signs three stay in the shape and the others are counted."""
    known = _shapes.get(token)
    if known is None:
        plain = token.translate(_classes)
        whole = LIKE.sub(r"\1", plain)
        short = SIGNS.sub(r"\1\1\1", whole)
        if len(_shapes) > 1 << 15:
            _shapes.clear()
        known = (tuple(short[i : i + PIECE] for i in range(0, len(short), PIECE)), len(whole) - len(short))
        if len(token) <= 64:
            _shapes[token] = known
    return known


def terms(text: str | None) -> Counter:
    """Terms of a whole text and how often each occurs; `#` holds the number of tokens."""
    tokens = (text or "").split()
    if not tokens:
        return Counter({"#": 0})
    got = [shapes(t) for t in tokens]
    out = Counter(piece for pieces, _ in got for piece in pieces)
    out["#signs"] = sum(more for _, more in got)
    out["#same"] = sum(a == b for a, b in zip(tokens, tokens[1:], strict=False))
    runs = list(zip(tokens, tokens[1:], tokens[2:], strict=False))
    out["#run"] = len(runs) - len(set(runs))
    lines = [x for x in text.split("\n") if x.strip()]
    out["#lines"], out["#line"] = len(lines), len(lines) - len(set(lines))
    out["#kinds"] = sum(len(set(tokens[i : i + WINDOW])) for i in range(0, len(tokens), WINDOW))
    n = len(tokens)
    for name, share in (("same", out["#same"] / n), ("run", out["#run"] / n), ("line", out["#line"] / max(1, len(lines)))):
        for step in (0.05, 0.2, 0.5):
            if share > step:
                out[f"#{name}>{step}"] = n
    out["#"] = n
    return out


@dataclass
class Model:
    """Vocabulary, weights and latent space, with the labelled vectors; `share` is the share of label 1 in the sample."""

    number: dict[str, int]
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    share: float

    def weights(self, rows: list[Counter]) -> np.ndarray:
        """Whole numbers, in units of 2**-WEIGHT."""
        out = np.zeros((len(rows), len(self.number)))
        for i, row in enumerate(rows):
            n = row["#"]
            for t, c in row.items():
                j = self.number.get(t)
                if j is not None and c:
                    out[i, j] = c / n
        return np.rint(np.log1p(1000 * out, out=out) * self.idf * 2**WEIGHT)

    def project(self, rows: list[Counter]) -> np.ndarray:
        """Vectors of length 1, as whole numbers in units of 2**-UNIT. Every sum on the way is one of whole numbers below
        2**53, so it is exact and a vector is a function of its text, however texts are put into blocks."""
        x = self.weights(rows) @ self.basis
        _, exponent = np.frexp(np.abs(x).max(axis=1, initial=0, keepdims=True))
        x = np.rint(np.ldexp(x, UNIT + 4 - exponent))
        return np.rint(x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1) * 2**UNIT)

    def scores(self, texts: list[str | None], block: int = 256) -> np.ndarray:
        """The nearest are the NEIGHBOURS highest cosines, of equal ones those of the first vectors."""
        out = np.full(len(texts), self.share)
        n = len(self.labels)
        k = min(NEIGHBOURS, n)
        for at in range(0, len(texts) if k else 0, block):
            x = self.project([terms(t) for t in texts[at : at + block]])
            key = (x @ self.vectors.T) * n - np.arange(n)
            near = np.sort(np.argpartition(-key, k - 1, axis=1)[:, :k], axis=1)
            cosine = (np.take_along_axis(key, near, 1) + near) / n / 4**UNIT
            w = np.maximum(cosine, 0) ** 8
            total = w.sum(1)
            some = total > 1e-12
            out[at : at + block][some] = (w * self.labels[near]).sum(1)[some] / total[some]
        return np.clip(out, 0, 1)


def fit(rows: list[tuple[Counter, int]]) -> Model:
    df = Counter(t for row, _ in rows for t, c in row.items() if c and t != "#")
    kept = sorted(sorted((t for t, n in df.items() if n >= 3), key=lambda t: (-df[t], t))[:TERMS])
    labels = np.array([y for _, y in rows], np.float64)
    share = float(labels.mean()) if len(rows) else 0.5
    model = Model({t: i for i, t in enumerate(kept)}, np.ones(len(kept)), np.zeros((len(kept), 1)), np.zeros((0, 1)), labels[:0], share)
    if not kept:
        return model
    model.idf = np.log((1 + len(rows)) / (1 + np.array([df[t] for t in kept]))) + 0.1
    x = model.weights([r for r, _ in rows]) / 2**WEIGHT
    values, basis = np.linalg.eigh(x.T @ x)
    model.basis = np.rint(np.ascontiguousarray(basis[:, ::-1][:, :DIMENSIONS]) * 2**BASIS)
    model.vectors, model.labels = model.project([r for r, _ in rows]), labels
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, size: int, *, doc_id: str = "doc_id", text: str = "text", skip: int = 1, modulus: int = 3) -> DataFrame:
    """doc_id, text, label of at most `size` labelled rows (the first by a hash of the id) whose crc32 remainder isn't `skip`."""
    rows = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and __id is not null")
    rows = rows.where(remainder("__id", modulus) != skip).orderBy(F.xxhash64("__id"), "__id", "label").limit(size)
    some = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return some.join(F.broadcast(rows), some.doc_id == rows["__id"]).select("doc_id", "text", "label")


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", size: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Model:
    """A model of labels 0 and 1. Only `size` labelled texts' term counts come to the driver."""

    def run(batches):
        for b in batches:
            got = [terms(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(g) for g in got], pa.list_(pa.string())), pa.array([list(g.values()) for g in got], pa.list_(pa.int64())), b.column(2)], ["doc_id", "t", "n", "label"])

    rows = labelled_sample(docs, labels, label, size, doc_id=doc_id, text=text).mapInArrow(run, "doc_id long, t array<string>, n array<long>, label int").collect()
    rows.sort(key=lambda r: (r.doc_id, r.label))
    return fit([(Counter(dict(zip(r.t, r.n, strict=True))), r.label) for r in rows])


def score_quality(docs: DataFrame, model: Model, *, text: str = "text", column: str = "score") -> DataFrame:
    """docs with `column`: the weighted vote for label 1, 0 to 1.

    Null, empty and blank texts, and texts that share no term with the sample, get the sample's share of label 1
    (0.5 if nothing was learned). All rows and columns pass through; nothing is shuffled. A score is a
    function of the text alone: equal texts get equal scores however the table is partitioned. Very long texts are read whole, one at a time. A column of docs that has the name
    of `column` is replaced; an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda texts: [pa.array(sent.value.scores(texts), pa.float64())]

    return annotate(docs, text, T.StructType([T.StructField(column, T.DoubleType())]), make)
