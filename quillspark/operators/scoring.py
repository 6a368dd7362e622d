"""Batch scoring of texts by a pluggable scorer, loaded once a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: name, words that raise the score, lowest and highest value
LEXICON = {
    "sentiment": ("good great thanks agree nice", 0.0, 1.0), "formality": ("therefore however regarding hence moreover", 0.0, 1.0),
    "politeness": ("please thanks sorry kindly appreciate", 1.0, 5.0), "toxicity": ("stupid idiot trash loser pathetic", 0.0, 1.0), "certainty": ("certainly definitely always must never", 1.0, 5.0),
}


class LexiconScorer:
    """A deterministic scorer: the share of listed words among all words (or, as models with a limit do, the first `window`),
    doubled and cut at 1, on each scale."""

    def __init__(self, window: int | None = None):
        self.window, self.words = window, {k: (set(w.split()), a, b) for k, (w, a, b) in LEXICON.items()}

    def __call__(self, texts: pd.Series) -> pd.DataFrame:
        tokens = texts.str.lower().str.split().str[: self.window]
        return pd.DataFrame({k: [a + (b - a) * min(1.0, 2 * sum(t in w for t in ts) / max(1, len(ts))) for ts in tokens] for k, (w, a, b) in self.words.items()})


def score_texts(rows: DataFrame, make: Callable[[], Callable[[pd.Series], pd.DataFrame]] = LexiconScorer, *, text: str = "text") -> DataFrame:
    """rows with the five scores; a null text counts as empty. `make` builds the scorer in each task."""
    schema = T.StructType([*rows.schema.fields, *(T.StructField(k, T.DoubleType()) for k in LEXICON)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for b in batches:
            yield pd.concat([b, scorer(b[text].fillna("")).set_index(b.index)], axis=1)

    return rows.mapInPandas(run, schema)
