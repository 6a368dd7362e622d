"""Language, quality and toxicity: held-out accuracy, defined results on odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import language, quality, toxicity
from quillspark.llm.common import remainder

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (None, "12 ... !"), (2, ""), (5, "x" * 30000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("label", F.lit("clash"))


def test_language(spark, docs):
    table = language.profiles(docs.where(remainder("doc_id", 5) != 0)).cache()
    counts = {r.lang: r.n for r in table.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert set(counts) == {"en", "de", "fr", "es"} and all(n == language.TOP for n in counts.values())
    rows = language.predict_languages(docs.where(remainder("doc_id", 5) == 0), table).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98 and all(0 <= r.score <= 1 for r in rows)
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in language.predict_languages(odd(spark), table).collect()}
    assert [got[k][0] for k in ODD[:3]] == ["und"] * 3 and got[ODD[4]][0] != "und"
    assert language.predict_languages(odd(spark), table.limit(0)).where("lang_pred <> 'und'").count() == 0


def test_profile_counts_all_words(spark):
    df = spark.createDataFrame([("aa Ab", "x"), ("ab", "x"), (None, "x"), ("zz", None)], "text string, lang string")
    rows = {r.gram: r["rank"] for r in language.profiles(df).collect()}
    want = {"a": 4, "b": 2, "_a": 3, "ab": 2, "b_": 2, "_ab": 2, "ab_": 2, "aa": 1, "a_": 1, "_aa": 1, "aa_": 1}
    assert [g for g, _ in sorted(rows.items(), key=lambda x: x[1])] == [g for g, _ in sorted(want.items(), key=lambda x: (-x[1], x[0]))]


def test_quality(spark, docs, labels):
    model = quality.train(docs, labels)
    rows = quality.score_quality(docs, model).join(labels, "doc_id").where(remainder("doc_id", 3) == 1).collect()
    assert np.mean([(r.score >= 0.5) == r.quality for r in rows]) > 0.95
    x = model.project([quality.terms(r.text) for r in rows[:50]])
    brute = []
    for v in x:
        c = model.vectors @ v
        near = np.argsort(-c)[: quality.NEIGHBOURS]
        w = np.maximum(c[near], 0).astype(float) ** 8
        brute.append((w * model.labels[near]).sum() / w.sum())
    assert np.median(np.abs(np.array(brute) - model.scores([r.text for r in rows[:50]]))) < 1e-5  # exact votes: test_brute.py
    got = quality.score_quality(odd(spark), model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.label == "clash" for r in got)
    empty = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score_quality(odd(spark), empty).collect()} == {0.5}


def test_toxicity(spark, docs, labels):
    model = toxicity.train(docs, labels, rounds=5)
    rows = model.score(docs).join(labels, "doc_id").collect()
    assert np.mean([(r.score >= 0.7) == r.toxic for r in rows]) > 0.93
    got = model.score(odd(spark)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.label == "clash" for r in got)
    none = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in none.score(odd(spark)).collect()} == {0.0}


def test_plain_undoes_signs():
    assert [toxicity.plain(t) for t in ("L0ser!", "id10t", "tr@sh", "s*c*u*m", "Ünder-way")] == ["loser", "idiot", "trash", "scum", "ünderway"]
