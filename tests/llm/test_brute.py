"""Operators that SQL cannot express against plain versions, written from their descriptions with Python's own numbers."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import language, minhash, quality, toxicity

WORDS = "the of and a you your STUPID idi0t Über straße niño qu'est-ce 12 3.5 !!! ---- ... (x) ¿qué? line".split()


def texts(seed, n, most=60):
    rng = random.Random(seed)
    return ["", " \n", *(" ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "\n"]) for _ in range(rng.randint(1, most))) for _ in range(n))]


def test_quality_votes():
    """Exact cosines to every labelled vector, the nearest vote with the eighth power of their similarity."""
    rows = [(quality.terms(t), i % 3 > 0) for i, t in enumerate(texts(1, 80))]
    m = quality.fit([(r, int(y)) for r, y in rows])
    asked = texts(2, 40)
    got = m.scores(asked)
    unit = 2.0**quality.UNIT
    x, some = m.project([quality.terms(t) for t in asked]) / unit, 0
    for v, score in zip(x, got, strict=True):
        near = sorted(((float(np.dot(v, u / unit)), y) for u, y in zip(m.vectors, m.labels, strict=True)), reverse=True)
        last, after = near[quality.NEIGHBOURS - 1][0], near[quality.NEIGHBOURS][0]
        weight = [max(c, 0.0) ** 8 for c, _ in near[: quality.NEIGHBOURS]]
        if last - after > 1e-6 and sum(weight) > 1e-9:
            some += 1
            assert score == pytest.approx(sum(w * y for w, (_, y) in zip(weight, near)) / sum(weight), abs=1e-5)
    assert some > 10


def test_quality_is_a_function_of_the_text():
    """Whatever else is in the block and wherever ties fall: the same bits."""
    rows = [(quality.terms(t), i % 3 % 2) for i, t in enumerate(texts(1, 60) * 2)]
    m = quality.fit(rows)
    asked = texts(2, 90) * 2
    alone = [float(m.scores([t])[0]) for t in asked]
    for block in (1, 7, 64, 256):
        assert m.scores(asked, block).tolist() == alone
    assert m.scores(asked[::-1]).tolist() == alone[::-1]


def test_quality_whatever_the_partitions(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
    a, b = ({r.doc_id: r.score for r in quality.score_quality(docs.select("doc_id", "text").repartition(n), model).collect()} for n in (3, 7))
    assert a == b


def test_quality_reads_whole_texts():
    """What stands at the end of a long token or of a long text changes the terms."""
    long = "a1" * 400
    assert quality.terms(long) != quality.terms(long + "B") != quality.terms(long + "Bc-")
    assert quality.terms("!" * 9)["#signs"] == 6 and quality.terms("x " * 5000)["#kinds"] == 25
    whole = " ".join(f"w{i}" for i in range(999))
    assert quality.terms(whole)["#kinds"] == 999 and quality.terms(whole + " end.") != quality.terms(whole)


def plain_fingerprint(text, width):
    mask, odd = (1 << 64) - 1, 0x9E3779B97F4A7C15
    letters, _, rank = minhash.constants()

    def mix(x):
        x = ((x ^ x >> 33) * 0xFF51AFD7ED558CCD) & mask
        x = ((x ^ x >> 33) * 0xC4CEB9FE1A85EC53) & mask
        return x ^ x >> 33

    word = [mix((sum(int(letters[b]) * pow(odd, i + 1, 1 << 64) for i, b in enumerate(w)) + len(w)) & mask) for w in text.encode().lower().split()]
    if not word:
        return None
    bins = {}
    for i in range(max(1, len(word) - width + 1)):
        h = mix(sum(h * pow(odd, k + 1, 1 << 64) for k, h in enumerate(word[i : i + width])) & mask)
        b, rest = h >> 56, h & ((1 << 56) - 1)
        bins[b] = min(rest, bins.get(b, rest))
    return [bins[b if b in bins else min(bins, key=lambda x: rank[b, x])] & 15 for b in range(minhash.BINS)]


def test_minhash_bins_and_densification():
    some = texts(3, 12, 700)
    got = minhash.fingerprints(some)
    for t, row in zip(some, got, strict=True):
        want = plain_fingerprint(t, minhash.WIDTH)
        assert row.tolist() == (want or [255] * minhash.BINS)
    pairs = [(i, j) for i in range(len(some)) for j in range(i)]
    for (i, j), like in zip(pairs, minhash.likeness(*(got[[p[k] for p in pairs]] for k in (0, 1))), strict=True):
        if (got[i][0] == 255) != (got[j][0] == 255):
            assert like == 0
        else:
            p = sum(a == b for a, b in zip(got[i], got[j])) / minhash.BINS
            assert like == pytest.approx(min(1, max(0, (p - 1 / 16) / (15 / 16))))


def plain_grams(text):
    out = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        w = f"_{w}_"
        out.update(w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1) if w[i : i + n] != "_")
    return out


def test_language_distance():
    """Ranks by frequency, ties in the order of the n-grams; the sum of rank differences, `top` for a missing n-gram."""
    top, order = 50, lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], language.number(x[0])))][:50]
    profiles = {"en": order(plain_grams("the of and that with you the your stupid line")), "de": order(plain_grams("Über die Straße und der Weg")), "es": order(plain_grams("¿qué niño de la línea"))}
    ranker = language.Ranker([(k, g, i) for k, gs in profiles.items() for i, g in enumerate(gs)], top)
    for t in texts(4, 60):
        own = order(plain_grams(t))
        got = ranker.predict(t)
        if not own:
            assert got == ("und", 0.0)
            continue
        away = {k: sum(abs(i - gs.index(g)) if g in gs else top for i, g in enumerate(own)) for k, gs in profiles.items()}
        best = min(sorted(away), key=away.get)
        assert got == (best, pytest.approx(1 - away[best] / (top * len(own))))
    assert language.Ranker([("b", "a", 0), ("a", "a", 0)], top).predict("a")[0] == "a"


def test_toxicity_features():
    weights = {"stupid": 2.5, "idio*": 3.0, "lin*": 1.0}
    f = toxicity.Featurizer(weights)
    for t in texts(5, 60):
        got = dict(zip(toxicity.FEATURES, f(t), strict=True))
        tokens = toxicity.TOKEN.findall(t)
        plain = [toxicity.plain(x) for x in tokens]
        w = [max([weights.get(e, 0.0) for e in [p, *(p[:n] + "*" for n in range(4, 9) if len(p) > n)]]) for p in plain]
        hits, you = [i for i, x in enumerate(w) if x], [i for i, p in enumerate(plain) if p in toxicity.YOU]
        n, chars = max(1, len(tokens)), max(1, len(t))
        want = {
            "density": len(hits) / n, "weight": sum(w) / n, "top": max(w, default=0), "hits": math.log1p(len(hits)), "kinds": math.log1p(len({tokens[i] for i in hits})),
            "near_you": max((1 / (1 + abs(i - j)) for i in hits for j in you), default=0), "you": len(you) / n, "capitals": sum(c.isupper() for c in t) / chars,
            "shouted": sum(len(x) > 2 and x.isupper() for x in tokens) / n, "punctuation": sum(c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for c in t) / chars, "exclaimed": t.count("!") / chars, "length": math.log1p(len(tokens)),
        }
        assert {k: got[k] for k in want} == pytest.approx(want)


def test_calibration_is_isotonic(spark):
    """The calibration is the least-squares non-decreasing fit: pooled neighbours."""
    from pyspark.ml.regression import IsotonicRegression

    rng = random.Random(6)
    rows = sorted((round(rng.random(), 2), float(rng.random() < 0.4)) for _ in range(80))
    per = {p: [y for q, y in rows if q == p] for p, _ in rows}
    pools = []
    for p in sorted(per):
        pools.append([sum(per[p]), len(per[p]), [p]])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, n, ps = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2] + ps]
    want = {p: s / n for s, n, ps in pools for p in ps}
    df = spark.createDataFrame(rows, "__p double, label double")
    fitted = IsotonicRegression(featuresCol="__p", labelCol="label", predictionCol="__c").fit(df)
    assert {r["__p"]: r["__c"] for r in fitted.transform(df).collect()} == pytest.approx(want, abs=1e-9)
