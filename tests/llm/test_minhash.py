"""Fingerprints and the edited text of each document against brute force."""

import hashlib
import random

import numpy as np

from quillspark.llm import minhash as M


def shingles(t, k=5):
    w = t.encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_likeness_follows_jaccard():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(3000)]
    errors = []
    for share in (0.0, 0.05, 0.2, 0.5, 0.8, 0.95, 1.0):
        for _ in range(8):
            a = [rng.choice(vocab) for _ in range(rng.choice([40, 300, 900]))]
            b = a[: int(len(a) * share)] + [rng.choice(vocab) for _ in range(len(a) - int(len(a) * share))]
            x, y = " ".join(a), " ".join(b)
            s, t = shingles(x), shingles(y)
            f = M.fingerprints([x, y])
            errors.append(M.likeness(f[:1], f[1:])[0] - len(s & t) / len(s | t))
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.25


def test_shingle_hashes_do_not_depend_on_the_batch():
    texts = ["", "one", "a b c d e f g", "A  B\nc D e f g", "x " * 3000, "é ü", "y" * 5000]
    h, t = M.shingle_hashes(texts, 5)
    for i, x in enumerate(texts):
        assert (h[t == i] == M.shingle_hashes([x], 5)[0]).all()
        assert len(set(h[t == i].tolist())) == len(shingles(x))
    f = M.fingerprints(texts)
    assert (f[2] == f[3]).all() and M.packed(f)[0] == "" and len(M.packed(f)[1]) == M.BINS


def check(rows, docs):
    docs = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), d[1] is not None, d[1] or ""))
    want = {}
    for i, (d, t) in enumerate(docs):
        nxt, t = docs[(i + 1) % len(docs)][1] or "", t or ""
        e = M.edited(t, nxt)
        f = M.fingerprints([t, e, nxt])
        want.setdefault((d, t), []).append((len(t), hashlib.sha256(e.encode()).hexdigest(), *M.packed(f)[:2], M.likeness(f[:1], f[1:2])[0], M.likeness(f[:1], f[2:])[0]))
    got = sorted((r.doc_id or -1, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in rows)
    assert got == sorted((d or -1, *x) for (d, _), v in want.items() for x in v)


def test_whole_table(spark, sf_small, monkeypatch):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    for rows in (4096, 30):
        monkeypatch.setattr(M, "ROWS", rows)
        check(M.fingerprint_documents(docs.withColumn("pid", docs.lang)).collect(), plain)


def test_edge_tables(spark):
    for plain in ([], [(1, "a b")], [(None, None), (3, ""), (3, "x"), (3, "x"), (7, "a b c d e f g h"), (-2, "q")]):
        check(M.fingerprint_documents(spark.createDataFrame(plain, "doc_id long, text string")).collect(), plain)
