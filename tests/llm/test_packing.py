"""Packing: every id once, sequences gapless and nearly full, ids as the library gives them."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

from quillspark.llm import packing as K  # noqa: E402
from quillspark.llm import token_counts as T  # noqa: E402

from .test_token_counts import ODD, PATH  # noqa: E402


def test_ids_of_odd_texts():
    tok = tokenizers.Tokenizer.from_file(PATH)
    want = [x.ids for x in tok.encode_batch([t or "" for t in ODD], add_special_tokens=False)]
    assert [x.tolist() for x in T.encode_texts(ODD, T.machine(PATH, ids=True))] == want


def test_tournament_is_first_fit():
    rng = np.random.default_rng(5)
    tree, plain = K.Tournament(60, 100), [100] * 60
    for n in rng.integers(1, 90, 50).tolist():
        b = tree.first(n)
        assert b == next(i for i, free in enumerate(plain) if free >= n)
        tree.take(b, n)
        plain[b] -= n


@pytest.mark.parametrize("lengths", [[], [1], [2048], [2049, 1, 1, 5000], list(range(1, 300)), [1500] * 40])
def test_pack(lengths):
    out, seen = K.pack(lengths, 2048), defaultdict(list)
    for seq in out:
        assert sum(n for _, _, n in seq) <= 2048
        for d, s, n in seq:
            seen[d].append((s, n))
    for d, n in enumerate(lengths):
        at = 0
        for s, k in sorted(seen[d]):
            assert s == at
            at += k
        assert at == n
    assert len(out) == -(-sum(lengths) // 2048)


def test_whole_table(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = K.digests(K.pack_documents(docs.withColumn("ids", docs.lang), PATH)).collect()
    tok = tokenizers.Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = {d: [*tok.encode(t, add_special_tokens=False).ids, 1] for d, t in texts.items()}
    seqs = defaultdict(list)
    for r in rows:
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(piece) == r.length and zlib.crc32(piece.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        seqs[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for pieces in seqs.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n


def test_edge_tables(spark):
    df = spark.createDataFrame([(1, None), (None, ""), (1, "a b"), (1, "a b")], "doc_id long, text string")
    rows = K.pack_documents(df, PATH).collect()
    assert sorted(r.doc_tokens for r in rows) == [1, 1, 3, 3] and len({r.sequence_id for r in rows}) == 1
    assert K.pack_documents(df.limit(0), PATH).count() == 0
