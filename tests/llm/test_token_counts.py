"""Token counts against the tokenizers library."""

import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

from quillspark.llm import token_counts as T  # noqa: E402

PATH = P.path("byte_bpe_50k.json")
ODD = [
    "", None, "a", "  ", " a", "a  b", "it's we're 'r 're' ''s '' 'll 'lx 'v", "x\n\n y \n", "tab\t\tz", "<|endoftext|>",
    "a<|endoftext|> b<|endoftext|>", "日本語のテキスト 123٣٤ ½ x²", "a'", "'", "'l", " 'l", "  's", "\n\n's", "a" * 5000,
    "é" * 333, "👍🏽 ok", "\x1c\x85  x", "don't   stop", "x " * 10 + "  ",
]


def expected(texts):
    tok = tokenizers.Tokenizer.from_file(PATH)
    return [len(x.ids) for x in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_odd_texts():
    assert T.count_texts(ODD, T.machine(PATH)).tolist() == expected(ODD)


def test_all_code_points():
    """Every code point counts as in the library, whatever Unicode version that has."""
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    m = T.machine(PATH)
    for at in range(0, len(codes), 4096):
        texts = [f"a{chr(c)}b 1{chr(c)}2 !{chr(c)}?  {chr(c)}'s" for c in codes[at : at + 4096]]
        assert T.count_texts(texts, m).tolist() == expected(texts), hex(codes[at])


def test_random_texts():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab' \n\tsrelvdtm1.,é日 '  ") for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    assert T.count_texts(texts, T.machine(PATH)).tolist() == expected(texts)


def test_scan_composes_maps():
    import numpy as np

    rng = np.random.default_rng(1)
    maps = rng.integers(0, 12, (37, 12)).astype(np.uint8)
    out, now = T.compose_scan(maps), np.arange(12)
    for i, m in enumerate(maps):
        now = m[now]
        assert (out[i] == now).all()


def test_whole_table(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = T.count_tokens(docs.withColumn("n_tokens", docs.n_chars), PATH).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = dict(zip(texts, expected(list(texts.values())), strict=True))
    assert {r.doc_id: r.n_tokens for r in rows} == want
    assert all(r.n_bytes == len(texts[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 1024) for r in rows)


def test_edge_tables(spark):
    rows = T.count_tokens(spark.createDataFrame([(1, None), (None, ""), (1, "a b")], "doc_id long, text string"), PATH).collect()
    assert sorted(r.n_tokens for r in rows) == [0, 0, 2]
    assert T.count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_dropped_tables_change_nothing(monkeypatch):
    monkeypatch.setattr(T, "MAX_STATES", 50)
    m = T.BpeTransducer(PATH, ids=True)
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab' \n\tsrelvdtm1.,é日 '  ") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    got = [n for at in range(0, 300, 20) for n in T.count_texts(texts[at : at + 20], m).tolist()]
    assert got == expected(texts) == [len(x) for at in range(0, 300, 20) for x in T.encode_texts(texts[at : at + 20], m)]
