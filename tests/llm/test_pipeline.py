"""The pipeline against a plain version of every stage, each on its own input."""

import corpus_pipeline as C
import numpy as np
import pytest
from quillspark.llm import pii
from quillspark.llm.queries import KEY

from .test_decontamination import brute as hits
from .test_jaccard import brute


@pytest.fixture(scope="module")
def chain(spark, sf_small):
    docs, out = spark.read.parquet(f"{sf_small}/documents.parquet").cache(), []
    for _, stage in C.STAGES:
        nxt = stage(spark, docs, sf_small).cache()
        out.append((docs, nxt))
        docs = nxt
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_filters_keep_rows_whole(chain):
    for before, after in chain[:3]:
        old = rows(before)
        assert after.columns == before.columns and after.count() == len(rows(after))
        assert all(old[d] == r for d, r in rows(after).items())


def test_quality(chain, spark, sf_small):
    kept = rows(chain[0][1])
    labels = [r for r in spark.read.parquet(f"{sf_small}/labels.parquet").collect()]
    assert sum((r.doc_id in kept) == r.quality for r in labels) >= 0.9 * len(labels)


def test_near_dedup(chain):
    """The stage's rule is five words and a similarity of 0.8, not op5's three words and three bits."""
    assert set(rows(chain[1][1])) == brute({d: r.text for d, r in rows(chain[1][0]).items()})


def test_decontamination(chain, spark, sf_small):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    assert set(rows(chain[2][1])) == {d for d, r in rows(chain[2][0]).items() if not hits(r.text, items)[1]}


def test_pii(chain):
    new, s = rows(chain[3][1]), pii.Surrogates(KEY.encode())
    for d, r in rows(chain[3][0]).items():
        text = pii.replace(r.text, s)[0]
        assert new[d] == type(r)(**{**r.asDict(), "text": text, "n_chars": len(text)})


def test_edge_tables(spark, sf_small):
    """Nulls, empty and very long texts, repeated rows and clashing names go through all stages."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    rows = [(1, None, 0), (2, "", 0), (None, "It is a fine day, and the sun shines.", 5), (3, long, 7), (3, long, 7), (4, "It is a fine day, and the sun shines.", 5), (None, None, None)]
    docs = spark.createDataFrame([(*r, *["x"] * 9) for r in rows], "doc_id long, text string, n_chars long, score string, row string, n_hit string, entities string, __t string, `a.b` string, root string, won string, Label string")
    for name, stage in C.STAGES[:4]:
        out = stage(spark, docs, sf_small)
        assert out.columns == docs.columns and set(map(str, out.collect())) <= set(map(str, docs.collect())) or name == "pii"
        assert stage(spark, docs.limit(0), sf_small).count() == 0
    kept = C.near_dedup(spark, docs, sf_small).collect()
    assert sorted((r.doc_id, r.n_chars) for r in kept) == [(1, 0), (3, 7), (4, 5)]
    assert C.decontaminate(spark, docs, sf_small).count() == len(rows)
    new = C.personal_data(spark, docs, sf_small).collect()
    assert len(new) == len(rows) and sorted(len(r.text) for r in new if r.text is not None) == sorted(r.n_chars for r in new if r.text is not None)
    pieces = C.packing(spark, docs, sf_small).collect()
    assert len({(r.doc_id, r.sequence_id, r.offset) for r in pieces}) == len(pieces) and {r.doc_id for r in pieces} == {None, 1, 2, 3, 4}
    assert C.packing(spark, docs.limit(0), sf_small).count() == 0


def test_packing_and_run(chain, spark, sf_small):
    before, after = chain[4]
    assert {r.doc_id for r in after.collect()} == set(rows(before))
    from tokenizers import Tokenizer

    from quillspark.llm.queries import bpe_path

    own, ids = Tokenizer.from_file(bpe_path()), {}
    for r in sorted(after.collect(), key=lambda r: (r.doc_id, r.start)):
        got = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(got) == r.length
        ids.setdefault(r.doc_id, []).extend(got)
    assert ids == {d: [*own.encode(r.text or "", add_special_tokens=False).ids, 1] for d, r in rows(before).items()}
    assert sorted(map(tuple, C.run(spark, sf_small).collect())) == sorted(map(tuple, after.collect()))


def test_run_leaves_one_table(spark, sf_small):
    from pathlib import Path

    from quillspark.llm.common import shared_dir

    C.run(spark, sf_small)  # sets the folder
    where = Path(shared_dir(spark).removeprefix("file:"))
    before = {p.name for p in where.iterdir()}
    out = C.run(spark, sf_small)
    left = {p.name for p in where.iterdir()} - before
    tables = [p for p in left if (where / p / "_SUCCESS").exists()]
    assert len(tables) == 1 and tables[0].startswith("pipeline-packing") and out.count() > 0
