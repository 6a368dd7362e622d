"""The filter audit against filters applied one after another."""

import re
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm.audit import audit, audit_filters, interactions
from quillspark.llm.queries import ORACLE, op13_filter_audit
from tests.oracle import compare, connect

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def one_by_one(masks, names):
    """(order, step) -> kept, removed, redundant, unique_fails, good_lost; and shapley by filter."""
    out, shapley = {}, defaultdict(int)
    for o in permutations(range(len(names))):
        left = list(masks)
        for k, f in enumerate(o):
            went = [d for d in left if d[0] >> f & 1]
            left = [d for d in left if not d[0] >> f & 1]
            redundant = sum(d[0] >> f & 1 for d in masks) - len(went)
            out["".join(names[i] for i in o), k + 1] = (len(left), len(went), redundant, sum(d[0] == 1 << f for d in masks), sum(d[1] for d in went))
            shapley[f] += len(went)
    return out, shapley


@given(st.integers(1, 4).flatmap(lambda m: st.tuples(st.just(m), st.lists(st.tuples(st.integers(0, 2**m - 1), st.integers(0, 1)), min_size=1, max_size=40))))
@settings(max_examples=60, deadline=None)
def test_min_plus_steps(case):
    m, docs = case
    names = "ABCD"[:m]
    mask = np.array([d[0] for d in docs])
    got = interactions((mask[:, None] >> np.arange(m)) % 2 == 1, {"n": np.ones(len(docs), np.int64), "good": np.array([d[1] for d in docs])}, names)
    want, shapley = one_by_one(docs, names)
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost) for r in got.itertuples()} == want
    assert all(r.shapley == shapley[names.index(r.filter_order[r.step - 1])] for r in got.itertuples())


def plain(docs, labels):
    first, parts = {}, defaultdict(list)
    for i, t, _ in docs:
        key = (i is None, i or 0)
        first[t or ""] = min(first.get(t or "", key), key)
    for i, t, lang in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), (i is None, i or 0) > first[t]]
        good = any(k == i and q == 1 for k, q, _ in labels if k is not None)
        parts[lang or ""].append((sum(b << n for n, b in enumerate(fails)), int(good)))
    return parts


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(300))
    docs = [(1, None, "en"), (2, "", None), (3, "", ""), (None, "", "en"), (4, long, "en"), (4, long, "en"), (5, long, "de"), (6, long + " #", "de"), (None, long, "en"), (7, "A " * 300_000, "de"), (0, long, "fr")]
    labels = [(1, 1, 0), (4, 0, 1), (4, 1, 0), (5, None, 1), (None, 1, 1), (7, 1, None)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, lang string, mask int, part string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit_filters(df, marks).collect()
    parts = plain(docs, labels)
    assert len(got) == len(parts) * 600
    for part, masks in parts.items():
        want, shapley = one_by_one(masks, "ABCDE")
        assert {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost) for r in got if r.part == part} == want
        assert all(r.shapley == shapley["ABCDE".index(r.filter_order[r.step - 1])] for r in got if r.part == part)
    assert audit_filters(df.limit(0), marks).count() == 0
    assert {r.good_lost + r.toxic_lost for r in audit_filters(df, marks.limit(0)).collect()} == {0}
    with pytest.raises(ValueError):
        audit(df, "ABCDEFGH")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    assert compare(spark, connect(path), path, op13_filter_audit, ORACLE["op13_filter_audit"]) == 2400

