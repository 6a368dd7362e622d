"""Histories of editors: read once, exchanged once."""

from datetime import datetime as D

from quillspark import catalog
from quillspark.operators import edits


def test_totals_take_one_exchange(spark):
    log = [(1, 7, D(2006, 1, 1)), (1, 8, D(2006, 1, 2)), (1, 8, D(2006, 1, 2)), (1, 9, D(2006, 1, 3)), (1, 9, None), (2, 7, D(2006, 1, 1)), (3, 9, D(2006, 1, 4))]
    asked = [(7, 1, D(2006, 1, 2)), (8, 1, D(2006, 1, 3)), (7, 2, D(2007, 1, 1)), (9, 3, D(2006, 1, 3)), (8, 4, D(2006, 1, 1)), (9, 1, None)]
    got = edits.history_totals(spark.createDataFrame(asked, "page_id long, user_id long, cutoff timestamp"), spark.createDataFrame(log, "user_id long, page_id long, timestamp timestamp"), "timestamp")
    assert {(r.page_id, r.user_id): r.n for r in got.collect()} == {(7, 1): 2, (8, 1): 2, (7, 2): 0, (9, 3): 0, (8, 4): 0, (9, 1): 0}
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange ") == 1


def sources(df):
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return {leaves.apply(i).nodeName() for i in range(leaves.size())}


def test_site_activity_reads_revisions_once(spark, sf_small):
    assert sources(catalog.queries()["site_activity"](spark, sf_small)) == {"InMemoryRelation"}


def test_experience_reads_revisions_once(spark, sf_small):
    assert sources(catalog.queries()["experience_features"](spark, sf_small)) == {"InMemoryRelation"}
