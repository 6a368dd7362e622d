"""Life-cycle operators on hand-made pages."""

from datetime import datetime as D
from itertools import product

import pytest
from pyspark.sql import functions as F

from quillspark.functions.times import floor_days, parse_date
from quillspark.operators import lifecycle as L

REV = "page_id long, rev_id long, ts timestamp, user_id long, sha1 string, level string"
PAGE1 = [
    (1, 10, D(2006, 1, 1), 7, "a", None), (1, 11, D(2006, 1, 3, 12), None, "b", None), (1, 12, D(2006, 2, 1), 8, "a", "ga"),
    (1, 13, D(2006, 3, 15), 8, "c", "ga"), (1, 14, D(2006, 3, 16), 7, "d", None), (1, 15, D(2006, 5, 1), 7, "e", None),
]


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_runs_and_changes(spark):
    r = spark.createDataFrame(PAGE1, REV)
    runs = L.level_runs(r)
    assert rows(runs, "run", "level", "n_revisions", "n_days") == [(0, None, 2, 2), (1, "ga", 2, 42), (2, None, 2, 46)]
    assert rows(L.level_runs(r, compat=True), "run", "n_revisions") == [(0, 3), (1, 2), (2, 2)]
    assert rows(L.level_changes_from(runs), "start_rev", "significant") == [(12, False), (14, True)]
    assert rows(L.level_changes_to(runs), "start_rev", "significant") == [(12, True), (14, True)]
    t = L.dump_timeline(r).first()
    assert (t.ga_promotion, t.ga_demotion, t.fa_promotion, t.is_sustainable) == (D(2006, 2, 1), D(2006, 3, 16), None, False)


def level_page(*levels):
    """A page whose k-th level holds for 40 days."""
    return [(1, 2 * i + j, D.fromordinal(D(2005, 1, 1).toordinal() + 80 * i + 40 * j), 1, "x", v) for i, v in enumerate(levels) for j in (0, 1)]


@pytest.mark.parametrize("levels,want", [
    ((None, "ga", "fa", None), {"ga_promotion": 1, "fa_promotion": 2, "fa_demotion": 3, "ga_demotion": 3}),
    ((None, "fa", "ga", None), {"fa_promotion": 1, "fa_demotion": 2}),
    (("ga", None), {"ga_promotion": 0, "ga_demotion": 1}),
    (("fa",), {"fa_promotion": 0}),
    ((None,), {}),
])
def test_transitions(spark, levels, want):
    page = level_page(*levels)
    t = L.dump_timeline(spark.createDataFrame(page, REV)).first()
    starts = {k: page[2 * i][2] for k, i in want.items()}
    assert {k: t[k] for k in ("ga_promotion", "fa_promotion", "fa_demotion", "ga_demotion")} == {"ga_promotion": None, "fa_promotion": None, "fa_demotion": None, "ga_demotion": None} | starts


def test_flags(spark):
    r = L.promoted_yet_flags(spark.createDataFrame(level_page(None, "ga", None), REV))
    assert rows(r, "rev_id", "been_promoted_yet", "been_demoted_yet") == [(0, False, False), (1, False, False), (2, True, False), (3, True, False), (4, True, True), (5, True, True)]


@pytest.mark.parametrize("near", [True, False])
def test_merge_table(spark, near):
    """All sixteen combinations of the four dates, aligned or far apart."""
    tp, td = D(2007, 1, 1), D(2009, 1, 1)
    dp, dd = (D(2007, 1, 11), D(2009, 1, 11)) if near else (D(2007, 6, 1), D(2009, 6, 1))
    data = [(i, D(2006, 1, 1), *(d if f else None for f, d in zip(flags, (tp, td, dp, dd)))) for i, flags in enumerate(product((0, 1), repeat=4))]
    df = spark.createDataFrame(data, "page_id long, creation timestamp, talkpage_fa_promotion timestamp, talkpage_fa_demotion timestamp, dumps_fa_promotion timestamp, dumps_fa_demotion timestamp")
    for r in L.merge_sources(df, "fa").collect():
        a, b, c, d = (bool(r.page_id >> (3 - i) & 1) for i in range(4))
        if a and b:
            want = (tp, td, "talkpage")
        elif a:
            want = (tp, dd, "both") if c and d and near else (tp, None, "talkpage")
        elif b:
            want = (dp, td, "both") if d and near and c else (None, td, "both") if d and near else (None, None, None)
        else:
            want = (dp, dd if d else None, "dumps") if c else (None, None, None)
        assert (r.fa_promotion, r.fa_demotion, r.fa_source) == want, (r.page_id, want)


def test_source_validation(spark):
    c = D(2006, 1, 1)
    data = [(1, c, c, None), (2, c, D(2007, 1, 1), D(2006, 6, 1)), (3, c, D(2007, 1, 1), D(2008, 1, 1)), (4, c, None, D(2005, 1, 1))]
    df = spark.createDataFrame(data, "page_id long, creation timestamp, p timestamp, d timestamp")
    ok = L.validate_source("p", "d")
    assert rows(df.select("page_id", ok[0].alias("p"), ok[1].alias("d")), "page_id", "p", "d") == [(1, False, False), (2, False, False), (3, True, True), (4, False, False)]


def test_alignment_is_floored(spark):
    a = D(2007, 3, 1)
    df = spark.createDataFrame([(a, D(2007, 1, 30)), (a, D(2007, 1, 29, 12)), (D(2007, 1, 29, 12), a)], "a timestamp, b timestamp")
    assert [r[0] for r in df.select(L.sources_aligned("a", "b", compat=True)).collect()] == [True, True, False]
    assert [r[0] for r in df.select(L.sources_aligned("a", "b")).collect()] == [True, True, True]
    assert [r[0] for r in df.select(floor_days("a", "b")).collect()] == [30, 30, -31]


def test_conservative_label(spark):
    d = D(2008, 1, 1)
    df = spark.createDataFrame([(1, d, None, None, None), (2, d, None, "dumps", None), (3, d, None, "talkpage", None), (4, None, None, None, None), (5, None, None, None, None)], "page_id long, fa_demotion timestamp, ga_demotion timestamp, fa_source string, ga_source string")
    lists = spark.createDataFrame([(5, "former_ga"), (5, "former_fa"), (2, "current_fa")], "page_id long, type string")
    assert rows(L.label_conservative(df, lists), "page_id", "label") == [(1, False), (2, True), (3, False), (4, True), (5, False)]


DATES = {
    "2008-01-14": "2008-01-14 00:00:00", "14 January 2008": "2008-01-14 00:00:00", "14 January, 2008": "2008-01-14 00:00:00", "01/14/2008": "2008-01-14 00:00:00", "Mar 5, 2024": "2024-03-05 00:00:00",
    "2005-08-10, 03:26:13": "2005-08-10 03:26:13", "2005-08-10T03:26:13Z": "2005-08-10 03:26:13", "2008.01.14": "2008-01-14 00:00:00", "15-Jan-2004": "2004-01-15 00:00:00", "23:29, 12 August 2006": "2006-08-12 23:29:00",
    "04:39, 18 Oct 2004": "2004-10-18 04:39:00", "August 13 2005": "2005-08-13 00:00:00", "19:44, October 11, 2003": "2003-10-11 19:44:00", "01:02:56, 20 April 2004": "2004-04-20 01:02:56", "6 Sept 2006": "2006-09-06 00:00:00",
    "Jun 5, 2010": "2010-06-05 00:00:00", "14:03,23 August 2014": "2014-08-23 14:03:00", "14:03, 23 August 2014 (UTC)": "2014-08-23 14:03:00", "date=2007-04-28 21:24": "2007-04-28 21:24:00", "13:57:19 July 20 2004.": "2004-07-20 13:57:19",
    "1/2/04": None, "garbage": None, "31 February 2004": None, "": None, None: None,
}


def test_dates(spark):
    df = spark.createDataFrame([(k,) for k in DATES], "d string")
    got = {r.d: r.t for r in df.select("d", F.date_format(parse_date("d"), "yyyy-MM-dd HH:mm:ss").alias("t")).collect()}
    assert got == DATES
