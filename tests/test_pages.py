"""Team, network, discussion and template operators on small known cases."""

from datetime import datetime as D

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.operators import discussions, edits, metrics, network, wikitext

EDGE = "page_id long, src long, dst long, weight long"
GRAPHS = {  # edges; nodes, triangles, cut nodes, biconnected, weak components, strong components
    "path": ([(1, 2), (2, 3)], 3, 0, 1, 0, 1, 3), "cycle": ([(1, 2), (2, 3), (3, 1)], 3, 1, 0, 1, 1, 1), "star": ([(1, 2), (1, 3), (1, 4)], 4, 0, 1, 0, 1, 4),
    "clique": ([(a, b) for a in range(4) for b in range(4) if a != b], 4, 4, 0, 1, 1, 1), "bow": ([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 3)], 5, 2, 1, 0, 1, 1),
    "pair": ([(1, 2)], 2, 0, 0, 1, 1, 2), "self": ([(1, 1)], 1, 0, 0, 0, 1, 1), "two": ([(1, 2), (3, 4)], 4, 0, 0, 0, 2, 4),
}


@pytest.mark.parametrize("limit", [5000, 0])
def test_graphs(spark, monkeypatch, limit):
    names = list(GRAPHS)
    e = spark.createDataFrame([(i, a, b, 1) for i, n in enumerate(names) for a, b in GRAPHS[n][0]], EDGE)
    whole = {r.page_id: r for r in network.cut_counts(e).collect()}
    monkeypatch.setattr(network, "NODES", limit)
    size = {r.page_id: r.num_nodes for r in network.graph_size(e).collect()}
    tri = {r.page_id: r.triangles for r in network.triangle_count(e).collect()}
    weak = {r.page_id: r for r in network.component_summary(network.components(e), over=2, prefix="w").collect()}
    strong = {r.page_id: r for r in network.component_summary(network.components(e, directed=True), over=1, prefix="s").collect()}
    for i, n in enumerate(names):
        want = GRAPHS[n][1:]
        assert (size[i], tri[i], whole[i].articulation_points, whole[i].is_biconnected, weak[i].w_components, strong[i].s_components) == want, n
    near = {(r.src, r.dst): r.distance for r in network.bfs_distances(e.where("page_id = 4")).collect()}
    assert near[1, 3] == 2 and near[1, 5] == 4 and near[4, 1] == 3


def test_betweenness():
    assert network.betweenness({1: {2}, 2: {3}, 3: set()}) == {1: 0.0, 2: 0.5, 3: 0.0}
    assert network.betweenness({1: set(), 2: {1}}) == {1: 0.0, 2: 0.0}


def test_editor_edges(spark):
    rev = [(1, 10, D(2006, 1, 1), 7), (1, 11, D(2006, 1, 3), None), (1, 12, D(2006, 2, 1), 8), (1, 13, D(2006, 3, 15), 8), (1, 14, D(2006, 3, 16), 7), (1, 15, D(2006, 5, 1), 7)]
    df = spark.createDataFrame(rev, "page_id long, rev_id long, ts timestamp, user_id long")
    assert sorted((r.src, r.dst, r.weight) for r in network.editor_edges(df).collect()) == [(7, 7, 1), (7, 8, 1), (8, 8, 1)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=12))
def test_gini(spark, xs):
    df = spark.createDataFrame([(1, float(x)) for x in xs], "page_id long, x double")
    n, mean = len(xs), sum(xs) / len(xs)
    pairs = sum(abs(a - b) for i, a in enumerate(xs) for b in xs[i + 1 :])
    assert edits.gini(df, "page_id", "x").first().gini == pytest.approx(pairs / (n * n * mean), abs=1e-9)


def test_replies(spark):
    t = lambda h, m=0: D(2024, 1, 1 + h // 24, h % 24, m)
    rows = [(1, 1, 0, "a", None, 0, t(0)), (1, 1, 1, "b", "a", 1, t(30)), (1, 1, 2, "c", "a", 1, t(25)), (1, 1, 3, "d", "e", 1, t(1)), (1, 1, 4, "e", None, 0, t(2))]
    df = spark.createDataFrame(rows, "page_id long, thread long, pos long, comment_id string, root_id string, depth long, time timestamp")
    r = discussions.reply_stats(df).first()
    assert (r.unreplied, r.reply_seconds) == (0.5, 25 * 3600)
    assert discussions.reply_stats(df, compat=True).first().reply_seconds == 3600


PAGES = [
    (1, "{{ArticleHistory|action1=GAN|action1date=15:34, 6 March 2011|action1result=listed|action2=GAR|action2date=2012-01-02|action2result=delisted|currentstatus=DGA}}"),
    (2, "{{GA|14 January 2008|topic=x}}"), (3, "{{Article history|action1=FAC|action1date=Sept 6, 2006|action1result=promoted}} {{WikiProject Chess|class=B|importance= Top }}{{WikiProject banner shell|1=}}"),
    (4, "no template"), (5, None),
]


def test_templates(spark):
    df = spark.createDataFrame(PAGES, "page_id long, content string")
    d = {r.page_id: r for r in wikitext.talk_promotion_dates(df).collect()}
    assert (d[1].ga_promotion, d[1].ga_demotion, d[1].status) == (D(2011, 3, 6, 15, 34), D(2012, 1, 2), "dga")
    assert (d[2].ga_promotion, d[2].status, d[3].fa_promotion, d[4].reached) == (D(2008, 1, 14), "ga", D(2006, 9, 6), False) and 5 not in d
    assert sorted((r.page_id, r.action, r.result) for r in wikitext.talk_events(df).collect() if r.result) == [(1, "gan", "listed"), (1, "gar", "delisted"), (3, "fac", "promoted")]
    assert sorted(r.page_id for r in wikitext.unreached(df).collect()) == [4, 5]
    assert [(r.page_id, r.project_name, r.importance) for r in wikitext.topic_tags(df).collect()] == [(3, "Chess", "top")]


def test_precision_at_k(spark):
    y, p = [1, 0, 1, 1, 0, 0, 1, 0, 0, 1], [0.9, 0.2, 0.75, 0.6, 0.1, 0.3, 0.8, 0.5, 0.4, 0.95]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(y, p))], "id long, y int, p double")
    assert metrics.precision_at_k(df, 70).first()[0] == pytest.approx(5 / 7)
    assert metrics.rank_auc(df).first().auc == 1.0
    with pytest.raises(ValueError):
        metrics.precision_at_k(df, 0)


@pytest.mark.parametrize("seed", [0, 1, 3, 11])
def test_score_means_keep_no_order(spark, seed):
    """These scores' mean is 0.3128125; sums of doubles give it a last digit that follows the rows' order, and with it the sixth."""
    from random import Random

    scores = [64, 51, 44, 50, 30, 29, 62, 8, 43, 65, 20, 33, 34, 5, 16, 37, 23, 35, 44, 61, 27, 44, 5, 42, 42, 0, 34, 15, 2, 14, 13, 9]
    Random(seed).shuffle(scores)
    schema = "page_id long, author string, " + ", ".join(f"{s} double" for s in discussions.SCORES)
    rows = [(1, "a", *[x / 100] * 5) for x in scores] + [(2, "a", *[None] * 5), (3, "a", *[float("nan")] * 5), (4, "a", *[1e30] * 5)]
    df = spark.createDataFrame(rows, schema).coalesce(1)
    for means, name in ((discussions.score_overall(df), "toxicity_mean"), (discussions.score_per_user(df), "user_toxicity_mean")):
        got = {r.page_id: r[name] for r in means.collect()}
        assert got[1] == 0.3128125 and got[2] is None and got[3] != got[3] and got[4] == 1e30
