"""Queries of team, network, discussion, template and topic operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times as C
from ..operators import discussions as D
from ..operators import edits as E
from ..operators import network as N
from ..operators import reports as R
from ..operators import wikitext as W
from ..operators.scoring import LEXICON, score_texts
from ..operators.text_classifier import STEPS, fit_text_classifier, score_with
from . import softmax_sql
from . import views as V

# The editor network of `edits`, whatever view that is.
GRAPH = """pv AS (SELECT *, lag(user_id) OVER (PARTITION BY page_id ORDER BY ts, rev_id) AS prev_user FROM edits),
edges AS (SELECT page_id, user_id AS src, prev_user AS dst, count(*) AS weight FROM pv WHERE user_id IS NOT NULL AND prev_user IS NOT NULL GROUP BY ALL),
nodes AS (SELECT page_id, src AS node FROM edges UNION SELECT page_id, dst FROM edges),
und AS (SELECT DISTINCT page_id, least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst)"""
EDGES = f"{V.EDITS},\n{GRAPH}"
DEGREES = """deg AS (SELECT page_id, node, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM nodes LEFT JOIN (SELECT page_id, dst AS node, count(*) AS i FROM edges GROUP BY ALL) USING (page_id, node)
 LEFT JOIN (SELECT page_id, src AS node, count(*) AS o FROM edges GROUP BY ALL) USING (page_id, node)),
cen AS (SELECT page_id, CASE WHEN count(*) OVER (PARTITION BY page_id) <= 1 THEN 1 ELSE (in_degree + out_degree) / (count(*) OVER (PARTITION BY page_id) - 1) END AS c FROM deg)"""
DEG = f"{EDGES}, {DEGREES}"
# Hops and numbers of shortest paths: a row is made once, when its pair is first reached.
HOPS = """step AS MATERIALIZED (SELECT page_id, src, dst FROM edges WHERE src <> dst),
bfs(page_id, src, dst, distance, paths) USING KEY (page_id, src, dst) AS (SELECT page_id, src, dst, 1, CAST(1 AS DOUBLE) FROM step
 UNION SELECT b.page_id, b.src, e.dst, min(b.distance) + 1, sum(b.paths) FROM bfs b JOIN step e ON e.page_id = b.page_id AND e.src = b.dst
 LEFT JOIN recurring.bfs r ON r.page_id = b.page_id AND r.src = b.src AND r.dst = e.dst WHERE r.distance IS NULL AND e.dst <> b.src GROUP BY b.page_id, b.src, e.dst),
dist AS MATERIALIZED (FROM bfs),
clo AS (SELECT page_id, node, coalesce(r / s * r / nullif(count(*) OVER (PARTITION BY page_id) - 1, 0), 0) AS c FROM nodes LEFT JOIN (SELECT page_id, dst AS node, count(*) AS r, sum(distance) AS s FROM dist GROUP BY ALL) USING (page_id, node)),
mutual AS (SELECT page_id, node, node AS other FROM nodes UNION SELECT a.page_id, a.src, a.dst FROM dist a JOIN dist b ON b.page_id = a.page_id AND b.src = a.dst AND b.dst = a.src),
scc AS (SELECT page_id, component, count(*) AS n FROM (SELECT page_id, node, min(other) AS component FROM mutual GROUP BY ALL) GROUP BY ALL),
through AS (SELECT a.page_id, a.dst AS node, sum(a.paths * b.paths / c.paths) AS x FROM dist a JOIN dist b ON b.page_id = a.page_id AND b.src = a.dst AND b.dst <> a.src
 JOIN dist c ON c.page_id = a.page_id AND c.src = a.src AND c.dst = b.dst AND c.distance = a.distance + b.distance GROUP BY ALL),
btw AS (SELECT page_id, coalesce(x, 0) / CASE WHEN n > 2 THEN (n - 1) * (n - 2) ELSE 1 END AS c FROM (SELECT *, count(*) OVER (PARTITION BY page_id) AS n FROM nodes) LEFT JOIN through USING (page_id, node))"""
# Weak components; cut nodes: from one neighbour of a node, in the graph without the node, another neighbour is not reached.
CUTS = """sym AS MATERIALIZED (SELECT page_id, a, b FROM und UNION SELECT page_id, b, a FROM und),
reach AS (SELECT page_id, node, node AS r FROM nodes UNION SELECT reach.page_id, reach.node, sym.b FROM reach JOIN sym ON sym.page_id = reach.page_id AND sym.a = reach.r),
sz AS MATERIALIZED (SELECT page_id, component, count(*) AS n FROM (SELECT page_id, node, min(r) AS component FROM reach GROUP BY ALL) GROUP BY ALL),
rest AS (SELECT page_id, a AS gone, min(b) AS r FROM sym GROUP BY ALL UNION SELECT rest.page_id, rest.gone, sym.b FROM rest JOIN sym ON sym.page_id = rest.page_id AND sym.a = rest.r AND sym.b <> rest.gone),
art AS (SELECT page_id, count(*) AS n FROM (SELECT DISTINCT page_id, a FROM sym WHERE NOT EXISTS (FROM rest WHERE rest.page_id = sym.page_id AND rest.gone = sym.a AND rest.r = sym.b)) GROUP BY ALL),
cut AS (SELECT page_id, coalesce(art.n, 0) AS articulation_points, CAST(coalesce(art.n, 0) = 0 AND k = 1 AND m > 1 AS BIGINT) AS is_biconnected FROM (SELECT page_id, count(*) AS k, CAST(sum(n) AS BIGINT) AS m FROM sz GROUP BY 1) LEFT JOIN art USING (page_id))"""
SIZE = "SELECT page_id, m AS num_edges, n AS num_nodes, round(coalesce(m / nullif(n * (n - 1), 0), 0), 6) AS density FROM (SELECT page_id, count(*) AS m FROM edges GROUP BY 1) JOIN (SELECT page_id, count(*) AS n FROM nodes GROUP BY 1) USING (page_id)"
TRIANGLES = "SELECT page_id, coalesce(t, 0) AS triangles FROM (SELECT DISTINCT page_id FROM edges) LEFT JOIN (SELECT x.page_id, count(*) AS t FROM und x JOIN und y ON y.page_id = x.page_id AND y.a = x.b JOIN und z ON z.page_id = x.page_id AND z.a = x.a AND z.b = y.b GROUP BY 1) USING (page_id)"


def recursive(cte: str) -> str:
    return f"RECURSIVE {cte}"


def stats(c: str, p: str) -> str:
    return f"round(avg({c}), 6) AS {p}_mean, round(median({c}), 6) AS {p}_median, round(CASE WHEN count({c}) = 1 THEN 0 ELSE stddev_samp({c}) END, 6) AS {p}_stdev"


def summary(table: str, prefix: str, over: int) -> str:
    return f"SELECT page_id, count(*) AS {prefix}_components, count(*) FILTER (n > {over}) AS {prefix}_large_components, max(n) AS {prefix}_max_size FROM {table} GROUP BY page_id"


def network_sql() -> str:
    """The NETWORK_ columns, of the views of GRAPH, DEGREES, HOPS and CUTS."""
    of = lambda cols, table: f"SELECT page_id, {cols} FROM {table} GROUP BY page_id"
    parts = [TRIANGLES, of(f"{stats('in_degree', 'in_degree')}, {stats('out_degree', 'out_degree')}", "deg"), of(stats("c", "centrality"), "cen"), of(stats("c", "closeness"), "clo"), "FROM cut", of(stats("c", "betweenness"), "btw"), summary("sz", "weak", 2), summary("scc", "strong", 1)]
    joined = f"({SIZE})" + "".join(f" LEFT JOIN ({p}) USING (page_id)" for p in parts)
    return f"SELECT page_id, COLUMNS(lambda c: c <> 'page_id') AS 'NETWORK_\\0' FROM (SELECT * FROM {joined})"


def edges(spark, sf):
    return N.editor_edges(V.edits(spark, sf))


def talkers(spark, sf):
    return V.comments(spark, sf).withColumn("user_id", F.regexp_extract("author", r"_(\d+)$", 1).cast("long"))


def talk_and_edit(spark, sf):
    edit = E.contribution_share(V.edits(spark, sf).withColumn("user_id", F.col("user_id") % 40).withColumn("page_id", F.col("page_id") % 20))
    return edit, E.contribution_share(talkers(spark, sf))


def threads(spark, sf):
    """Comments nested as the files have them."""
    c = V.comments(spark, sf).withColumn("dl_preds", F.struct(*D.SCORES)).withColumn("time", F.concat(F.date_format("time", "HH:mm, d MMMM yyyy"), F.lit(" (UTC)")))
    row = F.struct("pos", "comment_id", F.col("root_id").alias("root_comment_id"), "author", "refers_to", "root_author", "depth", "time", "text", "dl_preds")
    t = c.groupBy("page_id", "thread").agg(F.sort_array(F.collect_list(row)).alias("comments"))
    t = t.withColumn("comments", F.transform("comments", lambda x: x.dropFields("pos")))
    return t.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("thread", "comments"))).alias("threads"))


def register_all(register) -> None:
    ed, co = V.edits, V.comments
    w = lambda cte, body: f"WITH {cte} {body}"
    by = lambda cte, cols, table: w(cte, f"SELECT page_id, {cols} FROM {table} GROUP BY page_id")
    days = "CAST(floor((epoch(max(ts)) - epoch(min(ts))) / 86400) AS BIGINT)"
    register("num_authors", lambda s, sf: E.num_authors(ed(s, sf)), by(V.EDITS, "count(DISTINCT user_id) AS num_authors, round(count(DISTINCT user_id) / greatest(1, count(*)), 6) AS num_authors_normalized", "edits"))
    register("num_revisions", lambda s, sf: E.num_revisions(ed(s, sf)), by(V.EDITS, f"count(*) AS num_revisions, round(count(*) / greatest(1, {days}), 6) AS num_revisions_normalized", "edits"))
    rev = "SELECT page_id, round(sum(n - 1) / count(*), 6) AS revert_share FROM (SELECT page_id, sha1, count(*) AS n FROM edits GROUP BY ALL) GROUP BY page_id"
    register("revert_share", lambda s, sf: E.revert_share(ed(s, sf)), w(V.EDITS, rev))
    anon = "SELECT page_id, round(avg(CAST(user_id IS NULL AS INTEGER)), 6) AS anonymous_share FROM edits GROUP BY page_id"
    register("anonymous_share", lambda s, sf: E.anonymous_share(ed(s, sf)), w(V.EDITS, anon))
    uc = f"{V.EDITS}, uc AS (SELECT page_id, user_id, count(*) AS n FROM edits WHERE user_id IS NOT NULL GROUP BY ALL)"
    gini = "SELECT a.page_id, round(sum(abs(a.n - b.n)) / 2.0 / any_value(k * k) / any_value(mu), 6) AS gini FROM uc a JOIN uc b ON a.page_id = b.page_id JOIN (SELECT page_id, count(*) AS k, avg(n) AS mu FROM uc GROUP BY 1) z ON z.page_id = a.page_id GROUP BY a.page_id"
    register("gini", lambda s, sf: E.gini(E.user_counts(ed(s, sf)), "page_id", "n"), w(uc, gini))
    register("community_dynamics", lambda s, sf: E.community_dynamics(ed(s, sf)), w(uc, f"SELECT * FROM ({anon}) JOIN ({rev}) USING (page_id) LEFT JOIN ({gini}) USING (page_id)"))
    share = w(uc, "SELECT page_id, user_id, n, round(n / sum(n) OVER (PARTITION BY page_id), 6) AS share FROM uc")
    register("contribution_share", lambda s, sf: E.contribution_share(ed(s, sf)), share)
    register("share_of_total", lambda s, sf: E.user_counts(ed(s, sf)).withColumn("share", E.share_of_total("n", "page_id")), share)
    register("agg_stats", lambda s, sf: E.agg_stats(E.user_counts(ed(s, sf)), "page_id", "n", "n"), by(uc, stats("n", "n"), "uc"))
    overlap_sql = f"""{V.EDITS}, {V.COMMENTS}, e0 AS (SELECT page_id % 20 AS page_id, user_id % 40 AS user_id, count(*) AS n FROM edits WHERE user_id IS NOT NULL GROUP BY ALL),
t0 AS (SELECT page_id, CAST(regexp_extract(author, '_([0-9]+)$', 1) AS BIGINT) AS user_id, count(*) AS n FROM comments GROUP BY ALL),
e AS (SELECT page_id, user_id, n / sum(n) OVER (PARTITION BY page_id) AS e FROM e0), t AS (SELECT page_id, user_id, n / sum(n) OVER (PARTITION BY page_id) AS t FROM t0), bo AS (SELECT page_id, user_id, e, t FROM e FULL JOIN t USING (page_id, user_id))"""
    register("users_overlap", lambda s, sf: E.users_overlap(*talk_and_edit(s, sf)), by(overlap_sql, "round(count(*) FILTER (e IS NOT NULL AND t IS NOT NULL) / nullif(count(e), 0), 6) AS overlap_by_editors, round(count(*) FILTER (e IS NOT NULL AND t IS NOT NULL) / nullif(count(t), 0), 6) AS overlap_by_talkers, round(avg((coalesce(t, 0) - coalesce(e, 0)) ** 2), 6) AS distributions_diff", "bo"))
    def full(s, sf):
        e, t = talk_and_edit(s, sf)
        return e.select("page_id", "user_id", F.col("share").alias("e")).join(t.select("page_id", "user_id", F.col("share").alias("t")), ["page_id", "user_id"], "full_outer").na.fill(0.0)
    register("user_full_outer", full, w(overlap_sql, "SELECT page_id, user_id, round(coalesce(e, 0), 6) AS e, round(coalesce(t, 0), 6) AS t FROM bo"))
    def both(s, sf):
        e, t = talk_and_edit(s, sf)
        return e.select("page_id", "user_id").intersect(t.select("page_id", "user_id"))
    register("intersect_users", both, w(overlap_sql, "SELECT page_id, user_id FROM bo WHERE e IS NOT NULL AND t IS NOT NULL"))
    def only(s, sf):
        e, t = talk_and_edit(s, sf)
        return e.select("page_id", "user_id").join(t, ["page_id", "user_id"], "left_anti")
    register("except_ids", only, w(overlap_sql, "SELECT page_id, user_id FROM bo WHERE t IS NULL"))
    # networks
    register("prev_author", lambda s, sf: N.prev_author(ed(s, sf)).select("page_id", "rev_id", "prev_user"), w(EDGES, "SELECT page_id, rev_id, prev_user FROM pv"))
    register("editor_edges", edges, w(EDGES, "SELECT page_id, src, dst, weight FROM edges"))
    for name in ("graph_size", "graph_density"):
        register(name, lambda s, sf: N.graph_size(edges(s, sf)), w(EDGES, SIZE))
    register("triangle_count", lambda s, sf: N.triangle_count(edges(s, sf)), w(EDGES, TRIANGLES))
    register("degree_stats", lambda s, sf: N.degree_stats(edges(s, sf)), by(DEG, f"{stats('in_degree', 'in_degree')}, {stats('out_degree', 'out_degree')}", "deg"))
    register("degree_centrality_stats", lambda s, sf: N.degree_centrality_stats(edges(s, sf)), by(DEG, stats("c", "centrality"), "cen"))
    hops, cuts = recursive(f"{EDGES}, {HOPS}"), recursive(f"{EDGES}, {CUTS}")
    register("bfs_distances", lambda s, sf: N.bfs_distances(edges(s, sf)), w(hops, "SELECT page_id, src, dst, CAST(distance AS BIGINT) AS distance FROM dist"))
    register("closeness_stats", lambda s, sf: N.closeness_stats(edges(s, sf)), by(hops, stats("c", "closeness"), "clo"))
    register("connected_components", lambda s, sf: N.component_summary(N.components(edges(s, sf)), over=2, prefix="weak"), w(cuts, summary("sz", "weak", 2)))
    register("strong_components", lambda s, sf: N.component_summary(N.components(edges(s, sf), directed=True), over=1, prefix="strong"), w(hops, summary("scc", "strong", 1)))
    register("betweenness_stats", lambda s, sf: N.betweenness_stats(edges(s, sf)), by(hops, stats("c", "betweenness"), "btw"))
    for name in ("articulation_points", "is_biconnected"):
        register(name, lambda s, sf, name=name: N.cut_counts(edges(s, sf)).select("page_id", name), w(cuts, f"SELECT page_id, {name} FROM cut"))
    register("network_features", lambda s, sf: N.network_features(edges(s, sf)), w(recursive(f"{EDGES}, {DEGREES}, {HOPS}, {CUTS}"), network_sql()))
    # discussions
    cm = V.COMMENTS
    register("require_comments", lambda s, sf: D.comment_rows(threads(s, sf)).groupBy("page_id").agg(F.count("pos").alias("n"), F.count("time").alias("timed")), by(cm, "count(*) AS n, count(*) AS timed", "comments"))
    register("parse_comment_time", lambda s, sf: co(s, sf).select("page_id", "comment_id", D.parse_comment_time(F.concat(F.date_format("time", "HH:mm, d MMMM yyyy"), F.lit(" (UTC) x"))).alias("time")), w(cm, "SELECT page_id, comment_id, strftime(make_timestamp(time * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS time FROM comments"))
    cut = 1_704_067_200 + 100 * 3600
    register("filter_discussion_before", lambda s, sf: D.filter_before(co(s, sf), co(s, sf).select("page_id").distinct().withColumn("cutoff", F.timestamp_seconds(F.lit(cut) + F.col("page_id") * 3600))).groupBy("page_id").agg(F.count("*").alias("n")), w(cm, f"SELECT page_id, count(*) AS n FROM comments WHERE thread_time < {cut} + page_id * 3600 GROUP BY page_id"))
    th = f"{cm}, th AS (SELECT page_id, thread, count(*) AS n, count(DISTINCT author) AS a, avg(depth) AS d, avg(CAST(depth = 0 AS INTEGER)) AS z FROM comments GROUP BY ALL)"
    counts = "SELECT page_id, count(*) AS num_discussions, count(*) FILTER (n = 0) AS uncommented, round(avg(a), 6) AS avg_authors, round(median(a), 6) AS median_authors, any_value(nc) AS num_comments, any_value(na) AS num_authors FROM th JOIN (SELECT page_id, count(*) AS nc, count(DISTINCT author) AS na FROM comments GROUP BY 1) USING (page_id) GROUP BY page_id"
    register("thread_counts", lambda s, sf: D.thread_counts(co(s, sf)), w(th, counts))
    register("thread_depth", lambda s, sf: D.thread_depth(co(s, sf)), by(th, "round(avg(d), 6) AS avg_depth, round(avg(z), 6) AS depth_zero_avg", "th"))
    register("reply_stats", lambda s, sf: D.reply_stats(co(s, sf)), by(cm + ", fr AS (SELECT r.page_id, r.comment_id, any_value(r.time) AS t0, min(c.time) AS t1 FROM comments r LEFT JOIN comments c ON c.thread = r.thread AND c.root_id = r.comment_id AND c.pos > r.pos AND c.depth <> 0 WHERE r.depth = 0 GROUP BY ALL)", "round(avg(CAST(t1 IS NULL AS INTEGER)), 6) AS unreplied, round(avg(t1 - t0), 6) AS reply_seconds", "fr"))
    register("interaction_counts", lambda s, sf: D.interaction_counts(co(s, sf)), by(cm, "count(DISTINCT (author, refers_to)) FILTER (refers_to IS NOT NULL) AS direct, count(DISTINCT (author, root_author)) FILTER (root_author IS NOT NULL) AS indirect", "comments"))
    marks = "CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT)"
    register("mixed_author_comments", lambda s, sf: D.mixed_author_comments(co(s, sf).withColumn("text", F.replace("text", F.lit("the"), F.lit("talk")))), by(cm, f"CAST(sum(CAST({marks} > 1 AS INTEGER)) AS BIGINT) AS mixed, round(avg(CAST({marks} > 1 AS INTEGER)), 6) AS mixed_share", "comments"))
    register("count_talk_marks", lambda s, sf: co(s, sf).select("comment_id", F.regexp_count("text", F.lit("the")).alias("marks")), w(cm, f"SELECT comment_id, {marks} AS marks FROM comments"))
    register("interaction_edges", lambda s, sf: D.interaction_edges(co(s, sf), "refers_to"), w(cm, "SELECT DISTINCT page_id, author AS src, refers_to AS dst FROM comments WHERE refers_to IS NOT NULL"))
    register("score_overall", lambda s, sf: D.score_overall(co(s, sf)), by(cm, ", ".join([f"round(avg({x}), 6) AS {x}_mean" for x in D.SCORES] + [f"round(avg(CAST({t} AS INTEGER)), 6) AS {n}_share" for n, _, t in D.SHARES]), "comments"))
    register("score_per_user", lambda s, sf: D.score_per_user(co(s, sf)), by(cm + ", us AS (SELECT page_id, author, " + ", ".join(f"avg({x}) AS {x}" for x in D.SCORES) + " FROM comments GROUP BY ALL)", ", ".join(f"round({f}({x}), 6) AS user_{x}_{n}" for x in D.SCORES for f, n in (("avg", "mean"), ("median", "median"))), "us"))
    graph = lambda to, name: f"""SELECT page_id, round(coalesce(t / k, 0), 6) AS {name} FROM (SELECT DISTINCT page_id FROM comments) LEFT JOIN (
 WITH ie AS (SELECT DISTINCT page_id, author AS src, {to} AS dst FROM comments WHERE {to} IS NOT NULL), iu AS (SELECT DISTINCT page_id, least(src, dst) AS a, greatest(src, dst) AS b FROM ie WHERE src <> dst)
 SELECT page_id, k, coalesce(t, 0) AS t FROM (SELECT page_id, count(DISTINCT x) AS k FROM (SELECT page_id, unnest([src, dst]) AS x FROM ie) GROUP BY 1)
 LEFT JOIN (SELECT x.page_id, count(*) AS t FROM iu x JOIN iu y ON y.page_id = x.page_id AND y.a = x.b JOIN iu z ON z.page_id = x.page_id AND z.a = x.a AND z.b = y.b GROUP BY 1) USING (page_id)) USING (page_id)"""  # noqa: E731
    talks = "CAST((coalesce(length(text), 0) - length(replace(coalesce(text, ''), 'talk', ''))) / 4 AS BIGINT)"
    au = "au AS (SELECT page_id, author, count(*) AS n FROM comments GROUP BY ALL)"
    of = lambda cols, table="comments": f"SELECT page_id, {cols} FROM {table} GROUP BY page_id"
    blocks = [
        of("round(avg(d), 6) AS avg_depth, round(avg(z), 6) AS depth_zero_avg", "th"), of("round(avg(CAST(t1 IS NULL AS INTEGER)), 6) AS unreplied, round(avg(t1 - t0), 6) AS reply_seconds", "fr"),
        of("count(DISTINCT (author, refers_to)) FILTER (refers_to IS NOT NULL) AS direct, count(DISTINCT (author, root_author)) FILTER (root_author IS NOT NULL) AS indirect"),
        of(f"CAST(sum(CAST({talks} > 1 AS INTEGER)) AS BIGINT) AS mixed"), graph("refers_to", "direct_triangles"), graph("root_author", "indirect_triangles"),
        of(", ".join([f"round(avg({x}), 6) AS {x}_mean" for x in D.SCORES] + [f"round(avg(CAST({t} AS INTEGER)), 6) AS {n}_share" for n, _, t in D.SHARES])),
        of(", ".join(f"round({f}({x}), 6) AS user_{x}_{n}" for x in D.SCORES for f, n in (("avg", "mean"), ("median", "median"))), "us"),
        "SELECT a.page_id, round(sum(abs(a.n - b.n)) / 2.0 / any_value(k * k) / any_value(mu), 6) AS gini FROM au a JOIN au b ON a.page_id = b.page_id JOIN (SELECT page_id, count(*) AS k, avg(n) AS mu FROM au GROUP BY 1) z ON z.page_id = a.page_id GROUP BY a.page_id",
    ]
    fr = "fr AS (SELECT r.page_id, r.comment_id, any_value(r.time) AS t0, min(c.time) AS t1 FROM comments r LEFT JOIN comments c ON c.thread = r.thread AND c.root_id = r.comment_id AND c.pos > r.pos AND c.depth <> 0 WHERE r.depth = 0 GROUP BY ALL)"
    us = "us AS (SELECT page_id, author, " + ", ".join(f"avg({x}) AS {x}" for x in D.SCORES) + " FROM comments GROUP BY ALL)"
    register("discussion_features", lambda s, sf: D.discussion_features(co(s, sf)), w(f"{th}, {fr}, {us}, {au}", "SELECT page_id, COLUMNS(lambda c: c <> 'page_id') AS 'DISCUSSIONS_\\0' FROM (SELECT * FROM (" + counts + ")" + "".join(f" LEFT JOIN ({x}) USING (page_id)" for x in blocks) + ")"))
    def talk_until(s, sf):
        rows = D.filter_before(co(s, sf), co(s, sf).select("page_id").distinct().withColumn("cutoff", F.timestamp_seconds(F.lit(cut))))
        return D.thread_counts(rows).join(D.thread_depth(rows), "page_id").join(D.interaction_counts(rows), "page_id").select("page_id", "num_discussions", "num_comments", "avg_depth", "direct", "indirect")
    register("talk_features_until_promotion", talk_until, by(cm + f", k AS (SELECT * FROM comments WHERE thread_time < {cut}), kt AS (SELECT page_id, avg(d) AS avg_depth FROM (SELECT page_id, thread, avg(depth) AS d FROM k GROUP BY ALL) GROUP BY 1)", "count(DISTINCT thread) AS num_discussions, count(*) AS num_comments, round(any_value(avg_depth), 6) AS avg_depth, count(DISTINCT (author, refers_to)) FILTER (refers_to IS NOT NULL) AS direct, count(DISTINCT (author, root_author)) FILTER (root_author IS NOT NULL) AS indirect", "k JOIN kt USING (page_id)"))
    names = lambda s, sf: co(s, sf).select(F.col("author").alias("name"), F.when(F.col("pos") % 5 != 4, F.length("author") * 100 + F.col("thread") % 2).cast("long").alias("user_id"), (F.col("thread") * 1000 + F.col("pos")).alias("pos"))
    nm = f"{cm}, nm AS (SELECT author AS name, length(author) * 100 + thread % 2 AS user_id, thread * 1000 + pos AS pos FROM comments WHERE pos % 5 <> 4), um AS (SELECT name, CAST(arg_min(user_id, pos) AS BIGINT) AS user_id, count(DISTINCT user_id) > 1 AS conflict FROM nm GROUP BY name)"
    register("username_map", lambda s, sf: D.username_map(names(s, sf)), w(nm, "SELECT name, user_id, conflict FROM um"))
    def filled(s, sf):
        c = co(s, sf).withColumns({"author_id": F.when(F.col("pos") == 0, F.lit(-1)).cast("long"), "refers_to_author_id": F.lit(None).cast("long"), "root_author_id": F.lit(None).cast("long")})
        return D.fill_user_ids(c, D.username_map(names(s, sf))).select("comment_id", "author_id", "refers_to_author_id", "root_author_id")
    register("fill_user_ids", filled, w(nm, "SELECT comment_id, CASE WHEN pos = 0 THEN -1 ELSE a.user_id END AS author_id, r.user_id AS refers_to_author_id, o.user_id AS root_author_id FROM comments c LEFT JOIN um a ON a.name = c.author LEFT JOIN um r ON r.name = c.refers_to LEFT JOIN um o ON o.name = c.root_author"))
    def attached(s, sf):
        c = co(s, sf).withColumn("pos", F.col("thread") * 100 + F.col("pos")).select("page_id", "pos", "text", *D.SCORES)
        scored = c.where("pos % 3 <> 0").withColumn("pos", F.when(F.col("pos") % 2 == 0, F.col("pos")).otherwise(F.col("pos") + 100_000))
        return D.attach_scores(c, scored).select("page_id", "pos", "sentiment", "page_missing")
    at = f"{cm}, c1 AS (SELECT page_id, thread * 100 + pos AS pos, coalesce(text, '') AS t, sentiment FROM comments), s1 AS (SELECT page_id, CASE WHEN pos % 2 = 0 THEN pos ELSE pos + 100000 END AS pos, t, sentiment FROM c1 WHERE pos % 3 <> 0), f1 AS (SELECT page_id, t, arg_min(sentiment, pos) AS s FROM s1 GROUP BY ALL), att AS (SELECT c1.page_id, c1.pos, coalesce(s1.sentiment, f1.s) AS s FROM c1 LEFT JOIN s1 ON s1.page_id = c1.page_id AND s1.pos = c1.pos AND s1.t = c1.t LEFT JOIN f1 ON f1.page_id = c1.page_id AND f1.t = c1.t)"
    register("attach_scores", attached, w(at, "SELECT page_id, pos, round(s, 6) AS sentiment, bool_or(s IS NULL) OVER (PARTITION BY page_id) AS page_missing FROM att"))
    share = lambda k: f"round({LEXICON[k][1]} + {LEXICON[k][2] - LEXICON[k][1]} * least(1, 2 * len(list_filter(t, lambda x: list_contains({LEXICON[k][0].split()}, x))) / greatest(1, len(t))), 6) AS {k}"
    register("score_texts", lambda s, sf: score_texts(V.read(s, sf, "conversations").select("conv_id", "turn", "text")).drop("text"), w("tk AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS t FROM conversations)", f"SELECT conv_id, CAST(turn AS BIGINT) AS turn, {', '.join(share(k) for k in LEXICON)} FROM tk"))
    # a two-class scorer fitted on labelled texts, applied to all turns
    fit = lambda s, sf: fit_text_classifier(V.read(s, sf, "documents").join(V.read(s, sf, "labels").select("doc_id", "toxic"), "doc_id"), label="toxic")
    labelled = f"lt AS (SELECT doc_id AS id, CAST(toxic AS VARCHAR) AS y, text FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL), {softmax_sql.fitted('lt')}"
    register("fit_text_classifier", fit, w(labelled, f"SELECT c AS class, k AS bucket, round(w, 6) AS weight FROM w{STEPS}"))
    def fitted_scores(s, sf):
        turns = V.read(s, sf, "conversations").select("conv_id", "turn", "text")
        return score_with(turns, fit(s, sf)).select("conv_id", "turn", F.col("scores")["1"].alias("toxicity"))
    turns = f"{softmax_sql.features('conversations', 'tx', 'conv_id, turn')}, {softmax_sql.probabilities('tx', f'w{STEPS}', 'conv_id, turn', 'tp')}"
    register("score_texts_fitted", fitted_scores, w(f"{labelled}, {turns}", "SELECT conv_id, CAST(turn AS BIGINT) AS turn, round(p, 6) AS toxicity FROM tp WHERE c = '1'"))
    register("describe_scores", lambda s, sf: R.dataset_stats(co(s, sf), list(D.SCORES)), w(cm, " UNION ALL ".join(f"SELECT '{x}' AS feature, round(sum({x}), 6) AS sum, round(avg({x}), 6) AS mean, round(median({x}), 6) AS median, round(stddev_samp({x}), 6) AS std FROM comments" for x in D.SCORES)))
    # templates, by the rule that made them
    wt, day = V.wikitext, "lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0')"
    kind = lambda *v: "CASE doc_id % 4 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(v) if x) + " END"
    ga0, fa2, ga1 = f"'2011-03-' || {day} || 'T15:34:00Z'", f"'2006-09-' || {day} || 'T00:00:00Z'", "'2008-01-14T00:00:00Z'"
    register("talk_promotion_dates", lambda s, sf: W.talk_promotion_dates(wt(s, sf)), f"SELECT doc_id AS page_id, {kind(ga0, ga1)} AS ga_promotion, {kind(chr(39) + '2012-01-02T00:00:00Z' + chr(39))} AS ga_demotion, {kind(None, None, fa2)} AS fa_promotion, CAST(NULL AS VARCHAR) AS fa_demotion, {kind(chr(39) + 'dga' + chr(39), chr(39) + 'ga' + chr(39))} AS status, doc_id % 4 <> 3 AS reached FROM documents")
    register("talk_events", lambda s, sf: W.talk_events(wt(s, sf)), f"SELECT doc_id AS page_id, 'gan' AS action, {ga0} AS date, NULL AS link, 'listed' AS result FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, 'gar', '2012-01-02T00:00:00Z', NULL, 'delisted' FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, 'gan', {ga1}, NULL, NULL FROM documents WHERE doc_id % 4 = 1 UNION ALL SELECT doc_id, 'fac', {fa2}, NULL, 'promoted' FROM documents WHERE doc_id % 4 = 2")
    register("extract_history_sections", lambda s, sf: wt(s, sf).select("page_id", F.size(W.histories(W.templates("content"))).cast("long").alias("n")), "SELECT doc_id AS page_id, CAST(doc_id % 2 = 0 AS BIGINT) AS n FROM documents")
    register("split_template_lines", lambda s, sf: wt(s, sf).select("page_id", W.history_lines(W.templates("content")).alias("lines")).select("page_id", F.when(F.col("lines").isNotNull(), F.size("lines")).cast("long").alias("n")), "SELECT doc_id AS page_id, CAST(CASE doc_id % 4 WHEN 0 THEN 8 WHEN 2 THEN 4 END AS BIGINT) AS n FROM documents")
    register("parse_template_kv", lambda s, sf: W.parsed(wt(s, sf)).groupBy("key").agg(F.count("*").alias("n")), "SELECT k AS key, count(*) AS n FROM (SELECT unnest(CASE doc_id % 4 WHEN 0 THEN ['action1', 'action1date', 'action1result', 'action2', 'action2date', 'action2result', 'currentstatus'] WHEN 2 THEN ['action1', 'action1date', 'action1result'] ELSE [] END) AS k FROM documents) GROUP BY 1")
    register("group_template_actions", lambda s, sf: W.actions(wt(s, sf)).select("page_id", "n", "kind"), "SELECT doc_id AS page_id, 1 AS n, CASE doc_id % 4 WHEN 0 THEN 'gan' ELSE 'fac' END AS kind FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 2, 'gar' FROM documents WHERE doc_id % 4 = 0")
    register("extract_action_time", lambda s, sf: W.action_time(W.actions(wt(s, sf)), "gar", ("delisted",)), "SELECT doc_id AS page_id, '2012-01-02' AS time FROM documents WHERE doc_id % 4 = 0")
    for name, compat, status in (("extract_current_status", False, "dga"), ("extract_current_status_compat", True, "dga}}")):
        register(name, lambda s, sf, compat=compat: wt(s, sf).select("page_id", W.current_status("content", compat=compat).alias("status")), f"SELECT doc_id AS page_id, CASE WHEN doc_id % 4 = 0 THEN '{status}' END AS status FROM documents")
    register("extract_simple_badge", lambda s, sf: wt(s, sf).select("page_id", W.simple_badge(W.templates("content")).alias("b")).select("page_id", "b.badge", "b.date"), "SELECT doc_id AS page_id, CASE WHEN doc_id % 4 = 1 THEN 'ga' END AS badge, CASE WHEN doc_id % 4 = 1 THEN '14 january 2008' END AS date FROM documents")
    register("parse_date_multi", lambda s, sf: V.read(s, sf, "orders").select("o_orderkey", *(C.parse_date(F.date_format("o_orderdate", p)).alias(f"d{i}") for i, p in enumerate(("yyyy-MM-dd", "d MMMM yyyy", "MMM d, yyyy", "HH:mm, d MMMM, yyyy", "HH:mm:ss MMMM d yyyy", "M/d/yyyy", "yyyy.MM.dd", "dd-MMM-yyyy", "yyyy-MM-dd, HH:mm")))), "SELECT o_orderkey, " + ", ".join(f"strftime({'o_orderdate' if i in (4,) else f'date_trunc({u!r}, o_orderdate)'}, '%Y-%m-%dT%H:%M:%SZ') AS d{i}" for i, u in enumerate(("day", "day", "day", "minute", "second", "day", "day", "day", "minute"))) + " FROM orders")
    # pages of a small grammar; the SQL knows what was written
    kinds = [[g[i].lower() for g in V.GRAMMAR] for i in range(3)]
    listed = f"""ac AS (SELECT doc_id AS page_id, i, {kinds[0]}[1 + (doc_id + i) % 4] AS action, strftime(make_date(CAST(2001 + (doc_id + i) % 19 AS INT), 5, CAST(1 + (doc_id + i) % 28 AS INT)), '%Y-%m-%dT00:00:00Z') AS date,
 CASE WHEN (doc_id + i) % 2 = 0 THEN '{{{{oldid|' || doc_id || '}}}}' ELSE '[[talk:page/ga1|review]]' END AS link, CASE WHEN (doc_id + i) % 5 <> 0 THEN {kinds[1]}[1 + (doc_id + i) % 4] END AS result, {kinds[2]}[1 + (doc_id + i) % 4] AS outcome
 FROM (SELECT doc_id, unnest(range(1, 2 + doc_id % 12)) AS i FROM documents))"""
    gr = V.wikitext_grammar
    register("talk_events_grammar", lambda s, sf: W.talk_events(gr(s, sf)), w(listed, "SELECT page_id, action, date, link, result FROM ac"))
    first = ", ".join(f"arg_min(date, i) FILTER (WHERE outcome = '{x}' AND result IS NOT NULL) AS {x}" for x in kinds[2])
    register("talk_promotion_dates_grammar", lambda s, sf: W.talk_promotion_dates(gr(s, sf)), w(listed, f"SELECT page_id, {first}, CASE WHEN page_id % 2 = 0 THEN 'ffa' END AS status, true AS reached FROM ac GROUP BY page_id"))
    register("group_template_actions_grammar", lambda s, sf: W.actions(gr(s, sf)).select("page_id", "n", "kind", F.size("results").alias("results")), w(listed, "SELECT page_id, i AS n, action AS kind, CAST(result IS NOT NULL AS BIGINT) AS results FROM ac"))
    # topics
    tp = V.TOPICS
    for name in ("extract_topic_tags", "topic_tags"):
        register(name, lambda s, sf: W.topic_tags(wt(s, sf)).drop("pos"), "SELECT doc_id AS page_id, lang AS project_name, 'top' AS importance FROM documents WHERE doc_id % 4 = 2")
    register("normalize_importance", lambda s, sf: V.topics(s, sf).select("page_id", W.normalize_importance(F.concat(F.lit(" "), F.upper("importance"))).alias("importance")), w(tp, "SELECT page_id, importance FROM topics"))
    top = "top AS (SELECT project_name FROM topics GROUP BY 1 ORDER BY count(*) DESC, project_name LIMIT 10)"
    register("top_topics", lambda s, sf: W.top_topics(V.topics(s, sf), top=10, leave_out=("src1",)).select("page_id", "project_name"), w(f"{tp}, {top}", "SELECT page_id, project_name FROM topics WHERE project_name IN (FROM top) AND project_name <> 'src1'"))
    register("most_common", lambda s, sf: W.most_common(V.topics(s, sf)), w(tp, "SELECT project_name, count(*) AS n FROM topics GROUP BY 1"))
    register("clean_feature_name", lambda s, sf: V.topics(s, sf).select("page_id", W.feature_name(F.concat(F.lit("Src A "), "project_name")).alias("name")), w(tp, "SELECT page_id, 'TOPIC_i_src_a_' || project_name AS name FROM topics"))
    value = "CASE importance WHEN 'low' THEN 1 WHEN 'mid' THEN 2 WHEN 'high' THEN 4 WHEN 'top' THEN 5 ELSE 3 END"
    for name, n in (("topic_pivot", 20), ("limit_topics", 3)):
        register(name, lambda s, sf, n=n: long_topics(W.topic_pivot(V.topics(s, sf), limit=n)), w(f"{tp}, tt AS (SELECT project_name FROM topics GROUP BY 1 ORDER BY count(*) DESC, project_name LIMIT {n})", f"SELECT page_id, 'TOPIC_i_' || replace(lower(project_name), ' ', '_') AS topic, CAST({value} AS BIGINT) AS v FROM topics WHERE project_name IN (FROM tt)"))


def long_topics(df):
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("topic"), F.col(c).alias("v")) for c in df.columns if c != "page_id"))).alias("e")
    return df.select("page_id", cells).select("page_id", "e.*").where("v <> 0")
