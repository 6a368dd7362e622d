"""Queries of evaluation, reports and modeling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import modeling as B
from ..operators import reports as R
from ..operators import wikitext as W
from ..operators.logit import RIDGE, STEPS
from . import newton_sql as N
from . import tree_sql as T
from . import views as V
from .lifecycle_queries import life

FEATURES = ["EDIT_chars", "EDIT_lines", "COMPOSITION_words", "NETWORK_hash"]
TREES = 100
JOB = [*FEATURES, "days"]  # days are missing in every third row
CUTS = "(SELECT unnest([" + ", ".join(map(str, M.THRESHOLDS)) + "]) AS threshold)"
CONF = f"cf AS (SELECT threshold, count(*) FILTER (p > threshold AND y = 1) AS tp, count(*) FILTER (p > threshold AND y = 0) AS fp, count(*) FILTER (p <= threshold AND y = 1) AS fn, count(*) FILTER (p <= threshold AND y = 0) AS tn FROM preds, {CUTS} GROUP BY threshold)"


def ratio(a: str, b: str) -> str:
    return f"coalesce(({a}) / nullif({b}, 0), 0)"


P1, R1, P0, R0 = ratio("tp", "tp + fp"), ratio("tp", "tp + fn"), ratio("tn", "tn + fn"), ratio("tn", "tn + fp")
F1, F0 = ratio("2.0 * tp", "2 * tp + fp + fn"), ratio("2.0 * tn", "2 * tn + fp + fn")
MEASURES = {
    "accuracy": ratio("tp + tn", "tp + fp + fn + tn"), "macro_precision": f"({P1} + {P0}) / 2", "macro_recall": f"({R1} + {R0}) / 2", "macro_f1": f"({F1} + {F0}) / 2",
    "binary_precision": P0, "binary_recall": R0, "binary_f1": F0,
}
ALL = ", ".join(f"round({v}, 6) AS {k}" for k, v in MEASURES.items())
AUC = "SELECT sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) / nullif(count(*), 0) AS auc FROM preds a, preds b WHERE a.y = 1 AND b.y = 0"
AP = "SELECT sum(a * ca / cn) / sum(a) AS ap FROM (SELECT p, a, sum(a) OVER (ORDER BY p DESC) AS ca, sum(n) OVER (ORDER BY p DESC) AS cn FROM (SELECT p, count(*) FILTER (y = 1) AS a, count(*) AS n FROM preds GROUP BY p))"


def at_k(k: float, target: int) -> str:
    order = "p" if target == 0 else "p DESC"
    return f"SELECT avg(CAST(y = {target} AS INTEGER)) FROM (SELECT y, row_number() OVER (ORDER BY {order}, id) AS rn FROM preds) WHERE rn <= (SELECT CAST(floor(count(*) * {k} / 100) AS BIGINT) FROM preds)"


def best(s, sf):
    """Predictions with the year and the days of the modeling table."""
    return V.preds(s, sf).join(V.model(s, sf).select("id", "year", "days"), "id")


def events(s, sf):
    """Review events of pages, from events."""
    e = V.read(s, sf, "events")
    results = F.array(*map(F.lit, ("kept", "demoted", "listed", "delisted", "failed", "passed", "unknown")))
    return e.select((F.col("user_id") % 60).alias("page_id"), F.when(F.col("event_id") % 2 == 0, "far").otherwise("gar").alias("action"), F.get(results, (F.col("event_id") % 7).cast("int")).alias("result"))


EVENTS = """ev AS (SELECT user_id % 60 AS page_id, CASE WHEN event_id % 2 = 0 THEN 'far' ELSE 'gar' END AS action, ['kept', 'demoted', 'listed', 'delisted', 'failed', 'passed', 'unknown'][event_id % 7 + 1] AS result FROM events),
oc AS (SELECT page_id, action, CASE WHEN action = 'far' AND result IN ('demoted', 'failed', 'removed') THEN 0 WHEN action = 'far' AND result IN ('kept', 'pass') THEN 1
 WHEN action = 'gar' AND result IN ('delisted', 'failed', 'not listed', 'fail') THEN 0 WHEN action = 'gar' AND result IN ('kept', 'listed', 'keep', 'passed') THEN 1 END AS outcome FROM ev),
rv AS (SELECT page_id, count(*) AS reviews, CAST(sum(outcome) AS BIGINT) AS passed FROM oc WHERE outcome IS NOT NULL GROUP BY 1)"""
LOAD = f"""{V.PREDS}, {EVENTS}, rf AS (SELECT id AS page_id, y, p, CASE WHEN y = 0 AND reviews IS NULL THEN 1 ELSE coalesce(reviews, 0) END AS reviews, CASE WHEN y = 0 AND reviews IS NULL THEN 1 ELSE coalesce(passed, 0) END AS passed FROM preds LEFT JOIN rv ON rv.page_id = id)"""


def outcomes(s, sf):
    return R.reviews_per_page(R.review_outcomes(events(s, sf)), "ga")


def load(s, sf):
    return R.reindex_fill(V.preds(s, sf).withColumn("page_id", F.col("id")), outcomes(s, sf))


def splits_report(run):
    """Splits' measures in the long form."""
    return run[0].groupBy("measure").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))


def register_all(register) -> None:
    pr, md, P, D = V.preds, V.model, V.PREDS, V.MODEL
    w = lambda cte, body: f"WITH {cte} {body}"
    at = lambda t: f"cf AS (SELECT count(*) FILTER (p > {t} AND y = 1) AS tp, count(*) FILTER (p > {t} AND y = 0) AS fp, count(*) FILTER (p <= {t} AND y = 1) AS fn, count(*) FILTER (p <= {t} AND y = 0) AS tn FROM preds)"
    register("confusion_metrics", lambda s, sf: M.measures(M.confusion(pr(s, sf), 0.5)), w(f"{P}, {at(0.5)}", f"SELECT {ALL} FROM cf"))
    register("threshold_scores", lambda s, sf: M.threshold_scores(pr(s, sf)), w(f"{P}, {CONF}", f"SELECT round(threshold, 6) AS threshold, {ALL} FROM cf"))
    register("find_threshold", lambda s, sf: M.find_threshold(pr(s, sf)), w(f"{P}, {CONF}", f"SELECT CAST(threshold AS DOUBLE) AS threshold, round(m, 6) AS macro_f1 FROM (SELECT threshold, {MEASURES['macro_f1']} AS m FROM cf) ORDER BY round(m, 12) DESC, threshold LIMIT 1"))
    register("rank_auc", lambda s, sf: M.rank_auc(pr(s, sf)), w(P, f"SELECT round(auc, 6) AS auc FROM ({AUC})"))
    register("average_precision", lambda s, sf: M.average_precision(pr(s, sf)), w(P, f"SELECT round(ap, 6) AS average_precision FROM ({AP})"))
    hard = P.replace("preds AS", "preds0 AS", 1) + ", preds AS (SELECT id, y, CAST(p > 0.5 AS DOUBLE) AS p FROM preds0)"
    register("average_precision_compat", lambda s, sf: M.average_precision(pr(s, sf), compat=True), w(hard, f"SELECT round(ap, 6) AS average_precision FROM ({AP})"))
    register("precision_at_k", lambda s, sf: M.precision_at_k(pr(s, sf), 10, target=0), w(P, f"SELECT round(({at_k(10, 0)}), 6) AS precision_at_k"))
    plain = {"macro_accuracy": "accuracy", **{k: k for k in MEASURES if k != "accuracy"}}
    opt = {"macro_accuracy_opt_th": "accuracy", **{f"macro_{m}_opt_th": f"macro_{m}" for m in ("precision", "recall", "f1")}, "binary_accuracy_opt_th": "accuracy", **{f"binary_{m}_opt_th": f"binary_{m}" for m in ("precision", "recall", "f1")}}
    measures = ", ".join(f"round({MEASURES[v]}, 6) AS {k}" for k, v in (plain | opt).items())
    register("eval_measures", lambda s, sf: M.eval_measures(pr(s, sf)), w(f"{P}, {at(0.5)}", f"SELECT (SELECT count(*) FROM preds) AS n, 0.5 AS macro_optimal_th, 0.5 AS binary_optimal_th, {measures}, (SELECT round(auc, 6) FROM ({AUC})) AS auc, (SELECT round(ap, 6) FROM ({AP})) AS average_precision, round(({at_k(2, 0)}), 6) AS binary_prec_at_2_perc, round(({at_k(5, 0)}), 6) AS binary_prec_at_5_perc FROM cf"))
    fold = lambda s, sf: pr(s, sf).select((F.col("id") % 5).alias("fold"), F.lit("p").alias("measure"), F.col("p").alias("value")).groupBy("fold", "measure").agg(F.avg("value").alias("value"))
    register("eval_summary", lambda s, sf: M.eval_summary(fold(s, sf), folds=5), w(P, "SELECT 'p' AS measure, round(m, 6) AS mean, round(sd, 6) AS std, round(m - 2.571 * sd, 3) AS lo, round(m + 2.571 * sd, 3) AS hi FROM (SELECT avg(v) AS m, stddev_pop(v) AS sd FROM (SELECT avg(p) AS v FROM preds GROUP BY id % 5))"))
    groups = "CASE WHEN p > 0.5 AND y = 1 THEN 'TP' WHEN p > 0.5 THEN 'FP' WHEN y = 1 THEN 'FN' ELSE 'TN' END"
    register("confusion_groups", lambda s, sf: M.confusion_groups(pr(s, sf)).select("id", "error_group"), w(P, f"SELECT id, {groups} AS error_group FROM preds"))
    register("top_k_predictions", lambda s, sf: R.top_k(pr(s, sf), 20).select("id", "y", "place"), w(P, "SELECT id, CAST(y AS BIGINT) AS y, place FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY p, id) AS place FROM preds) WHERE place <= 20"))
    register("row_predictions", lambda s, sf: pr(s, sf).select("id", "y", "p", (F.col("p") > 0.5).cast("int").alias("pred")), w(P, "SELECT id, CAST(y AS BIGINT) AS y, p, CAST(p > 0.5 AS BIGINT) AS pred FROM preds"))
    register("join_predictions", lambda s, sf: best(s, sf).orderBy("id"), w(f"{P}, {D}", "SELECT id, CAST(preds.y AS BIGINT) AS y, p, CAST(year AS BIGINT) AS year, days FROM preds JOIN (SELECT id, year, days FROM model) USING (id)"))
    register("sort_rows", lambda s, sf: best(s, sf).orderBy("p", "id").select("id", "p"), w(f"{P}, {D}", "SELECT id, p FROM preds JOIN model USING (id)"))
    # reports
    register("label_distribution", lambda s, sf: R.label_distribution(pr(s, sf), "y"), w(P, "SELECT CAST(y AS BIGINT) AS y, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM preds GROUP BY y"))
    register("feature_by_class", lambda s, sf: R.feature_by_class(md(s, sf), "EDIT_chars", "y"), w(D, "SELECT CAST(y AS BIGINT) AS y, round(avg(EDIT_chars), 6) AS mean, round(median(EDIT_chars), 6) AS median, round(quantile_cont(EDIT_chars, 0.95), 6) AS upper FROM model GROUP BY y"))
    register("dataset_stats", lambda s, sf: R.dataset_stats(md(s, sf), FEATURES), w(D, " UNION ALL ".join(f"SELECT '{c}' AS feature, round(sum({c}), 6) AS sum, round(avg({c}), 6) AS mean, round(median({c}), 6) AS median, round(stddev_samp({c}), 6) AS std FROM model" for c in FEATURES)))
    labels = lambda s, sf: V.read(s, sf, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("y"))
    register("join_topic_labels", lambda s, sf: R.join_topic_labels(V.topics(s, sf), labels(s, sf)).select("page_id", "project_name", "y"), w(V.TOPICS, "SELECT DISTINCT page_id, project_name, CAST(quality AS BIGINT) AS y FROM topics JOIN labels ON doc_id = page_id"))
    register("topic_rate", lambda s, sf: R.topic_rate(V.topics(s, sf), labels(s, sf)), w(V.TOPICS, "SELECT project_name, count(*) AS n, CAST(sum(quality) AS BIGINT) AS sustained, round(avg(quality), 6) AS share FROM topics JOIN labels ON doc_id = page_id GROUP BY 1"))
    register("unmatched_pages_profile", lambda s, sf: labels(s, sf).join(V.topics(s, sf).where("importance is not null"), "page_id", "left_anti").groupBy("y").agg(F.count("*").alias("n")), w(V.TOPICS, "SELECT CAST(quality AS BIGINT) AS y, count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT page_id FROM topics WHERE importance IS NOT NULL) GROUP BY quality"))
    register("join_meta_inner", lambda s, sf: V.topics(s, sf).join(labels(s, sf), "page_id").select("page_id", "project_name", "y"), w(V.TOPICS, "SELECT page_id, project_name, CAST(quality AS BIGINT) AS y FROM topics JOIN labels ON doc_id = page_id"))
    register("lookup_title", lambda s, sf: labels(s, sf).join(V.read(s, sf, "pages").select("page_id", "url"), "page_id", "left").select("page_id", "url"), "SELECT doc_id AS page_id, url FROM labels LEFT JOIN pages ON page_id = doc_id")
    register("semi_page_subset", lambda s, sf: V.topics(s, sf).join(labels(s, sf), "page_id", "left_semi").select("page_id"), w(V.TOPICS, "SELECT page_id FROM topics WHERE page_id IN (SELECT doc_id FROM labels)"))
    register("union_frames", lambda s, sf: V.topics(s, sf).select("page_id").unionByName(labels(s, sf).select("page_id")).groupBy("page_id").agg(F.count("*").alias("n")), "SELECT page_id, count(*) AS n FROM (SELECT doc_id AS page_id FROM documents UNION ALL SELECT doc_id FROM labels) GROUP BY 1")
    blocks = lambda s, sf: [md(s, sf).select(F.col("id").alias("page_id"), "y", F.col("year").alias("TIME_promotion_year"), *FEATURES), R.reviews_per_page(R.review_outcomes(events(s, sf)), "fa")]
    register("join_feature_blocks", lambda s, sf: B.join_blocks(blocks(s, sf)).select("page_id", "y", "reviews"), w(f"{D}, {EVENTS}", "SELECT id AS page_id, CAST(y AS BIGINT) AS y, count(*) AS reviews FROM model JOIN oc ON oc.page_id = id WHERE outcome IS NOT NULL AND action = 'far' GROUP BY 1, 2"))
    register("prefix_columns", lambda s, sf: md(s, sf).select("id", *(F.col(c).alias(f"SPECIAL_{c}") for c in ("days", "EDIT_lines"))), w(D, "SELECT id, days AS SPECIAL_days, EDIT_lines AS SPECIAL_EDIT_lines FROM model"))
    register("review_outcomes", lambda s, sf: R.reviews_per_page(R.review_outcomes(events(s, sf)), "ga"), w(EVENTS, "SELECT page_id, reviews, passed FROM rv"))
    register("reindex_fill", lambda s, sf: load(s, sf).select("page_id", "reviews", "passed"), w(LOAD, "SELECT page_id, reviews, passed FROM rf"))
    load_sql = f"{LOAD}, gr AS (SELECT unnest([{groups}, CASE WHEN {groups} IN ('TN', 'FN') THEN 'negatives' ELSE 'positives' END, 'all']) AS g, reviews FROM rf)"
    register("review_load_by_group", lambda s, sf: R.review_load_by_group(M.confusion_groups(load(s, sf))), w(load_sql, 'SELECT g AS "group", round(avg(reviews), 6) AS mean, round(stddev_pop(reviews), 6) AS std, count(*) AS n, round(1.96 * stddev_pop(reviews) / sqrt(count(*)), 6) AS half_width FROM gr GROUP BY g'))
    pops = lambda s, sf: {n: pr(s, sf).where(c).select(F.col("id").alias("page_id")) for n, c in (("all", "true"), ("low", "p < 0.3"), ("demoted", "y = 0"))}
    register("review_comparison", lambda s, sf: R.review_comparison(pops(s, sf), outcomes(s, sf)), w(f"{P}, {EVENTS}", " UNION ALL ".join(f"SELECT id AS page_id, '{n}' AS population, CAST(reviews IS NOT NULL AS BIGINT) AS was_reviewed, coalesce(reviews, 0) AS num_reviews FROM preds LEFT JOIN rv ON rv.page_id = id WHERE {c}" for n, c in (("all", "true"), ("low", "p < 0.3"), ("demoted", "y = 0")))))
    qs = lambda c: f"list_sort(list_distinct(quantile_cont({c}, [{', '.join(str(i / 8) for i in range(9))}])))"
    bin_ = lambda c, q: f"len(list_filter({q}[2:len({q}) - 1], lambda x: {c} > x))"
    ed = f"{D}, q AS (SELECT {qs('EDIT_chars')} AS qa, {qs('NETWORK_hash')} AS qb FROM model), bn AS (SELECT id, y, {bin_('EDIT_chars', 'qa')} AS a, {bin_('NETWORK_hash', 'qb')} AS b, qa FROM model, q)"
    register("qcut_bins", lambda s, sf: R.qcut_bins(md(s, sf), "EDIT_chars", whole=True).select("id", "bin", "label"), w(ed, "SELECT id, a AS bin, '[' || CAST(trunc(qa[a + 1]) AS BIGINT) || ', ' || CAST(trunc(qa[a + 2]) AS BIGINT) || ')' AS label FROM bn"))
    register("bin_heatmap", lambda s, sf: R.bin_heatmap(md(s, sf), "EDIT_chars", "NETWORK_hash", "y", least=3), w(ed, "SELECT a AS bin_a, b AS bin_b, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(avg(1 - y), 6) END AS lost FROM bn GROUP BY ALL"))
    dec = f"{D}, dl AS (SELECT quantile_cont(days, [{', '.join(str(i / 10) for i in range(1, 11))}]) AS q FROM model), dc AS (SELECT unnest(range(1, 11)) AS decile, CAST(trunc(unnest(q)) AS BIGINT) AS cutoff FROM dl)"
    register("decile_cutoffs", lambda s, sf: R.decile_cutoffs(md(s, sf), "days"), w(dec, "SELECT decile, cutoff FROM dc"))
    register("relabel_by_cutoff", lambda s, sf: R.relabel_by_cutoff(md(s, sf), R.decile_cutoffs(md(s, sf), "days"), "days").select("id", "decile", "relabelled"), w(dec, "SELECT id, decile, CAST(CASE WHEN days <= cutoff THEN 0 ELSE 1 END AS BIGINT) AS relabelled FROM model, dc"))
    rk = lambda c: f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"
    register("spearman_corr", lambda s, sf: R.spearman(best(s, sf), "p", "days"), w(f"{P}, {D}", f"SELECT round(corr(a, b), 6) AS spearman FROM (SELECT {rk('p')} AS a, {rk('days')} AS b FROM preds JOIN model USING (id) WHERE days IS NOT NULL)"))
    register("density_curve", lambda s, sf: R.density_curve(md(s, sf), "EDIT_chars", "y"), w(f"{D}, st AS (SELECT y, count(*) AS k, stddev_samp(EDIT_chars) * count(*) ** -0.2 AS h, min(EDIT_chars) AS lo, max(EDIT_chars) AS hi FROM model GROUP BY y), gd AS (SELECT *, unnest(range(0, 20)) AS i FROM st), gx AS (SELECT *, lo + (hi - lo) * i / 19 AS x FROM gd)", "SELECT CAST(m.y AS BIGINT) AS y, i, round(x, 6) AS x, round(sum(exp(-(((x - EDIT_chars) / h) ** 2) / 2)) / any_value(k * h * 2.5066282746310002), 6) AS density FROM model m JOIN gx ON gx.y = m.y GROUP BY ALL"))
    lift = lambda s, sf: pr(s, sf).groupBy((F.col("id") % 4).alias("g")).agg(F.avg("p").alias("f1"), F.stddev_samp("p").alias("f1_std"), F.max("p").alias("auc"), F.stddev_pop("p").alias("auc_std"), (1 - F.avg("y")).alias("minority"))
    register("normalize_lift", lambda s, sf: R.normalize_lift(lift(s, sf)).select("g", "f1_lift", "auc_lift", "f1_bar", "auc_bar"), w(P, "SELECT id % 4 AS g, round((avg(p) - 1 + avg(y)) / nullif(1 - avg(y), 0), 6) AS f1_lift, round((max(p) - 0.5) / 0.5, 6) AS auc_lift, round(1.96 * stddev_samp(p) / 10 / nullif(1 - avg(y), 0), 6) AS f1_bar, round(1.96 * stddev_pop(p) / 10 / 0.5, 6) AS auc_bar FROM preds GROUP BY 1"))
    contrib = lambda s, sf: pr(s, sf).select("id", F.explode(F.array(*(F.struct(F.lit(f"f{i}").alias("feature"), (F.col("p") * (i - 5) - (F.col("id") % (i + 2)) / 10).alias("contribution")) for i in range(12)))).alias("e"), "y").select("id", "e.*", "y")
    register("contribution_summary", lambda s, sf: R.contribution_summary(contrib(s, sf)), w(P, "SELECT 'f' || i AS feature, round(avg(abs(p * (i - 5) - (id % (i + 2)) / 10)), 6) AS strength, CAST(sign(avg(p * (i - 5) - (id % (i + 2)) / 10) FILTER (y = 1)) AS DOUBLE) AS direction FROM preds, range(0, 12) t(i) GROUP BY i ORDER BY 2 DESC, 1 LIMIT 10"))
    # modeling
    register("select_feature_groups", lambda s, sf: md(s, sf).select("id", *B.select_feature_groups(md(s, sf).columns, off=("NETWORK_",), target="y")), w(D, "SELECT id, CAST(year AS BIGINT) AS year, days, EDIT_chars, EDIT_lines, COMPOSITION_words FROM model"))
    md5 = lambda salt: f"md5('{salt}|' || id)"
    placed = lambda salt: f"pl AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {md5(salt)}, id) - 1 AS rk, count(*) OVER (PARTITION BY y) AS sz FROM model)"
    register("stratified_kfold", lambda s, sf: B.stratified_kfold(md(s, sf)).select("id", "y", "fold"), w(f"{D}, {placed(1984)}", "SELECT id, CAST(y AS BIGINT) AS y, rk % 5 AS fold FROM pl"))
    register("stratified_holdout", lambda s, sf: B.stratified_holdout(md(s, sf)).select("id", "is_test"), w(f"{D}, {placed('1984|holdout')}", "SELECT id, rk + 1 <= ceil(sz * 0.3) AS is_test FROM pl"))
    register("stratified_bootstrap", lambda s, sf: B.stratified_bootstrap(md(s, sf).select("id", "y")).groupBy("replicate", "y").agg(F.count("*").alias("n"), F.sum(F.col("is_test").cast("long")).alias("test"), F.sum(F.when(F.col("is_test"), F.col("id"))).alias("ids")), w(f"{D}, bs AS (SELECT i AS replicate, id, y, row_number() OVER (PARTITION BY i, y ORDER BY md5('1984|' || i || '|' || id), id) <= ceil(count(*) OVER (PARTITION BY i, y) * 0.2) AS t FROM model, range(0, 100) r(i))", "SELECT replicate, CAST(y AS BIGINT) AS y, count(*) AS n, CAST(count(*) FILTER (t) AS BIGINT) AS test, CAST(sum(id) FILTER (t) AS BIGINT) AS ids FROM bs GROUP BY ALL"))
    register("mean_impute", lambda s, sf: B.mean_impute(md(s, sf).withColumn("days", F.col("days").cast("double")), md(s, sf).withColumn("days", F.col("days").cast("double")), ["days"]).select("id", "days"), w(D, "SELECT id, round(coalesce(days, avg(days) OVER ()), 6) AS days FROM model"))
    register("year_buckets", lambda s, sf: B.year_buckets(md(s, sf)), w(f"RECURSIVE {D}, {BUCKETS}", "SELECT CAST(year AS BIGINT) AS year, CAST(bucket AS BIGINT) AS bucket FROM buckets"))
    register("article_features", lambda s, sf: B.article_features(V.revisions(s, sf), life(s, sf), "fa")[0], article_sql())
    modeling = f"{D}, {V.TOPICS}, od AS (SELECT o_custkey AS page_id, count(*) AS EDIT_orders FROM orders GROUP BY 1), tt AS (SELECT DISTINCT project_name AS t FROM topics)"
    register("build_modeling_table", modeling_table, w(modeling, "SELECT m.id AS page_id, CAST(m.y AS BIGINT) AS y, CAST(m.year AS BIGINT) AS TIME_promotion_year, EDIT_orders, 'TOPIC_i_' || replace(lower(t), ' ', '_') AS topic, CAST(CASE WHEN t <> project_name THEN 0 WHEN importance = 'low' THEN 1 WHEN importance = 'mid' THEN 2 WHEN importance = 'high' THEN 4 WHEN importance = 'top' THEN 5 ELSE 3 END AS BIGINT) AS v FROM model m JOIN od ON od.page_id = m.id JOIN topics ON topics.page_id = m.id, tt WHERE m.year <= 2016"))
    # Learners. All jobs are registered at their published sizes, on real features; their SQL writes out the same Newton steps and tree levels.
    lr = dict(learner="lr")
    M1 = f"{D.replace('model AS', 'model0 AS', 1)}, model AS (SELECT *, [{', '.join(f'CAST({c} AS DOUBLE)' for c in JOB)}] AS x FROM model0)"
    holdout = f"{placed('1984|holdout')}, splits AS (SELECT 0 AS fold, id, y, x, rk + 1 <= ceil(sz * 0.3) AS is_test FROM pl)"
    def held(s, sf, **how):
        h = B.stratified_holdout(md(s, sf))
        return B.fold_run(h.where("not is_test"), h.where("is_test"), JOB, **how)
    register("train_lr", lambda s, sf: held(s, sf, **lr)[1], w(f"{M1}, {holdout}, {EVALUATED}", "SELECT id, p, y, CAST(p > binary_optimal_th AS BIGINT) AS pred FROM te JOIN bt USING (fold)"))
    register("fold_run", lambda s, sf: held(s, sf, **lr)[0], w(f"{M1}, {holdout}, {EVALUATED}", "SELECT " + rounded("") + " FROM ev"))
    chosen = f"tc AS ({counts_at('threshold', f'tr, {CUTS}', 'fold, threshold')}), bt AS ({best_at('binary_f1', 'binary_optimal_th')})"
    for learner, cte in (("gbt", T.boosted(len(JOB), TREES)), ("rf", T.forest(len(JOB), TREES))):
        register(f"train_{learner}", lambda s, sf, learner=learner: held(s, sf, learner=learner, trees=TREES)[1], w(f"RECURSIVE {M1}, {holdout}, {cte}, {chosen}", "SELECT id, p, y, CAST(p > binary_optimal_th AS BIGINT) AS pred FROM te JOIN bt USING (fold)"))
    jobs = {}
    folds = f"{placed(1984)}, fo AS (SELECT *, rk % 5 AS f FROM pl), splits AS (SELECT k AS fold, id, y, x, f = k AS is_test FROM fo, range(5) t(k))"
    jobs["cv_job"] = (lambda s, sf: B.cv_job(md(s, sf), JOB, **lr), M1, folds)
    jobs["bootstrap_job"] = (lambda s, sf: B.bootstrap_job(md(s, sf), JOB, **lr), M1, "splits AS (SELECT i AS fold, id, y, x, row_number() OVER (PARTITION BY i, y ORDER BY md5('1984|' || i || '|' || id), id) <= ceil(count(*) OVER (PARTITION BY i, y) * 0.2) AS is_test FROM model, range(100) t(i))")
    register("feature_importance_sum", lambda s, sf: B.cv_job(md(s, sf), JOB, learner="rf", trees=TREES)[2], w(f"{M1}, {folds}, {T.forest(len(JOB), TREES)}", "SELECT [" + ", ".join(f"'{c}'" for c in JOB) + "][j] AS feature, round(sum(share), 6) AS importance FROM (SELECT fold, j, sum(gain) / sum(sum(gain)) OVER (PARTITION BY fold) AS share FROM gn GROUP BY fold, j) GROUP BY j"))
    by_bucket = f"{BUCKETS}, mb AS (SELECT * FROM model JOIN buckets USING (year))"
    jobs["cv_by_time"] = (lambda s, sf: B.cv_by_time(md(s, sf), JOB, **lr), M1, f"{by_bucket}, splits AS (SELECT k AS fold, id, y, x, bucket = k AS is_test FROM mb, (SELECT DISTINCT bucket AS k FROM buckets))")
    jobs["per_period_holdout"] = (lambda s, sf: B.per_period_holdout(md(s, sf), JOB, **lr), M1, f"{by_bucket}, splits AS (SELECT bucket AS fold, id, y, x, row_number() OVER (PARTITION BY bucket, y ORDER BY md5('1984|holdout|' || id), id) <= ceil(count(*) OVER (PARTITION BY bucket, y) * 0.3) AS is_test FROM mb)")
    for name, (run, cte, splits) in jobs.items():
        register(name, lambda s, sf, run=run: splits_report(run(s, sf)), w(f"RECURSIVE {cte}, {splits}, {EVALUATED}", REPORT))
    years = "yr AS (SELECT row_number() OVER (ORDER BY year) AS i, year AS cutoff FROM (SELECT DISTINCT year FROM model WHERE year IS NOT NULL))"
    upto = "up AS (SELECT cutoff, m.*, row_number() OVER (PARTITION BY cutoff, y ORDER BY md5('1984|' || id), id) - 1 AS rk FROM model m JOIN yr ON m.year <= cutoff AND i >= 3)"
    register("expanding_year_eval", lambda s, sf: B.expanding_year_eval(md(s, sf), JOB, **lr), w(f"{M1}, {years}, {upto}, splits AS (SELECT cutoff * 5 + k AS fold, id, y, x, rk % 5 = k AS is_test FROM up, range(5) t(k)), {EVALUATED}, {LONG}", "SELECT CAST(fold % 5 AS BIGINT) AS fold, measure, round(value, 6) AS value, CAST(fold // 5 AS BIGINT) AS year FROM long"))
    def sliding(s, sf):
        rows, out = md(s, sf), None
        for move in (False, True):
            m = B.sliding_year_eval(rows, JOB, move=move, **lr).withColumn("moving", F.lit(move))
            out = m if out is None else out.unionByName(m)
        return out
    slide = "splits AS (SELECT cutoff * 10 + v AS fold, id, y, x, year > cutoff AS is_test FROM model, yr, range(2) t(v) WHERE i >= 3 AND (v = 0 OR year >= cutoff - 3)), ok AS (SELECT fold FROM splits GROUP BY 1 HAVING count(DISTINCT y) FILTER (is_test) = 2 AND count(DISTINCT y) FILTER (NOT is_test) = 2)"
    register("sliding_year_eval", sliding, w(f"{M1}, {years}, {slide.replace('splits AS', 's0 AS', 1).replace('FROM splits', 'FROM s0')}, splits AS (SELECT s0.* FROM s0 JOIN ok USING (fold)), {EVALUATED}, {LONG}", "SELECT CAST(fold // 10 AS BIGINT) AS year, measure, round(value, 6) AS value, fold % 10 = 1 AS moving FROM long"))
    cohort = "splits AS (SELECT 0 AS fold, id, y, x, year > 2014 AS is_test FROM model)"
    register("future_cohort_eval", lambda s, sf: B.future_cohort_eval(md(s, sf), JOB, max_year=2014, **lr), w(f"{M1}, {cohort}, {PREDICTED}", "SELECT count(*) AS n, round(avg(CAST(y = 0 AS INTEGER)), 6) AS precision FROM (SELECT y, row_number() OVER (ORDER BY p, id) AS rn, count(*) OVER () AS k FROM te) WHERE rn <= greatest(1, CAST(floor(k * 0.05) AS BIGINT))"))
    ablation = folds.replace("x, f = k", "CASE WHEN v = 0 THEN [x[1], x[2], NULL, NULL, NULL] ELSE x END AS x, f = k").replace("k AS fold", "v * 10 + k AS fold").replace("FROM fo, range(5) t(k)", "FROM fo, range(5) t(k), range(2) u(v)")
    register("ablation_compare", lambda s, sf: B.ablation_compare(md(s, sf), {"edits": JOB[:2], "all": JOB}, **lr), w(f"{M1}, {ablation}, {EVALUATED}, {LONG}", "SELECT CASE WHEN fold < 10 THEN 'edits' ELSE 'all' END AS model, measure, round(avg(value), 6) AS mean FROM long GROUP BY ALL"))
    relabelled = f"{dec.replace(D, M1)}, re AS (SELECT id, [x[1], x[2], x[3], x[4], NULL] AS x, decile, CASE WHEN days <= cutoff THEN 0 ELSE 1 END AS y FROM model, dc), pl AS (SELECT *, row_number() OVER (PARTITION BY decile, y ORDER BY md5('1984|' || id), id) - 1 AS rk FROM re), mixed AS (SELECT decile FROM re GROUP BY 1 HAVING min(y) < max(y))"
    register("decile_relabel_eval", lambda s, sf: B.decile_relabel_eval(md(s, sf), FEATURES, "days", **lr), w(f"{relabelled}, splits AS (SELECT decile * 5 + k AS fold, id, y, x, rk % 5 = k AS is_test FROM pl JOIN mixed USING (decile), range(5) t(k)), {EVALUATED}, {LONG}", "SELECT CAST(fold // 5 AS BIGINT) AS decile, measure, count(value) AS n, round(avg(value), 6) AS mean FROM long GROUP BY ALL"))
    each = f"splits AS (SELECT j AS fold, id, y, [x[j]] AS x, false AS is_test FROM model, range(1, {len(JOB) + 1}) t(j) WHERE x[j] IS NOT NULL)"
    number = " ".join(f"WHEN {j} THEN '{c}'" for j, c in enumerate(JOB, 1))
    register("univariate_logit", lambda s, sf: B.univariate_logit(md(s, sf), JOB), w(f"{M1}, {each}, {N.newton(1, B.LOGIT_STEPS, 0)}, {N.coefficients(1, B.LOGIT_STEPS, ['x'])}", f"SELECT CASE fold {number} END AS feature, round(coefficient, 6) AS coefficient, round(p_value, 6) AS p_value FROM pv"))
    whole = f"splits AS (SELECT 0 AS fold, id, y, x, false AS is_test FROM model WHERE {' AND '.join(f'x[{j}] IS NOT NULL' for j in range(1, len(JOB) + 1))})"
    register("multivariate_logit", lambda s, sf: B.multivariate_logit(md(s, sf), JOB), w(f"{M1}, {whole}, {N.newton(len(JOB), B.LOGIT_STEPS, 0)}, {N.coefficients(len(JOB), B.LOGIT_STEPS, JOB)}", "SELECT feature, round(coefficient, 6) AS coefficient, round(p_value, 6) AS p_value FROM pv WHERE p_value < 0.01"))


BUCKETS = """yc AS (SELECT row_number() OVER (ORDER BY year) AS i, year, count(*) AS n FROM model WHERE year IS NOT NULL GROUP BY year),
yb AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS INTEGER) AS year, 0 AS bucket, CAST(0 AS BIGINT) AS held UNION ALL
 SELECT yc.i, yc.year, CASE WHEN held + n > 1.2 * (SELECT sum(n) FROM yc) / 5 AND bucket < 4 THEN bucket + 1 ELSE bucket END, CASE WHEN held + n > 1.2 * (SELECT sum(n) FROM yc) / 5 AND bucket < 4 THEN n ELSE held + n END FROM yb JOIN yc ON yc.i = yb.i + 1),
buckets AS (SELECT year, bucket FROM yb WHERE year IS NOT NULL)"""
PREDICTED = N.predicted(len(JOB), STEPS, RIDGE)
KEPT = {c: c for c in ("macro_precision", "macro_recall", "macro_f1", "binary_precision", "binary_recall", "binary_f1")}
OPT = {f"{kind}_{m}_opt_th": f"{kind}_{m}" if m != "accuracy" else m for kind in ("macro", "binary") for m in ("accuracy", "precision", "recall", "f1")}


def counts_at(threshold: str, source: str, by: str) -> str:
    return f"SELECT {by}, count(*) FILTER (p > {threshold} AND y = 1) AS tp, count(*) FILTER (p > {threshold} AND y = 0) AS fp, count(*) FILTER (p <= {threshold} AND y = 1) AS fn, count(*) FILTER (p <= {threshold} AND y = 0) AS tn FROM {source} GROUP BY ALL"


def of_measures(names: dict[str, str], source: str) -> str:
    return f"SELECT fold, {', '.join(f'{MEASURES[m]} AS {n}' for n, m in names.items())} FROM ({source})"


def best_at(measure: str, name: str) -> str:
    return f"SELECT fold, CAST(threshold AS DOUBLE) AS {name} FROM (SELECT fold, threshold, row_number() OVER (PARTITION BY fold ORDER BY round({MEASURES[measure]}, 12) DESC, threshold) AS rn FROM (SELECT * FROM tc)) WHERE rn = 1"


def top_share(k: int) -> str:
    return f"SELECT fold, avg(CAST(y = 0 AS INTEGER)) AS binary_prec_at_{k}_perc FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY p, id) AS rn, count(*) OVER (PARTITION BY fold) AS m FROM te) WHERE rn <= floor(m * {k} / 100) GROUP BY fold"


EVALUATED = f"""{PREDICTED}, tc AS ({counts_at('threshold', f'tr, {CUTS}', 'fold, threshold')}), mt AS ({best_at('macro_f1', 'macro_optimal_th')}), bt AS ({best_at('binary_f1', 'binary_optimal_th')}),
ev AS (SELECT * FROM (SELECT fold, count(*) AS n FROM te GROUP BY 1) JOIN mt USING (fold) JOIN bt USING (fold) JOIN ({of_measures({'macro_accuracy': 'accuracy'} | KEPT, counts_at('0.5', 'te', 'fold'))}) USING (fold)
 JOIN ({of_measures({k: v for k, v in OPT.items() if k.startswith('macro')}, counts_at('macro_optimal_th', 'te JOIN mt USING (fold)', 'fold'))}) USING (fold) JOIN ({of_measures({k: v for k, v in OPT.items() if k.startswith('binary')}, counts_at('binary_optimal_th', 'te JOIN bt USING (fold)', 'fold'))}) USING (fold)
 LEFT JOIN (SELECT a.fold, avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) AS auc FROM te a JOIN te b USING (fold) WHERE a.y = 1 AND b.y = 0 GROUP BY 1) USING (fold)
 LEFT JOIN (SELECT fold, sum(a * ca / cn) / nullif(sum(a), 0) AS average_precision FROM (SELECT fold, a, sum(a) OVER w AS ca, sum(n) OVER w AS cn FROM (SELECT fold, p, count(*) FILTER (y = 1) AS a, count(*) AS n FROM te GROUP BY ALL) WINDOW w AS (PARTITION BY fold ORDER BY p DESC)) GROUP BY 1) USING (fold)
 LEFT JOIN ({top_share(2)}) USING (fold) LEFT JOIN ({top_share(5)}) USING (fold))"""
COLUMNS = ["n", "macro_optimal_th", "binary_optimal_th", "macro_accuracy", *KEPT, *OPT, "auc", "average_precision", "binary_prec_at_2_perc", "binary_prec_at_5_perc"]
LONG = "long AS (SELECT fold, unnest([" + ", ".join(f"'{c}'" for c in COLUMNS) + "]) AS measure, unnest([" + ", ".join(f"CAST({c} AS DOUBLE)" for c in COLUMNS) + "]) AS value FROM ev)"
REPORT = f"SELECT measure, count(value) AS n, round(avg(value), 6) AS mean FROM (WITH {LONG} FROM long) GROUP BY 1"


def rounded(_: str) -> str:
    return "n, " + ", ".join(f"round({c}, 6) AS {c}" for c in COLUMNS[1:])


def modeling_table(s, sf):
    """The joined blocks with all topic columns, one row for each page and topic."""
    orders = V.read(s, sf, "orders").groupBy(F.col("o_custkey").alias("page_id")).agg(F.count("*").alias("EDIT_orders"))
    rows = V.model(s, sf).select(F.col("id").alias("page_id"), "y", F.col("year").alias("TIME_promotion_year"), *FEATURES)
    out = B.build_modeling_table([rows, orders], V.topics(s, sf), max_year=2016)
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("topic"), F.col(c).alias("v")) for c in out.columns if c.startswith("TOPIC_")))).alias("e")
    return out.select("page_id", "y", "TIME_promotion_year", "EDIT_orders", cells).select("page_id", "y", "TIME_promotion_year", "EDIT_orders", "e.*")


def article_sql() -> str:
    from . import lifecycle_queries as Q
    from . import page_queries as P

    fd, iso = Q.fd, Q.iso
    good = "good AS (SELECT *, fa_promotion AS promotion FROM life WHERE fa_promotion IS NOT NULL AND is_valid)"
    edits = "edits AS (SELECT page_id, rev_id, ts, user_id FROM revisions JOIN good USING (page_id) WHERE ts < promotion)"
    edit = f"""SELECT page_id, {iso('max(ts)')} AS TIME_last_revision_timestamp, count(DISTINCT user_id) AS EDIT_num_authors, round(count(DISTINCT user_id) / greatest(1, count(*)), 6) AS EDIT_num_authors_normalized, count(*) AS EDIT_num_revisions,
 round(count(*) / greatest(1, {fd('max(ts)', 'min(ts)')}), 6) AS EDIT_num_revisions_normalized, min({fd('promotion', 'creation')}) AS EDIT_time_to_promotion, CAST(CAST(min(coalesce(ga_promotion < promotion, FALSE)) AS INTEGER) AS BIGINT) AS EDIT_used_to_be_good,
 round(avg(CAST(user_id IS NULL AS INTEGER)), 6) AS COMPOSITION_anonymous_share, round(count(*) - 1, 6) AS COMPOSITION_revert_share FROM edits JOIN good USING (page_id) GROUP BY page_id"""
    uc = "uc AS (SELECT page_id, user_id, count(*) AS n FROM edits WHERE user_id IS NOT NULL GROUP BY ALL)"
    gini = "SELECT a.page_id, round(sum(abs(a.n - b.n)) / 2.0 / any_value(k * k) / any_value(mu), 6) AS COMPOSITION_gini FROM uc a JOIN uc b ON a.page_id = b.page_id JOIN (SELECT page_id, count(*) AS k, avg(n) AS mu FROM uc GROUP BY 1) z ON z.page_id = a.page_id GROUP BY a.page_id"
    base = f"SELECT page_id, CAST(CAST(label AS INTEGER) AS BIGINT) AS y, {iso('promotion')} AS TIME_promotion_date, {iso('fa_demotion')} AS TIME_demotion_date, year(promotion) AS TIME_promotion_year, fa_promotion_to_demotion AS TIME_days_to_demotion FROM good"
    return f"WITH RECURSIVE {Q.MERGED}, {good}, {edits}, {P.GRAPH}, {P.DEGREES}, {P.HOPS}, {P.CUTS}, {uc} SELECT * FROM ({base}) LEFT JOIN ({edit}) USING (page_id) LEFT JOIN ({gini}) USING (page_id) LEFT JOIN ({P.network_sql()}) USING (page_id)"
