"""Queries of scans, filters and the life-cycle."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..operators import edits as E
from ..operators import lifecycle as L
from ..sources import files as S
from . import views as V


def fd(a: str, b: str) -> str:
    return f"CAST(floor((epoch({a}) - epoch({b})) / 86400) AS BIGINT)"


def iso(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%SZ')"


RUNS = f"""{V.REVISIONS},
o AS (SELECT *, lag(level) OVER w AS pl, lag(ts) OVER w AS pt FROM revisions WINDOW w AS (PARTITION BY page_id ORDER BY ts, rev_id)),
g AS (SELECT *, CASE WHEN pt IS NULL THEN 0 ELSE greatest(0, {fd('ts', 'pt')}) END AS days, CASE WHEN pt IS NOT NULL AND level IS DISTINCT FROM pl THEN 1 ELSE 0 END AS ch FROM o),
m AS (SELECT *, CAST(sum(ch) OVER (PARTITION BY page_id ORDER BY ts, rev_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM g),
runs AS (SELECT page_id, run, min(level) AS level, count(*) AS n_revisions, CAST(sum(CASE WHEN ch = 1 THEN 0 ELSE days END) AS BIGINT) AS n_days, min(ts) AS start,
 first(rev_id ORDER BY ts, rev_id) AS start_rev FROM m GROUP BY page_id, run)"""
CHANGES = f"""{RUNS},
cx AS (SELECT page_id, run, start_rev, start AS ts, lag(level) OVER v AS from_level, level AS to_level, coalesce(lag(n_revisions) OVER v, 1) AS revisions_in_prev,
 coalesce(lag(n_days) OVER v, 0) AS days_in_prev, n_revisions AS revisions_in_to, n_days AS days_in_to FROM runs WINDOW v AS (PARTITION BY page_id ORDER BY run)),
changes AS (SELECT *, revisions_in_prev >= 5 OR days_in_prev >= 30 AS sig_from, revisions_in_to >= 5 OR days_in_to >= 30 AS sig_to FROM cx WHERE run > 0 OR to_level IS NOT NULL)"""
DATES = f"""{CHANGES},
fa AS (SELECT page_id, min(ts) FILTER (from_level IS NULL AND to_level = 'ga') AS ga_promotion, min(ts) FILTER (to_level = 'fa') AS fa_promotion,
 min(ts) FILTER (from_level = 'fa') AS fa_demotion, min(ts) FILTER (from_level = 'ga' AND to_level IS NULL) AS ga_down FROM changes WHERE sig_to GROUP BY page_id),
dates AS (SELECT page_id, ga_promotion, CASE WHEN fa_demotion IS NULL THEN ga_down WHEN ga_promotion < fa_demotion THEN fa_demotion END AS ga_demotion, fa_promotion, fa_demotion FROM fa)"""
TIMELINE = f"""{DATES},
lv AS (SELECT page_id, min(ts) AS creation, max(ts) AS last_revision, last(level ORDER BY ts, rev_id) AS latest_level FROM revisions GROUP BY page_id),
timeline AS (SELECT lv.*, {fd('last_revision', 'creation')} AS age_in_days, ga_promotion, ga_demotion, fa_promotion, fa_demotion,
 fa_demotion IS NULL AND ga_demotion IS NULL AS is_sustainable FROM lv LEFT JOIN dates USING (page_id))"""
TALK = TIMELINE + ",\ntalk AS (SELECT page_id, " + ", ".join(f"{u}_{e} + to_days(CAST(page_id % 90 - 45 AS INTEGER)) AS talkpage_{u}_{e}" for u in ("fa", "ga") for e in ("promotion", "demotion")) + " FROM timeline WHERE page_id % 7 <> 0)"
BOTH = TALK + ",\nboth_sources AS (SELECT lv.*, " + f"{fd('last_revision', 'creation')} AS age_in_days, " + ", ".join(f"{u}_{e} AS dumps_{u}_{e}, talkpage_{u}_{e}" for u in ("fa", "ga") for e in ("promotion", "demotion")) + " FROM lv LEFT JOIN dates USING (page_id) LEFT JOIN talk USING (page_id))"


def valid_sql(u: str) -> str:
    out = []
    for s, k in (("talkpage", "talk"), ("dumps", "dump")):
        p, d = f"{s}_{u}_promotion", f"{s}_{u}_demotion"
        wrong = f"coalesce({p} > creation AND {d} > creation AND {d} <= {p}, FALSE)"
        out += [f"coalesce({x} > creation, FALSE) AND NOT {wrong} AS {k}_{e}_ok" for x, e in ((p, "p"), (d, "d"))]
    return ", ".join(out)


def near(u: str, e: str) -> str:
    a, b = f"talkpage_{u}_{e}", f"dumps_{u}_{e}"
    return f"coalesce(least(abs({fd(a, b)}), abs({fd(b, a)})) <= 30, FALSE)"


def merge_sql(u: str, source: str) -> str:
    return f"""(SELECT *, CASE WHEN tp THEN talkpage_{u}_promotion WHEN down_both OR neither THEN dumps_{u}_promotion END AS {u}_promotion,
 CASE WHEN (tp AND td) OR down_both THEN talkpage_{u}_demotion WHEN up_both OR (neither AND dd) THEN dumps_{u}_demotion END AS {u}_demotion,
 CASE WHEN up_both OR down_both THEN 'both' WHEN tp THEN 'talkpage' WHEN neither THEN 'dumps' END AS {u}_source
 FROM (SELECT *, tp AND NOT td AND dd AND {near(u, 'promotion')} AS up_both, NOT tp AND td AND {near(u, 'demotion')} AS down_both, NOT tp AND NOT td AND dp AS neither
 FROM (SELECT *, talk_p_ok AS tp, talk_d_ok AS td, dump_p_ok AS dp, dump_d_ok AS dd FROM (SELECT *, {valid_sql(u)} FROM {source}))))"""


MERGED = f"""{BOTH}, {V.LISTS},
m_fa AS (SELECT * EXCLUDE (talk_p_ok, talk_d_ok, dump_p_ok, dump_d_ok, tp, td, dp, dd, up_both, down_both, neither) FROM {merge_sql('fa', 'both_sources')}),
m_ga AS (SELECT * EXCLUDE (talk_p_ok, talk_d_ok, dump_p_ok, dump_d_ok, tp, td, dp, dd, up_both, down_both, neither) FROM {merge_sql('ga', 'm_fa')}),
inh AS (SELECT * REPLACE (CASE WHEN coalesce(ga_promotion < fa_promotion, FALSE) AND ga_demotion IS NULL THEN fa_demotion ELSE ga_demotion END AS ga_demotion),
 coalesce(ga_promotion < fa_promotion, FALSE) AS promoted_to_ga_then_fa FROM m_ga),
dur AS (SELECT *, {fd('fa_promotion', 'creation')} AS birth_to_fa_promotion, {fd('ga_promotion', 'creation')} AS birth_to_ga_promotion,
 {fd('fa_demotion', 'fa_promotion')} AS fa_promotion_to_demotion, {fd('ga_demotion', 'ga_promotion')} AS ga_promotion_to_demotion FROM inh),
life AS (SELECT *, fa_demotion IS NULL AND ga_demotion IS NULL AS is_sustainable,
 NOT (coalesce(fa_promotion < creation, FALSE) OR coalesce(fa_demotion < fa_promotion, FALSE) OR coalesce(ga_promotion < creation, FALSE) OR coalesce(ga_demotion < ga_promotion, FALSE)
 OR coalesce(birth_to_fa_promotion < 0, FALSE) OR coalesce(birth_to_ga_promotion < 0, FALSE) OR coalesce(fa_promotion_to_demotion < 0, FALSE) OR coalesce(ga_promotion_to_demotion < 0, FALSE) OR age_in_days < 0) AS is_valid,
 NOT (page_id IN (SELECT page_id FROM lists WHERE type LIKE 'former%') OR (fa_demotion IS NOT NULL AND coalesce(fa_source, 'talkpage') = 'talkpage') OR (ga_demotion IS NOT NULL AND coalesce(ga_source, 'talkpage') = 'talkpage')) AS label,
 CASE WHEN fa_promotion IS NOT NULL AND ga_promotion IS NOT NULL THEN 'both' WHEN fa_promotion IS NOT NULL THEN 'fa' WHEN ga_promotion IS NOT NULL THEN 'ga' END AS usecase FROM dur)"""


def both_sources(spark, sf):
    r = V.revisions(spark, sf)
    d = L.first_significant_transitions(L.level_changes_to(L.level_runs(r)))
    d = d.withColumnsRenamed({f"{u}_{e}": f"dumps_{u}_{e}" for u in L.LEVELS for e in ("promotion", "demotion")})
    return L.latest_level(r).join(d, "page_id", "left").join(V.talk_dates(spark, sf), "page_id", "left")


def life(spark, sf):
    return L.lifecycle_build(V.revisions(spark, sf), V.talk_dates(spark, sf), V.lists(spark, sf))


def until(spark, sf, date="fa_promotion", first=None, view=V.revisions):
    return L.filter_until(view(spark, sf), L.dump_timeline(view(spark, sf)), date, first=first)


def scratch(spark) -> str:
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="quillspark-")
    return f"{where}/{uuid.uuid4().hex}"


def raw_revisions(spark, sf):
    """Revisions in the shape of the files: level badges, ISO times, a user struct."""
    from ..functions.times import iso as iso_text

    e = V.revisions(spark, sf)
    badge = F.when(F.col("level") == "ga", "{{good article}}").when(F.col("level") == "fa", "{{featured article}}")
    return e.select(F.col("rev_id").alias("id"), iso_text("ts").alias("timestamp"), F.struct(F.col("user_id").alias("id")).alias("user"), F.lit("abc").alias("text"), F.lit(None).cast("string").alias("sha1"), badge.alias("assessment_found"))


def scan_jsonl(spark, sf):
    path = scratch(spark)
    S.sink_jsonl_bz2(raw_revisions(spark, sf), path)
    return S.project_revisions(S.scan_jsonl_bz2(spark, path)).groupBy("level").agg(F.count("*").alias("n"), F.count("user_id").alias("users"), F.max("ts").alias("last"), F.sum("text_len").alias("chars"))


def written_jsonl(spark, sf):
    """What sink_jsonl_bz2 wrote by year, read as lines of text: of each folder the lines in compressed files and their fields."""
    path = scratch(spark)
    S.sink_jsonl_bz2(raw_revisions(spark, sf).withColumn("year", F.substring("timestamp", 1, 4).cast("int")), path, by="year")
    field = lambda k: F.get_json_object("value", f"$.{k}")
    lines = spark.read.text(path).where(F.col("_metadata.file_name").endswith(".json.bz2"))
    return lines.groupBy("year").agg(F.count("*").alias("n"), F.min(field("id").cast("long")).alias("first_id"), F.max(field("user.id").cast("long")).alias("last_user"), F.count(field("assessment_found")).alias("badges"), F.min(field("timestamp")).alias("began"))


def scan_csv(spark, sf):
    path = scratch(spark)
    S.sink_csv(V.read(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), path)
    return S.scan_csv(spark, path, "c0 long, nation int, segment string")


def written_csv(spark, sf):
    """The different lines of text that sink_csv wrote, the header once."""
    path = scratch(spark)
    S.sink_csv(V.read(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), path)
    return spark.read.text(path).select(F.col("value").alias("line")).distinct()


def multi(spark, sf):
    df = S.scan_multi(spark, [f"{sf}/customer.parquet", f"{sf}/supplier.parquet"])
    return df.groupBy(F.coalesce("c_nationkey", "s_nationkey").alias("nation")).agg(F.count("c_custkey").alias("customers"), F.count("s_suppkey").alias("suppliers"))


def fallback(spark, sf):
    o = V.read(spark, sf, "orders").select(F.col("o_custkey").alias("page_id"), F.col("o_orderkey").alias("k"))
    found, missing = S.source_fallback(V.read(spark, sf, "customer").select(F.col("c_custkey").alias("page_id")), [o.where("page_id % 2 = 0"), o])
    return found.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages")).unionByName(missing.agg(F.lit(-1).alias("source"), F.count("*").alias("n"), F.count_distinct("page_id").alias("pages")))


def register_all(register) -> None:
    rev = V.revisions
    w = lambda cte, body: f"WITH {cte} {body}"
    register("scan_jsonl_bz2", scan_jsonl, w(V.REVISIONS, f"SELECT level, count(*) AS n, count(user_id) AS users, {iso('max(ts)')} AS last, count(*) * 3 AS chars FROM revisions GROUP BY level"))
    register("sink_jsonl_bz2", written_jsonl, w(V.REVISIONS, f"SELECT CAST(year(ts) AS BIGINT) AS year, count(*) AS n, min(rev_id) AS first_id, max(user_id) AS last_user, count(*) FILTER (WHERE level IN ('ga', 'fa')) AS badges, {iso('min(ts)')} AS began FROM revisions GROUP BY 1"))
    register("scan_csv", scan_csv, "SELECT c_custkey AS page_id, CAST(c_nationkey AS BIGINT) AS nation, c_mktsegment AS segment FROM customer")
    register("sink_csv", written_csv, "SELECT c_custkey || ',' || c_nationkey || ',' || c_mktsegment AS line FROM customer UNION SELECT 'c_custkey,c_nationkey,c_mktsegment'")
    register("scan_multi_glob_union", multi, "SELECT CAST(k AS BIGINT) AS nation, count(c) AS customers, count(s) AS suppliers FROM (SELECT c_nationkey AS k, c_custkey AS c, NULL AS s FROM customer UNION ALL SELECT s_nationkey, NULL, s_suppkey FROM supplier) GROUP BY k")
    register("source_fallback", fallback, """WITH t AS (SELECT o_custkey AS c, CASE WHEN o_custkey % 2 = 0 THEN 0 ELSE 1 END AS source FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer))
SELECT CAST(source AS BIGINT) AS source, count(*) AS n, count(DISTINCT c) AS pages FROM t GROUP BY source UNION ALL SELECT -1, count(*), count(DISTINCT c_custkey) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
    register("skip_processed", lambda s, sf: S.skip_processed(rev(s, sf), V.lists(s, sf)).groupBy("page_id").agg(F.count("*").alias("n")), w(f"{V.REVISIONS}, {V.LISTS}", "SELECT page_id, count(*) AS n FROM revisions WHERE page_id NOT IN (SELECT page_id FROM lists) GROUP BY page_id"))
    register("project_revisions", lambda s, sf: S.project_revisions(raw_revisions(s, sf).withColumn("page_id", F.lit(1).cast("long"))).select("rev_id", "ts", "user_id", "text_len", "level"), w(V.REVISIONS, f"SELECT rev_id, {iso('ts')} AS ts, user_id, CAST(3 AS BIGINT) AS text_len, level FROM revisions"))
    ever = lambda s, sf: L.ever_badged(rev(s, sf), "fa", now=False).unionByName(L.ever_badged(rev(s, sf), "ga", now=True)).unionByName(L.ever_badged(rev(s, sf)))
    register("filter_ever_badged", lambda s, sf: ever(s, sf).groupBy("page_id").agg(F.count("*").alias("n")), w(f"{V.REVISIONS}, lt AS (SELECT page_id, arg_max(coalesce(level, '-'), (ts, rev_id)) AS now FROM revisions GROUP BY 1)", "SELECT page_id, count(*) AS n FROM (SELECT DISTINCT page_id FROM revisions WHERE level = 'fa' UNION ALL SELECT page_id FROM lt WHERE now = 'ga' UNION ALL SELECT DISTINCT page_id FROM revisions WHERE level IS NOT NULL) GROUP BY 1"))
    register("distinct_ids", lambda s, sf: rev(s, sf).select("user_id").distinct(), w(V.REVISIONS, "SELECT DISTINCT user_id FROM revisions"))
    register("filter_until_promotion", lambda s, sf: until(s, sf).groupBy("page_id").agg(F.count("*").alias("n"), F.max("ts").alias("last")), w(TIMELINE, f"SELECT page_id, count(*) AS n, {iso('max(ts)')} AS last FROM revisions JOIN timeline USING (page_id) WHERE ts < fa_promotion GROUP BY page_id"))
    first = "f AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ts, rev_id) AS rn FROM revisions)"
    register("first_n_per_group", lambda s, sf: until(s, sf, first=100).groupBy("page_id").agg(F.count("*").alias("n"), F.max("ts").alias("last")), w(f"{TIMELINE}, {first}", f"SELECT page_id, count(*) AS n, {iso('max(ts)')} AS last FROM f JOIN timeline USING (page_id) WHERE ts < fa_promotion AND rn <= 100 GROUP BY page_id"))
    register("filter_until_demotion", lambda s, sf: until(s, sf, "fa_demotion").groupBy("page_id").agg(F.count("*").alias("n"), F.max("ts").alias("last")), w(TIMELINE, f"SELECT page_id, count(*) AS n, {iso('max(ts)')} AS last FROM revisions JOIN timeline USING (page_id) WHERE ts < fa_demotion GROUP BY page_id"))
    register("filter_registered_users", lambda s, sf: E.registered(V.edits(s, sf), required(s, sf)).groupBy("user_id").agg(F.count("*").alias("n")), w(V.EDITS, "SELECT user_id, count(*) AS n FROM edits WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10) GROUP BY user_id"))
    register("days_since_prev", lambda s, sf: L.days_since_prev(rev(s, sf)).select("page_id", "rev_id", "days"), w(RUNS, "SELECT page_id, rev_id, CAST(days AS BIGINT) AS days FROM m"))
    register("level_runs", lambda s, sf: L.level_runs(rev(s, sf)), w(RUNS, f"SELECT page_id, run, level, n_revisions, n_days, {iso('start')} AS start, start_rev FROM runs"))
    cols = "page_id, run, start_rev, {t} AS ts, from_level, to_level, revisions_in_prev, days_in_prev, revisions_in_to, days_in_to".format(t=iso("ts"))
    register("level_changes_from", lambda s, sf: L.level_changes_from(L.level_runs(rev(s, sf))), w(CHANGES, f"SELECT {cols}, sig_from AS significant FROM changes"))
    register("level_changes_to", lambda s, sf: L.level_changes_to(L.level_runs(rev(s, sf))), w(CHANGES, f"SELECT {cols}, sig_to AS significant FROM changes"))
    flags = "u AS (SELECT page_id, start_rev AS rev_id, to_level IS NOT NULL AS up FROM changes WHERE sig_from)"
    over = "OVER (PARTITION BY page_id ORDER BY ts, rev_id ROWS UNBOUNDED PRECEDING)"
    register("promoted_yet_flags", lambda s, sf: L.promoted_yet_flags(rev(s, sf)).select("page_id", "rev_id", "been_promoted_yet", "been_demoted_yet"), w(f"{CHANGES}, {flags}", f"SELECT r.page_id, r.rev_id, coalesce(max(up) {over.replace('page_id', 'r.page_id').replace('ts, rev_id', 'ts, r.rev_id')}, FALSE) AS been_promoted_yet, coalesce(max(NOT up) {over.replace('page_id', 'r.page_id').replace('ts, rev_id', 'ts, r.rev_id')}, FALSE) AS been_demoted_yet FROM revisions r LEFT JOIN u ON u.page_id = r.page_id AND u.rev_id = r.rev_id"))
    four = ", ".join(f"{iso(f'{u}_{e}')} AS {u}_{e}" for u in ("ga", "fa") for e in ("promotion", "demotion"))
    register("first_significant_transitions", lambda s, sf: L.first_significant_transitions(L.level_changes_to(L.level_runs(rev(s, sf)))), w(DATES, f"SELECT page_id, {four} FROM dates"))
    register("dump_timeline", lambda s, sf: L.dump_timeline(rev(s, sf)), w(TIMELINE, f"SELECT page_id, {iso('creation')} AS creation, {iso('last_revision')} AS last_revision, latest_level, age_in_days, {four}, is_sustainable FROM timeline"))
    register("label_sustainable", lambda s, sf: L.dump_timeline(rev(s, sf)).groupBy("is_sustainable").agg(F.count("*").alias("n")), w(TIMELINE, "SELECT is_sustainable, count(*) AS n FROM timeline GROUP BY is_sustainable"))
    register("latest_level", lambda s, sf: L.latest_level(rev(s, sf)), w(TIMELINE, f"SELECT page_id, {iso('creation')} AS creation, {iso('last_revision')} AS last_revision, latest_level, age_in_days FROM timeline"))
    register("level_counter", lambda s, sf: L.level_counter(rev(s, sf)).select("page_id", F.explode("counter").alias("level", "n")), w(V.REVISIONS, "SELECT page_id, coalesce(level, 'none') AS level, count(*) AS n FROM revisions GROUP BY ALL"))
    register("validate_source_dates", lambda s, sf: L.validate_source_dates(both_sources(s, sf), "ga").select("page_id", "talk_p_ok", "talk_d_ok", "dump_p_ok", "dump_d_ok"), w(BOTH, f"SELECT page_id, {valid_sql('ga')} FROM both_sources"))
    register("sources_aligned", lambda s, sf: both_sources(s, sf).select("page_id", *(L.sources_aligned(f"talkpage_{u}_promotion", f"dumps_{u}_promotion").alias(u) for u in L.LEVELS)), w(BOTH, f"SELECT page_id, {near('fa', 'promotion')} AS fa, {near('ga', 'promotion')} AS ga FROM both_sources"))
    for u in L.LEVELS:
        register(f"merge_sources_{u}", lambda s, sf, u=u: L.merge_sources(both_sources(s, sf), u).select("page_id", f"{u}_promotion", f"{u}_demotion", f"{u}_source"), w(BOTH, f"SELECT page_id, {iso(f'{u}_promotion')} AS {u}_promotion, {iso(f'{u}_demotion')} AS {u}_demotion, {u}_source FROM {merge_sql(u, 'both_sources')}"))
    register("merge_sources_simple", lambda s, sf: L.merge_sources_simple(both_sources(s, sf), "ga", rely_on="both").select("page_id", "ga_promotion", "ga_demotion"), w(BOTH, f"SELECT page_id, {iso('coalesce(talkpage_ga_promotion, dumps_ga_promotion)')} AS ga_promotion, CASE WHEN coalesce(talkpage_ga_promotion, dumps_ga_promotion) IS NOT NULL THEN {iso('coalesce(talkpage_ga_demotion, dumps_ga_demotion)')} END AS ga_demotion FROM both_sources"))
    register("join_sources_full_outer", lambda s, sf: L.dump_timeline(rev(s, sf)).where("page_id % 5 <> 0").select("page_id", "ga_promotion").join(V.talk_dates(s, sf).select("page_id", "talkpage_ga_promotion"), "page_id", "full_outer"), w(TALK, f"SELECT page_id, {iso('ga_promotion')} AS ga_promotion, {iso('talkpage_ga_promotion')} AS talkpage_ga_promotion FROM (SELECT page_id, ga_promotion FROM timeline WHERE page_id % 5 <> 0) FULL JOIN talk USING (page_id)"))
    register("inherit_ga_demotion", lambda s, sf: life(s, sf).select("page_id", "promoted_to_ga_then_fa", "ga_demotion"), w(MERGED, f"SELECT page_id, promoted_to_ga_then_fa, {iso('ga_demotion')} AS ga_demotion FROM life"))
    durations = ["birth_to_fa_promotion", "birth_to_ga_promotion", "fa_promotion_to_demotion", "ga_promotion_to_demotion"]
    register("lifecycle_durations", lambda s, sf: life(s, sf).select("page_id", *durations), w(MERGED, f"SELECT page_id, {', '.join(durations)} FROM life"))
    register("validate_lifecycle", lambda s, sf: life(s, sf).select("page_id", "is_valid"), w(MERGED, "SELECT page_id, is_valid FROM life"))
    register("valid_for_usecase", lambda s, sf: life(s, sf).select("page_id", L.valid_for_usecase("ga").alias("usable")), w(MERGED, "SELECT page_id, NOT coalesce(fa_promotion < ga_promotion, FALSE) AS usable FROM life"))
    register("label_conservative", lambda s, sf: life(s, sf).select("page_id", "label"), w(MERGED, "SELECT page_id, label FROM life"))
    register("assign_usecase", lambda s, sf: life(s, sf).select("page_id", "usecase"), w(MERGED, "SELECT page_id, usecase FROM life"))
    register("lifecycle_build", lambda s, sf: life(s, sf).groupBy("usecase", "is_valid", "label").agg(F.count("*").alias("n")), w(MERGED, "SELECT usecase, is_valid, label, count(*) AS n FROM life GROUP BY ALL"))
    register("iso_format", lambda s, sf: life(s, sf).select("page_id", "creation", "fa_promotion"), w(MERGED, f"SELECT page_id, {iso('creation')} AS creation, {iso('fa_promotion')} AS fa_promotion FROM life"))
    register("filter_max_year", lambda s, sf: life(s, sf).where("year(ga_promotion) <= 1998").select("page_id", F.year("ga_promotion").alias("year")), w(MERGED, "SELECT page_id, year(ga_promotion) AS year FROM life WHERE year(ga_promotion) <= 1998"))
    register("extract_year", lambda s, sf: life(s, sf).select("page_id", F.year("creation").alias("year")), w(MERGED, "SELECT page_id, year(creation) AS year FROM life"))
    register("exclude_unreliable", lambda s, sf: L.exclude_unreliable(life(s, sf).withColumn("y", F.col("label").cast("int")), label="y", demotion="ga_demotion", days="ga_promotion_to_demotion").select("page_id", "y"), w(MERGED, "SELECT page_id, CAST(CAST(label AS INTEGER) AS BIGINT) AS y FROM life WHERE NOT (ga_demotion IS NULL AND NOT label) AND coalesce(ga_promotion_to_demotion > 30, TRUE)"))
    from ..operators import reports as R

    register("yearly_rate", lambda s, sf: R.yearly_rate(life(s, sf), "ga_promotion", "label"), w(MERGED, "SELECT year(ga_promotion) AS year, round(avg(CAST(label AS DOUBLE)) * 100, 6) AS sustained, count(*) AS n FROM life WHERE ga_promotion IS NOT NULL GROUP BY 1"))
    register("duration_summary", lambda s, sf: R.duration_summary(life(s, sf), durations), w(MERGED, " UNION ALL ".join(f"SELECT '{c}' AS measure, count({c}) AS n, round(avg({c}), 2) AS mean, round(CAST(median({c}) AS DOUBLE), 2) AS median FROM life" for c in durations)))
    register("histogram", lambda s, sf: R.histogram(life(s, sf).withColumn("v", F.col("birth_to_ga_promotion").cast("double")), "v", 0, 2000, 10), w(MERGED, "SELECT least(10, CAST(floor(birth_to_ga_promotion / 200) AS BIGINT) + 1) AS bucket, count(*) AS n FROM life WHERE birth_to_ga_promotion BETWEEN 0 AND 2000 GROUP BY 1"))
    register("non_null_counts", lambda s, sf: R.non_null_counts(life(s, sf).select("ga_promotion", "ga_demotion", "fa_promotion", "fa_demotion")), w(MERGED, "SELECT count(ga_promotion) AS ga_promotion, count(ga_demotion) AS ga_demotion, count(fa_promotion) AS fa_promotion, count(fa_demotion) AS fa_demotion FROM life"))
    register("missing_count", lambda s, sf: R.missing_count(life(s, sf).select("ga_promotion", "ga_demotion", "fa_promotion", "fa_demotion")), w(MERGED, "SELECT 4 * count(*) - count(ga_promotion) - count(ga_demotion) - count(fa_promotion) - count(fa_demotion) AS missing FROM life"))
    # edit features and the ledger, on the revisions before promotion
    dates = "d AS (SELECT page_id, fa_promotion AS promotion, fa_demotion AS demotion FROM timeline)"
    shares = lambda name, date: f"""{name} AS (SELECT page_id, user_id, count(*) / sum(count(*)) OVER (PARTITION BY page_id) AS share FROM revisions JOIN d USING (page_id) WHERE ts < {date} AND user_id IS NOT NULL GROUP BY page_id, user_id)"""
    ledger_sql = f"{TIMELINE}, {dates}, {shares('up', 'promotion')}, {shares('down', 'demotion')}, ledger AS (SELECT page_id, promotion AS date, user_id, share AS credit FROM up JOIN d USING (page_id) UNION ALL SELECT page_id, demotion, user_id, -share FROM down JOIN d USING (page_id) WHERE promotion IS NOT NULL)"
    register("credit_ledger", lambda s, sf: ledger(s, sf), w(ledger_sql, f"SELECT page_id, {iso('date')} AS date, user_id, round(credit, 6) AS credit FROM ledger"))
    past = "past AS (SELECT u.page_id, u.user_id, sum(l.credit) AS c, sum(abs(l.credit)) AS e FROM up u JOIN d ON d.page_id = u.page_id JOIN ledger l ON l.user_id = u.user_id AND l.date <= d.promotion AND l.page_id <> u.page_id GROUP BY 1, 2)"
    scored = "SELECT u.page_id, round(sum(coalesce(c, 0)) / count(*), 6) AS credibility, round(sum(share * coalesce(c, 0)), 6) AS credibility_weighted, round(sum(coalesce(e, 0)) / count(*), 6) AS experience, round(sum(share * coalesce(e, 0)), 6) AS experience_weighted FROM up u LEFT JOIN past p ON p.page_id = u.page_id AND p.user_id = u.user_id GROUP BY u.page_id"
    for name in ("credibility_score", "experience_score"):
        register(name, lambda s, sf: E.ledger_scores(editors(s, sf), ledger(s, sf)), w(f"{ledger_sql}, {past}", scored))
    register("credit_history_join", lambda s, sf: E.history_totals(editors(s, sf), ledger(s, sf), "date", "credit").groupBy("page_id").agg(F.sum("n").alias("n"), F.sum("credit").alias("credit")).where("n > 0"), w(ledger_sql, "SELECT u.page_id, count(*) AS n, round(sum(l.credit), 6) AS credit FROM up u JOIN d ON d.page_id = u.page_id JOIN ledger l ON l.user_id = u.user_id AND l.date <= d.promotion AND l.page_id <> u.page_id GROUP BY 1"))
    hit = "hit AS (SELECT u.page_id, u.user_id, r.page_id AS other FROM up u JOIN d ON d.page_id = u.page_id JOIN revisions r ON r.user_id = u.user_id AND r.ts <= d.promotion AND r.page_id <> u.page_id)"
    site = f"{TIMELINE}, {dates}, {shares('up', 'promotion')}, {hit}"
    activity = "SELECT page_id, round(coalesce(p, 0) / k, 6) AS other_pages, round(coalesce(e, 0) / k, 6) AS other_edits, round(coalesce(u, 0) / k, 6) AS active_users FROM (SELECT page_id, count(*) AS k FROM up GROUP BY 1) LEFT JOIN (SELECT page_id, count(DISTINCT other) AS p, count(*) AS e, count(DISTINCT user_id) AS u FROM hit GROUP BY 1) USING (page_id)"
    by_page = V.revisions_by_page
    log = lambda s, sf, view=rev: view(s, sf).select("user_id", "page_id", F.col("ts").alias("timestamp"))
    register("site_activity", lambda s, sf: E.site_activity(editors(s, sf, by_page), log(s, sf, by_page)), w(site, activity))
    register("site_history_join", lambda s, sf: E.history_join(editors(s, sf), log(s, sf), "timestamp").groupBy("page_id").agg(F.count("*").alias("n")), w(site, "SELECT page_id, count(*) AS n FROM hit GROUP BY 1"))
    down_past = past.replace("past AS", "past_d AS").replace("FROM up u", "FROM down u").replace("d.promotion", "d.demotion")
    down_scored = scored.replace("FROM up u LEFT JOIN past p", "FROM down u LEFT JOIN past_d p")
    at = lambda sql, event: f"SELECT page_id, COLUMNS(lambda c: c <> 'page_id') AS '\\0_{event}' FROM ({sql})"
    experience = f"SELECT * FROM (SELECT page_id FROM timeline) LEFT JOIN ({at(scored, 'promotion')}) USING (page_id) LEFT JOIN ({activity}) USING (page_id) LEFT JOIN ({at(down_scored, 'demotion')}) USING (page_id)"
    register("experience_features", lambda s, sf: E.experience_features(fa_dates(s, sf, by_page), {"promotion": until(s, sf, view=by_page), "demotion": until(s, sf, "fa_demotion", view=by_page)}, ledger(s, sf, by_page), log(s, sf, by_page)), w(f"{ledger_sql}, {past}, {down_past}, {hit}", experience))
    register("edit_features", lambda s, sf: E.edit_features(until(s, sf), L.dump_timeline(rev(s, sf)).withColumn("promotion", F.col("fa_promotion"))), w(TIMELINE, f"""SELECT page_id, count(DISTINCT user_id) AS EDIT_num_authors, round(count(DISTINCT user_id) / greatest(1, count(*)), 6) AS EDIT_num_authors_normalized, count(*) AS EDIT_num_revisions,
 round(count(*) / greatest(1, {fd('max(ts)', 'min(ts)')}), 6) AS EDIT_num_revisions_normalized, min({fd('fa_promotion', 'creation')}) AS EDIT_time_to_promotion, CAST(CAST(min(coalesce(ga_promotion < fa_promotion, FALSE)) AS INTEGER) AS BIGINT) AS EDIT_used_to_be_good
 FROM revisions JOIN timeline USING (page_id) WHERE ts < fa_promotion GROUP BY page_id"""))


def required(spark, sf):
    return V.read(spark, sf, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("user_id"))


def fa_dates(spark, sf, view=V.revisions):
    return L.dump_timeline(view(spark, sf)).select("page_id", F.col("fa_promotion").alias("promotion"), F.col("fa_demotion").alias("demotion"))


def ledger(spark, sf, view=V.revisions):
    return E.credit_ledger(until(spark, sf, view=view), until(spark, sf, "fa_demotion", view=view), fa_dates(spark, sf, view))


def editors(spark, sf, view=V.revisions):
    return E.editors_of(fa_dates(spark, sf, view), E.contribution_share(until(spark, sf, view=view)), "promotion")
