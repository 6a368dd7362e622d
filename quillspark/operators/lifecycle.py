"""Quality life-cycle of pages: runs of levels, significant changes, dates from two sources, labels.

Revisions have page_id, rev_id, ts, user_id, level (null, 'ga' or 'fa') and are ordered by (ts, rev_id). `compat` gives
the result of the published scripts where it differs from the intended one; the default is the intended one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.times import floor_days

LEVELS = ("fa", "ga")


def page_order() -> WindowSpec:
    return Window.partitionBy("page_id").orderBy("ts", "rev_id")


def days_since_prev(revisions: DataFrame) -> DataFrame:
    """days: floored days since the page's previous revision, 0 for the first and never negative."""
    return revisions.withColumn("days", F.coalesce(F.greatest(F.lit(0), floor_days(F.col("ts"), F.lag("ts").over(page_order()))), F.lit(0)))


def level_runs(revisions: DataFrame, *, compat: bool = False) -> DataFrame:
    """page_id, run (from 0), level, n_revisions, n_days, start, start_rev. Days are those between revisions of the run.
    compat: a first run without level counts one revision more."""
    changed = ~F.col("level").eqNullSafe(F.lag("level").over(page_order())) & F.lag("ts").over(page_order()).isNotNull()
    marked = days_since_prev(revisions).withColumn("changed", changed).withColumn("run", F.sum(F.col("changed").cast("long")).over(page_order()))
    out = marked.groupBy("page_id", "run").agg(
        F.first("level").alias("level"), F.count(F.lit(1)).alias("n_revisions"), F.sum(F.when(F.col("changed"), 0).otherwise(F.col("days"))).alias("n_days"),
        F.min("ts").alias("start"), F.min_by("rev_id", F.struct("ts", "rev_id")).alias("start_rev"),
    )
    extra = F.when((F.col("run") == 0) & F.col("level").isNull(), 1).otherwise(0)
    return out.withColumn("n_revisions", F.col("n_revisions") + extra) if compat else out


def significant(n: str, days: str) -> Column:
    return (F.col(n) >= 5) | (F.col(days) >= 30)


def level_changes(runs: DataFrame) -> DataFrame:
    """One row for each change of level, with both runs' sizes; a page that begins with a level changes to it from null."""
    w = Window.partitionBy("page_id").orderBy("run")
    prev = lambda c: F.lag(c).over(w)
    out = runs.select(
        "page_id", "run", "start_rev", F.col("start").alias("ts"), prev("level").alias("from_level"), F.col("level").alias("to_level"),
        F.coalesce(prev("n_revisions"), F.lit(1).cast("long")).alias("revisions_in_prev"), F.coalesce(prev("n_days"), F.lit(0).cast("long")).alias("days_in_prev"),
        F.col("n_revisions").alias("revisions_in_to"), F.col("n_days").alias("days_in_to"),
    )
    return out.where("run > 0 or to_level is not null")


def level_changes_from(runs: DataFrame) -> DataFrame:
    """Changes, significant by the run before: 5 revisions or 30 days."""
    return level_changes(runs).withColumn("significant", significant("revisions_in_prev", "days_in_prev"))


def level_changes_to(runs: DataFrame) -> DataFrame:
    """Changes, significant by the run they lead to."""
    return level_changes(runs).withColumn("significant", significant("revisions_in_to", "days_in_to"))


def promoted_yet_flags(revisions: DataFrame, *, compat: bool = False) -> DataFrame:
    """been_promoted_yet, been_demoted_yet: has a significant change (by the run before) to a level, to none, happened so far?"""
    changes = level_changes_from(level_runs(revisions, compat=compat)).where("significant").select("page_id", F.col("start_rev").alias("rev_id"), F.col("to_level").isNotNull().alias("up"))
    marked = revisions.join(changes, ["page_id", "rev_id"], "left")
    so_far = page_order().rowsBetween(Window.unboundedPreceding, 0)
    flag = lambda c: F.coalesce(F.max(c).over(so_far), F.lit(False))
    return marked.withColumn("been_promoted_yet", flag(F.col("up"))).withColumn("been_demoted_yet", flag(~F.col("up"))).drop("up")


def first_significant_transitions(changes: DataFrame) -> DataFrame:
    """First significant promotion and demotion of each level. A demotion from fa also ends ga if ga had been reached before."""
    null = F.lit(None).cast("timestamp")
    first = lambda cond: F.min(F.when(cond, F.col("ts")))
    s = changes.where("significant")
    ga_up = F.col("from_level").isNull() & (F.col("to_level") == "ga")
    a = s.groupBy("page_id").agg(
        first(ga_up).alias("ga_promotion"), first(F.col("to_level") == "fa").alias("fa_promotion"), first(F.col("from_level") == "fa").alias("fa_demotion"),
        first((F.col("from_level") == "ga") & F.col("to_level").isNull()).alias("ga_down"),
    )
    ended = F.when(F.col("ga_promotion") < F.col("fa_demotion"), F.col("fa_demotion")).otherwise(null)
    return a.select("page_id", "ga_promotion", F.when(F.col("fa_demotion").isNull(), F.col("ga_down")).otherwise(ended).alias("ga_demotion"), "fa_promotion", "fa_demotion")


def latest_level(revisions: DataFrame) -> DataFrame:
    """creation, last_revision, latest_level and age_in_days of each page."""
    at = F.struct("ts", "rev_id")
    out = revisions.groupBy("page_id").agg(F.min("ts").alias("creation"), F.max("ts").alias("last_revision"), F.max_by("level", at).alias("latest_level"))
    return out.withColumn("age_in_days", floor_days("last_revision", "creation"))


def dump_timeline(revisions: DataFrame) -> DataFrame:
    """One row for each page: creation, last revision, the four dates, current level, still sustained or not."""
    dates = first_significant_transitions(level_changes_to(level_runs(revisions)))
    return label_sustainable(latest_level(revisions).join(dates, "page_id", "left"))


def label_sustainable(pages: DataFrame) -> DataFrame:
    return pages.withColumn("is_sustainable", F.col("fa_demotion").isNull() & F.col("ga_demotion").isNull())


def ever_badged(revisions: DataFrame, level: str | None = None, *, now: bool = False) -> DataFrame:
    """page_id of pages that ever had a level (any if None) or, with `now`, have it in their last revision."""
    if now:
        last = revisions.groupBy("page_id").agg(F.max_by("level", F.struct("ts", "rev_id")).alias("level"))
        return last.where(F.col("level").isNotNull() if level is None else F.col("level") == level).select("page_id")
    return revisions.where(F.col("level").isNotNull() if level is None else F.col("level") == level).select("page_id").distinct()


def level_counter(revisions: DataFrame) -> DataFrame:
    """counter: revisions for each level of a page ('none' without level)."""
    per = revisions.groupBy("page_id", F.coalesce("level", F.lit("none")).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("page_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("level", "n")))).alias("counter"))


def validate_source(promotion: str, demotion: str, creation: str = "creation") -> tuple[Column, Column]:
    """Are a source's dates usable? Each must be after creation; if the demotion isn't after the promotion, neither is."""
    p = F.coalesce(F.col(promotion) > F.col(creation), F.lit(False))
    d = F.coalesce(F.col(demotion) > F.col(creation), F.lit(False))
    wrong = p & d & (F.col(demotion) <= F.col(promotion))
    return p & ~F.coalesce(wrong, F.lit(False)), d & ~F.coalesce(wrong, F.lit(False))


def validate_source_dates(pages: DataFrame, usecase: str) -> DataFrame:
    """talk_p_ok, talk_d_ok, dump_p_ok, dump_d_ok for dates talkpage_* and dumps_* of a level."""
    for source, short in (("talkpage", "talk"), ("dumps", "dump")):
        p, d = validate_source(f"{source}_{usecase}_promotion", f"{source}_{usecase}_demotion")
        pages = pages.withColumns({f"{short}_p_ok": p, f"{short}_d_ok": d})
    return pages


def sources_aligned(a: str, b: str, *, days: int = 30, compat: bool = False) -> Column:
    """Are both dates there and at most `days` apart? compat: floored days, so 30.5 days pass one way only."""
    apart = F.abs(floor_days(a, b)) if compat else F.least(F.abs(floor_days(a, b)), F.abs(floor_days(b, a)))
    return F.coalesce(apart <= days, F.lit(False))


def merge_sources(pages: DataFrame, usecase: str, *, compat: bool = False) -> DataFrame:
    """{usecase}_promotion, _demotion, _source from the two sources' dates, by which of them are usable."""
    v = validate_source_dates(pages, usecase)
    tp, td, dp, dd = (F.col(f"{s}_{usecase}_{e}") for s in ("talkpage", "dumps") for e in ("promotion", "demotion"))
    t_p, t_d, d_p, d_d = (F.col(f"{s}_{e}_ok") for s in ("talk", "dump") for e in ("p", "d"))
    near = lambda e: sources_aligned(f"talkpage_{usecase}_{e}", f"dumps_{usecase}_{e}", compat=compat)
    null = F.lit(None)
    both_up = t_p & ~t_d & d_d & near("promotion")
    both_down = ~t_p & t_d & near("demotion")
    neither = ~t_p & ~t_d & d_p
    return v.withColumns({
        f"{usecase}_promotion": F.when(t_p, tp).when(both_down | neither, dp).otherwise(null),
        f"{usecase}_demotion": F.when((t_p & t_d) | both_down, td).when(both_up | (neither & d_d), dd).otherwise(null),
        f"{usecase}_source": F.when(both_up | both_down, "both").when(t_p, "talkpage").when(neither, "dumps").otherwise(null),
    }).drop("talk_p_ok", "talk_d_ok", "dump_p_ok", "dump_d_ok")


def merge_sources_simple(pages: DataFrame, usecase: str, *, rely_on: str = "talkpage") -> DataFrame:
    """Dates of the talk page, or of either source ('both'); a demotion without promotion is dropped."""
    pick = lambda e: F.col(f"talkpage_{usecase}_{e}") if rely_on == "talkpage" else F.coalesce(f"talkpage_{usecase}_{e}", f"dumps_{usecase}_{e}")
    p = pick("promotion")
    return pages.withColumns({f"{usecase}_promotion": p, f"{usecase}_demotion": F.when(p.isNotNull(), pick("demotion"))})


def inherit_ga_demotion(pages: DataFrame) -> DataFrame:
    """promoted_to_ga_then_fa; such a page, once demoted from fa, has lost ga too."""
    both = F.coalesce(F.col("ga_promotion") < F.col("fa_promotion"), F.lit(False))
    out = pages.withColumn("promoted_to_ga_then_fa", both)
    return out.withColumn("ga_demotion", F.when(F.col("promoted_to_ga_then_fa") & F.col("ga_demotion").isNull(), F.col("fa_demotion")).otherwise(F.col("ga_demotion")))


def lifecycle_durations(pages: DataFrame) -> DataFrame:
    """Floored days from creation to promotion and from promotion to demotion of each level."""
    return pages.withColumns({f"birth_to_{u}_promotion": floor_days(f"{u}_promotion", "creation") for u in LEVELS} | {f"{u}_promotion_to_demotion": floor_days(f"{u}_demotion", f"{u}_promotion") for u in LEVELS})


def validate_lifecycle(pages: DataFrame) -> DataFrame:
    """is_valid: promotions not before creation, demotions not before promotions, no negative duration or age."""
    wrong = [F.col("age_in_days") < 0]
    for u in LEVELS:
        wrong += [F.col(f"{u}_promotion") < F.col("creation"), F.col(f"{u}_demotion") < F.col(f"{u}_promotion")]
        wrong += [F.col(f"birth_to_{u}_promotion") < 0, F.col(f"{u}_promotion_to_demotion") < 0]
    return pages.withColumn("is_valid", ~F.greatest(*(F.coalesce(c, F.lit(False)) for c in wrong)))


def valid_for_usecase(usecase: str) -> Column:
    """A page that reached fa before ga can't be used for ga."""
    return F.lit(True) if usecase != "ga" else ~F.coalesce(F.col("fa_promotion") < F.col("ga_promotion"), F.lit(False))


def label_conservative(pages: DataFrame, lists: DataFrame) -> DataFrame:
    """label: false if a list of former pages has the page, or a demotion date rests on the talk page; else true."""
    former = lists.where(F.col("type").startswith("former")).select("page_id", F.lit(True).alias("__former")).distinct()
    lost = lambda u: F.col(f"{u}_demotion").isNotNull() & (F.coalesce(f"{u}_source", F.lit("talkpage")) == "talkpage")
    out = pages.join(former, "page_id", "left")
    return out.withColumn("label", ~(F.coalesce("__former", F.lit(False)) | lost("fa") | lost("ga"))).drop("__former")


def assign_usecase(pages: DataFrame) -> DataFrame:
    fa, ga = F.col("fa_promotion").isNotNull(), F.col("ga_promotion").isNotNull()
    return pages.withColumn("usecase", F.when(fa & ga, "both").when(fa, "fa").when(ga, "ga"))


def lifecycle_build(revisions: DataFrame, talk_dates: DataFrame, lists: DataFrame, *, compat: bool = False) -> DataFrame:
    """The whole life-cycle table: both sources merged, durations, validity, labels, use case."""
    dumps = first_significant_transitions(level_changes_to(level_runs(revisions)))
    dumps = dumps.withColumnsRenamed({f"{u}_{e}": f"dumps_{u}_{e}" for u in LEVELS for e in ("promotion", "demotion")})
    pages = latest_level(revisions).join(dumps, "page_id", "left").join(talk_dates, "page_id", "left")
    for u in LEVELS:
        pages = merge_sources(pages, u, compat=compat)
    pages = label_sustainable(validate_lifecycle(lifecycle_durations(inherit_ga_demotion(pages))))
    return assign_usecase(label_conservative(pages, lists))


def filter_until(revisions: DataFrame, dates: DataFrame, date: str, *, first: int | None = None) -> DataFrame:
    """Revisions before the page's date (strictly); `first`: of these, only those among the first n of all its revisions."""
    if first is not None:
        revisions = revisions.withColumn("__n", F.row_number().over(page_order())).where(F.col("__n") <= first).drop("__n")
    return revisions.join(dates.select("page_id", F.col(date).alias("__date")), "page_id").where(F.col("ts") < F.col("__date")).drop("__date")


def exclude_unreliable(rows: DataFrame, *, label: str, demotion: str, days: str) -> DataFrame:
    """Leave out pages labelled 0 without demotion date, and those demoted within 30 days."""
    return rows.where(~(F.col(demotion).isNull() & (F.col(label) == 0)) & F.coalesce(F.col(days) > 30, F.lit(True)))
