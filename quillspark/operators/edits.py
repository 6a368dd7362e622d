"""Edit and team features of pages, contribution shares and the editor credit ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import floor_days


def num_authors(revisions: DataFrame) -> DataFrame:
    """Distinct registered users, and per revision."""
    out = revisions.groupBy("page_id").agg(F.count_distinct("user_id").alias("num_authors"), F.count(F.lit(1)).alias("n"))
    return out.select("page_id", "num_authors", (F.col("num_authors") / F.greatest(F.lit(1), F.col("n"))).alias("num_authors_normalized"))


def num_revisions(revisions: DataFrame) -> DataFrame:
    """Revisions, and per floored day from first to last (one day at least)."""
    out = revisions.groupBy("page_id").agg(F.count(F.lit(1)).alias("num_revisions"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return out.select("page_id", "num_revisions", (F.col("num_revisions") / F.greatest(F.lit(1), floor_days("b", "a"))).alias("num_revisions_normalized"))


def revert_share(revisions: DataFrame) -> DataFrame:
    """Repeats of contents over distinct contents; a missing hash is one content."""
    per = revisions.groupBy("page_id", "sha1").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("page_id").agg((F.sum(F.col("n") - 1) / F.count(F.lit(1))).alias("revert_share"))


def anonymous_share(revisions: DataFrame) -> DataFrame:
    return revisions.groupBy("page_id").agg(F.avg(F.col("user_id").isNull().cast("double")).alias("anonymous_share"))


def gini(rows: DataFrame, group: str, value: str, *, name: str = "gini") -> DataFrame:
    """Gini coefficient of positive values in each group, from their order: sum((2 i - n - 1) x) / (n sum(x)); one value gives 0."""
    w = Window.partitionBy(group).orderBy(value)
    ranked = rows.select(group, F.col(value).alias("__x"), F.row_number().over(w).alias("__i"))
    n, s = F.count(F.lit(1)), F.sum("__x")
    return ranked.groupBy(group).agg(F.coalesce(F.try_divide(2 * F.sum(F.col("__i") * F.col("__x")) - (n + 1) * s, n * s), F.lit(0.0)).alias(name))


def registered(revisions: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Revisions of registered users or, given users (user_id), of these."""
    out = revisions.where("user_id is not null")
    return out if users is None else out.join(users.select("user_id").distinct(), "user_id", "left_semi")


def user_counts(revisions: DataFrame) -> DataFrame:
    return revisions.where("user_id is not null").groupBy("page_id", "user_id").agg(F.count(F.lit(1)).alias("n"))


def community_dynamics(revisions: DataFrame) -> DataFrame:
    """anonymous_share, revert_share and gini of edits over registered users, of every page."""
    return anonymous_share(revisions).join(revert_share(revisions), "page_id").join(gini(user_counts(revisions), "page_id", "n"), "page_id", "left")


def contribution_share(revisions: DataFrame) -> DataFrame:
    """share: a user's part of the registered revisions of a page."""
    return user_counts(revisions).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("page_id")))


def credit_ledger(promoted: DataFrame, demoted: DataFrame, dates: DataFrame) -> DataFrame:
    """page_id, date, user_id, credit: shares up to promotion, and for demoted pages minus the shares up to demotion.
    `promoted` and `demoted` are the revisions before each date; dates has page_id, promotion, demotion."""
    up = contribution_share(promoted).join(dates.where("promotion is not null"), "page_id").select("page_id", F.col("promotion").alias("date"), "user_id", F.col("share").alias("credit"))
    down = contribution_share(demoted).join(dates.where("promotion is not null and demotion is not null"), "page_id").select("page_id", F.col("demotion").alias("date"), "user_id", (-F.col("share")).alias("credit"))
    return up.unionByName(down)


def history_join(editors: DataFrame, history: DataFrame, at: str) -> DataFrame:
    """Editors (page_id, user_id, cutoff, ...) with what they did on other pages up to the cutoff (`at` is the history's time).

    An equi-join on the user with the rest as residual predicate; heavy users are split by adaptive skew joins."""
    other = history.withColumnsRenamed({"page_id": "other_page"})
    return editors.join(other, "user_id").where((F.col(at) <= F.col("cutoff")) & (F.col("other_page") != F.col("page_id")))


def history_totals(editors: DataFrame, history: DataFrame, at: str, *values: str) -> DataFrame:
    """page_id, user_id, n and the sum of each value of what the editor (page_id, user_id, cutoff) did on other pages up to the cutoff.

    What history_join gives, summed up, without its rows: running totals of each user's history at the cutoff, less those of the
    page itself. A user of e edits and p pages costs e + p rows, which are exchanged once."""
    names = ["n", *values]
    past = history.where(F.col(at).isNotNull()).select("user_id", F.col(at).alias("at"), "page_id", F.lit(False).alias("asked"), F.lit(1).cast("long").alias("n"), *values)
    asked = editors.select("user_id", F.col("cutoff").alias("at"), "page_id", F.lit(True).alias("asked"), *(F.lit(None).cast(past.schema[c].dataType).alias(c) for c in names))
    so_far = [Window.partitionBy(*keys).orderBy("at", "asked").rowsBetween(Window.unboundedPreceding, 0) for keys in (["user_id"], ["user_id", "page_id"])]
    both = past.unionByName(asked).repartition("user_id")
    for w, prefix in zip(so_far, ("all", "own"), strict=True):
        both = both.withColumns({f"{prefix}_{c}": F.sum(c).over(w) for c in names})
    return both.where("asked").select("page_id", "user_id", *((F.coalesce(f"all_{c}", F.lit(0)) - F.coalesce(f"own_{c}", F.lit(0))).alias(c) for c in names))


def editors_of(pages: DataFrame, shares: DataFrame, cutoff: str) -> DataFrame:
    return shares.join(pages.select("page_id", F.col(cutoff).alias("cutoff")), "page_id").select("page_id", "user_id", "share", "cutoff")


def ledger_scores(editors: DataFrame, ledger: DataFrame) -> DataFrame:
    """credibility (signed) and experience (absolute credit) on other pages up to the cutoff: per contributor, and weighted
    by the contributors' shares. Null without contributors: such pages have no row."""
    past = history_totals(editors, ledger.withColumn("size", F.abs("credit")), "date", "credit", "size").select("page_id", "user_id", F.col("credit").alias("c"), F.col("size").alias("e"))
    per = editors.join(past, ["page_id", "user_id"], "left").na.fill(0.0, ["c", "e"])
    mean, weighted = (lambda c: F.sum(c) / F.count(F.lit(1))), (lambda c: F.sum(F.col("share") * F.col(c)))
    return per.groupBy("page_id").agg(mean("c").alias("credibility"), weighted("c").alias("credibility_weighted"), mean("e").alias("experience"), weighted("e").alias("experience_weighted"))


def site_activity(editors: DataFrame, log: DataFrame) -> DataFrame:
    """Other pages, edits on them and users with such edits up to the cutoff, each per contributor. Pages are counted on each
    user's first visits, edits and users on running totals."""
    first = log.repartition("user_id").groupBy("user_id", "page_id").agg(F.min("timestamp").alias("timestamp"))
    pages = history_join(editors.select("page_id", "user_id", "cutoff"), first, "timestamp").groupBy("page_id").agg(F.count_distinct("other_page").alias("p"))
    per = history_totals(editors, log, "timestamp").groupBy("page_id").agg(F.sum("n").alias("e"), F.count(F.when(F.col("n") > 0, 1)).alias("u"))
    out = editors.groupBy("page_id").agg(F.count(F.lit(1)).alias("k")).join(pages, "page_id", "left").join(per, "page_id", "left").na.fill(0, ["p", "e", "u"])
    return out.select("page_id", *((F.col(c) / F.col("k")).alias(n) for c, n in (("p", "other_pages"), ("e", "other_edits"), ("u", "active_users"))))


def experience_features(pages: DataFrame, revisions_at: dict[str, DataFrame], ledger: DataFrame, log: DataFrame) -> DataFrame:
    """Ledger scores until promotion and until demotion, with site activity until promotion."""
    out = pages.select("page_id").distinct()
    for event, revisions in revisions_at.items():
        editors = editors_of(pages.where(F.col(event).isNotNull()), contribution_share(revisions), event)
        scores = ledger_scores(editors, ledger)
        out = out.join(scores.withColumnsRenamed({c: f"{c}_{event}" for c in scores.columns if c != "page_id"}), "page_id", "left")
        if event == "promotion":
            out = out.join(site_activity(editors, log), "page_id", "left")
    return out


def edit_features(revisions: DataFrame, pages: DataFrame) -> DataFrame:
    """EDIT_ columns of pages with promotion, from the revisions before it; used_to_be_good: ga was reached before."""
    out = num_authors(revisions).join(num_revisions(revisions), "page_id").join(pages, "page_id")
    return out.select(
        "page_id", F.col("num_authors").alias("EDIT_num_authors"), F.col("num_authors_normalized").alias("EDIT_num_authors_normalized"),
        F.col("num_revisions").alias("EDIT_num_revisions"), F.col("num_revisions_normalized").alias("EDIT_num_revisions_normalized"),
        floor_days("promotion", "creation").alias("EDIT_time_to_promotion"), F.coalesce(F.col("ga_promotion") < F.col("promotion"), F.lit(False)).cast("int").alias("EDIT_used_to_be_good"),
    )


def users_overlap(edit_shares: DataFrame, talk_shares: DataFrame) -> DataFrame:
    """Of page_id, user_id, share tables: users in both over editors and over discussers, and the mean squared difference of shares over all."""
    both = edit_shares.select("page_id", "user_id", F.col("share").alias("e")).join(talk_shares.select("page_id", "user_id", F.col("share").alias("t")), ["page_id", "user_id"], "full_outer")
    n = F.count(F.when(F.col("e").isNotNull() & F.col("t").isNotNull(), 1))
    diff = F.avg(F.pow(F.coalesce("t", F.lit(0.0)) - F.coalesce("e", F.lit(0.0)), 2.0))
    return both.groupBy("page_id").agg(F.try_divide(n, F.count("e")).alias("overlap_by_editors"), F.try_divide(n, F.count("t")).alias("overlap_by_talkers"), diff.alias("distributions_diff"))


def agg_stats(rows: DataFrame, group: str, value: str, prefix: str) -> DataFrame:
    """{prefix}_mean, _median and _stdev (sample; 0 for one value) of each group."""
    return rows.groupBy(group).agg(*stat_columns(value, prefix))


def stat_columns(value: str, prefix: str) -> list[Column]:
    sd = F.when(F.count(value) == 1, 0.0).otherwise(F.stddev_samp(value))
    return [F.avg(value).alias(f"{prefix}_mean"), F.median(value).alias(f"{prefix}_median"), sd.alias(f"{prefix}_stdev")]


def share_of_total(value: str, group: str) -> Column:
    return F.col(value) / F.sum(value).over(Window.partitionBy(group))
