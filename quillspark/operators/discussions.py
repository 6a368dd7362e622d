"""Features of talk-page discussions. Comments are rows with page_id, thread, pos, comment_id, root_id, author, refers_to,
root_author, depth, time (null if it could not be read), text and five scores (null if there are none).

`compat`: means of only zeros become null, and reply times lose whole days, as published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import parse_date, seconds
from .edits import gini
from .network import triangle_count

SCORES = ("sentiment", "formality", "politeness", "toxicity", "certainty")
#: share name, score, test
SHARES = (
    ("neg_sentiment", "sentiment", "sentiment < 0.2"), ("pos_sentiment", "sentiment", "sentiment > 0.8"), ("high_formality", "formality", "formality > 0.8"),
    ("low_politeness", "politeness", "politeness < 3"), ("toxic", "toxicity", "toxicity > 0.2"), ("high_certainty", "certainty", "certainty > 4.75"),
)


def comment_rows(threads: DataFrame) -> DataFrame:
    """One row for each comment of nested threads (page_id, threads array with comments array); threads without comments are left out."""
    t = threads.select("page_id", F.posexplode("threads").alias("thread", "t")).where("t.comments is not null")
    c = t.select("page_id", "thread", F.posexplode_outer("t.comments").alias("pos", "c")).select("page_id", "thread", "pos", "c.*")
    return c.withColumnsRenamed({"root_comment_id": "root_id"}).withColumn("time", parse_comment_time("time")).select("*", *(F.col(f"dl_preds.{s}").alias(s) for s in SCORES)).drop("dl_preds")


def parse_comment_time(c: str | Column) -> Column:
    """A comment's written time up to `(UTC)`; null if it can't be read."""
    c = F.col(c) if isinstance(c, str) else c
    return parse_date(F.split(c, r"\(UTC\)")[0])


def filter_before(rows: DataFrame, cutoffs: DataFrame, *, time: str = "thread_time", cutoff: str = "cutoff") -> DataFrame:
    """Rows of threads begun before the page's cutoff; without a readable time or cutoff they are dropped."""
    return rows.join(cutoffs.select("page_id", F.col(cutoff).alias("__cut")), "page_id").where(F.col(time) < F.col("__cut")).drop("__cut")


def thread_counts(comments: DataFrame) -> DataFrame:
    """Threads, threads without comments, comments, authors, and distinct authors per thread (mean, median)."""
    n = F.count("pos")
    per = comments.groupBy("page_id", "thread").agg(n.alias("n"), F.count_distinct("author").alias("a"))
    some = F.when(F.col("n") > 0, F.col("a"))
    t = per.groupBy("page_id").agg(F.count(F.lit(1)).alias("num_discussions"), F.count(F.when(F.col("n") == 0, 1)).alias("uncommented"), F.avg(some).alias("avg_authors"), F.median(some).alias("median_authors"))
    return t.join(comments.groupBy("page_id").agg(n.alias("num_comments"), F.count_distinct("author").alias("num_authors")), "page_id")


def thread_depth(comments: DataFrame, *, compat: bool = False) -> DataFrame:
    """Mean over threads of the mean depth, and of the share of comments of depth 0."""
    per = comments.groupBy("page_id", "thread").agg(F.avg("depth").alias("d"), F.avg((F.col("depth") == 0).cast("double")).alias("z"))
    mean = lambda c: zero_null(steady_avg(c), F.max(c), compat)
    return per.groupBy("page_id").agg(mean("d").alias("avg_depth"), mean("z").alias("depth_zero_avg"))


def steady_avg(c: str) -> Column:
    """The mean of doubles, whatever their order: summed as decimals of 18 places, so that a mean on a rounding limit stays
    there. Where a value or the sum has no such decimal (NaN, above 10**20), Spark's own mean."""
    exact = F.col(c).try_cast("decimal(38,18)")
    return F.coalesce(F.when(F.count(exact) == F.count(c), F.try_divide(F.try_sum(exact).cast("double"), F.count(c))), F.avg(c))


def zero_null(value: Column, top: Column, compat: bool) -> Column:
    return F.when(top != 0, value) if compat else value


def reply_stats(comments: DataFrame, *, compat: bool = False) -> DataFrame:
    """unreplied: share of comments of depth 0 without a reply; reply_seconds: mean time to the first reply. A reply counts
    if its root is listed before it. Comments without readable time are left out."""
    timed = comments.where("time is not null")
    root = timed.where("depth = 0").select("page_id", "thread", F.col("comment_id").alias("root_id"), F.col("pos").alias("root_pos"), F.col("time").alias("root_time"))
    reply = timed.where("depth <> 0").select("page_id", "thread", "root_id", F.col("pos").alias("p"), F.col("time").alias("t"))
    first = root.join(reply, ["page_id", "thread", "root_id"], "left").groupBy("page_id", "thread", "root_id", "root_time").agg(F.min(F.when(F.col("p") > F.col("root_pos"), F.col("t"))).alias("t"))
    wait = seconds("t") - seconds("root_time")
    wait = F.pmod(wait, F.lit(86_400)) if compat else wait
    return first.groupBy("page_id").agg(F.avg(F.col("t").isNull().cast("double")).alias("unreplied"), F.avg(wait).alias("reply_seconds"))


def interaction_counts(comments: DataFrame) -> DataFrame:
    """Distinct (author, refers_to) and (author, root_author) pairs."""
    pair = lambda c: F.count_distinct(F.when(F.col(c).isNotNull(), F.struct("author", c)))
    return comments.groupBy("page_id").agg(pair("refers_to").alias("direct"), pair("root_author").alias("indirect"))


def mixed_author_comments(comments: DataFrame) -> DataFrame:
    """Comments with more than one `talk` mark, and their share."""
    mixed = (F.regexp_count("text", F.lit("talk")) > 1).cast("long")
    return comments.where("pos is not null").groupBy("page_id").agg(F.sum(mixed).alias("mixed"), F.avg(mixed).alias("mixed_share"))


def interaction_edges(comments: DataFrame, to: str) -> DataFrame:
    return comments.where(F.col(to).isNotNull()).select("page_id", F.col("author").alias("src"), F.col(to).alias("dst")).distinct()


def interaction_triangles(comments: DataFrame, to: str, name: str) -> DataFrame:
    """Triangles of the undirected interaction graph over its nodes; 0 without interactions."""
    e = interaction_edges(comments, to)
    n = e.select("page_id", F.explode(F.array("src", "dst")).alias("x")).groupBy("page_id").agg(F.count_distinct("x").alias("n"))
    per = triangle_count(e).join(n, "page_id").select("page_id", (F.col("triangles") / F.col("n")).alias(name))
    return comments.select("page_id").distinct().join(per, "page_id", "left").na.fill(0.0, [name])


def score_overall(comments: DataFrame, *, compat: bool = False) -> DataFrame:
    """Mean of each score, and shares beyond the thresholds."""
    means = [zero_null(steady_avg(s), F.max(F.abs(s)), compat).alias(f"{s}_mean") for s in SCORES]
    return comments.groupBy("page_id").agg(*means, *(F.avg(F.expr(test).cast("double")).alias(f"{name}_share") for name, _, test in SHARES))


def score_per_user(comments: DataFrame) -> DataFrame:
    """Mean and median over authors of their mean scores."""
    per = comments.groupBy("page_id", "author").agg(*(steady_avg(s).alias(s) for s in SCORES))
    return per.groupBy("page_id").agg(*(f(s).alias(f"user_{s}_{n}") for s in SCORES for f, n in ((steady_avg, "mean"), (F.median, "median"))))


def discussion_features(comments: DataFrame, *, compat: bool = False) -> DataFrame:
    """The DISCUSSIONS_ columns of pages with threads."""
    per = comments.where("pos is not null").groupBy("page_id", "author").agg(F.count(F.lit(1)).alias("n"))
    blocks = [thread_counts(comments), thread_depth(comments, compat=compat), reply_stats(comments, compat=compat), interaction_counts(comments), mixed_author_comments(comments).drop("mixed_share"),
              interaction_triangles(comments, "refers_to", "direct_triangles"), interaction_triangles(comments, "root_author", "indirect_triangles"),
              score_overall(comments, compat=compat), score_per_user(comments), gini(per, "page_id", "n")]
    out = blocks[0]
    for b in blocks[1:]:
        out = out.join(b, "page_id", "left")
    return out.select("page_id", *(F.col(c).alias(f"DISCUSSIONS_{c}") for c in out.columns if c != "page_id"))


def username_map(names: DataFrame) -> DataFrame:
    """name, user_id (the first by pos), conflict (several ids); null ids are skipped."""
    return names.where("user_id is not null").groupBy("name").agg(F.min_by("user_id", "pos").alias("user_id"), (F.count_distinct("user_id") > 1).alias("conflict"))


def fill_user_ids(comments: DataFrame, users: DataFrame) -> DataFrame:
    """author_id, refers_to_author_id and root_author_id from the name map where they are missing."""
    out = comments
    for name, target in (("author", "author_id"), ("refers_to", "refers_to_author_id"), ("root_author", "root_author_id")):
        m = users.select(F.col("name").alias(f"__{name}"), F.col("user_id").alias("__id"))
        out = out.join(m, F.col(name) == F.col(f"__{name}"), "left").withColumn(target, F.coalesce(target, "__id")).drop(f"__{name}", "__id")
    return out


def attach_scores(comments: DataFrame, scored: DataFrame, *, scores: tuple[str, ...] = SCORES) -> DataFrame:
    """Scores of comments (page_id, pos, text): of the scored row at the same position if its text is equal (null as empty), else of
    the page's first row with that text, else null; page_missing tells whether any comment of the page stays without."""
    s = scored.select("page_id", F.col("pos").alias("__pos"), F.coalesce("text", F.lit("")).alias("__text"), F.struct(*scores).alias("__s"))
    c = comments.drop(*scores).withColumn("__t", F.coalesce("text", F.lit("")))
    same = s.select("page_id", F.col("__pos").alias("pos"), F.col("__text").alias("__t"), F.col("__s").alias("__same"))
    first = s.groupBy("page_id", F.col("__text").alias("__t")).agg(F.min_by("__s", "__pos").alias("__first"))
    out = c.join(same, ["page_id", "pos", "__t"], "left").join(first, ["page_id", "__t"], "left").withColumn("__s", F.coalesce("__same", "__first"))
    missing = out.groupBy("page_id").agg(F.bool_or(F.col("__s").isNull()).alias("page_missing"))
    return out.select(*comments.drop(*scores).columns, *(F.col(f"__s.{x}").alias(x) for x in scores)).join(missing, "page_id")
