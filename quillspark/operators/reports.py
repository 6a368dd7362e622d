"""Tables behind the figures: rates, durations, bins, error groups, lifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import exact_quantiles, running_counts

LABEL = ("far", "gar")
# Review outcomes by action.
RESULTS = {("far", 0): ("demoted", "failed", "removed"), ("far", 1): ("kept", "pass"), ("gar", 0): ("delisted", "failed", "not listed", "fail"), ("gar", 1): ("kept", "listed", "keep", "passed")}


def label_distribution(rows: DataFrame, label: str) -> DataFrame:
    """n and share (4 digits) of each label. The labels are few, so the window over all of them is."""
    per = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def yearly_rate(rows: DataFrame, date: str, label: str) -> DataFrame:
    return rows.where(F.col(date).isNotNull()).groupBy(F.year(date).alias("year")).agg((F.avg(F.col(label).cast("double")) * 100).alias("sustained"), F.count(F.lit(1)).alias("n"))


def join_topic_labels(tags: DataFrame, labels: DataFrame) -> DataFrame:
    """The labels of every topic's pages; pages without label have no row, a page's repeated tags count once."""
    return tags.select("page_id", "project_name").distinct().join(labels, "page_id")


def topic_rate(tags: DataFrame, labels: DataFrame) -> DataFrame:
    """Pages, sustained pages and their share for each topic."""
    return join_topic_labels(tags, labels).groupBy("project_name").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sustained"), F.avg("y").alias("share")).orderBy(F.desc("share"), "project_name")


def duration_summary(pages: DataFrame, columns: list[str]) -> DataFrame:
    """measure, n, mean and median (2 digits) of duration columns."""
    long = pages.select(F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in columns))).alias("e")).select("e.*")
    return long.groupBy("measure").agg(F.count("v").alias("n"), F.round(F.avg("v"), 2).alias("mean"), F.round(F.median("v"), 2).alias("median"))


def feature_by_class(rows: DataFrame, feature: str, label: str, *, upper: float = 0.95) -> DataFrame:
    return rows.groupBy(label).agg(F.avg(feature).alias("mean"), F.median(feature).alias("median"), F.percentile(feature, F.lit(upper)).alias("upper"))


def dataset_stats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """feature, sum, mean, median, std of columns."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns))).alias("e")).select("e.*")
    return long.groupBy("feature").agg(F.sum("v").alias("sum"), F.avg("v").alias("mean"), F.median("v").alias("median"), F.stddev_samp("v").alias("std"))


def missing_count(rows: DataFrame) -> DataFrame:
    return rows.agg(sum((F.count(F.when(F.col(c).isNull(), 1)) for c in rows.columns), F.lit(0)).alias("missing"))


def non_null_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(*(F.count(c).alias(c) for c in rows.columns))


def review_outcomes(events: DataFrame) -> DataFrame:
    """page_id, action, outcome (1 passed, 0 failed) of reviews with a known result."""
    out = F.lit(None).cast("int")
    for (action, value), results in RESULTS.items():
        out = F.when((F.col("action") == action) & F.col("result").isin(*results), value).otherwise(out)
    return events.withColumn("outcome", out).where("outcome is not null").select("page_id", "action", "outcome")


def reviews_per_page(outcomes: DataFrame, usecase: str) -> DataFrame:
    kinds = ("far",) if usecase == "fa" else ("gar", "far")
    return outcomes.where(F.col("action").isin(*kinds)).groupBy("page_id").agg(F.count(F.lit(1)).alias("reviews"), F.sum("outcome").alias("passed"))


def reindex_fill(population: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviews of every page of the predictions, 0 where there are none; demoted pages without any count as one failed into (1, 1)."""
    j = population.join(reviews, "page_id", "left").na.fill(0, ["reviews", "passed"])
    bare = (F.col("y") == 0) & (F.col("reviews") == 0)
    return j.withColumns({"passed": F.when(bare, 1).otherwise(F.col("passed")), "reviews": F.when(bare, 1).otherwise(F.col("reviews"))})


def review_load_by_group(rows: DataFrame) -> DataFrame:
    """Mean, population deviation, n and half width of reviews of each error group and of negatives, positives, all."""
    groups = F.array(F.col("error_group"), F.when(F.col("error_group").isin("TN", "FN"), "negatives").otherwise("positives"), F.lit("all"))
    g = rows.select(F.explode(groups).alias("group"), "reviews").groupBy("group").agg(F.avg("reviews").alias("mean"), F.stddev_pop("reviews").alias("std"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("half_width", 1.96 * F.col("std") / F.sqrt("n"))


def review_comparison(populations: dict[str, DataFrame], reviews: DataFrame) -> DataFrame:
    """was_reviewed and num_reviews of each page of several populations, stacked."""
    out = None
    for name, pages in populations.items():
        j = pages.select("page_id").join(reviews.select("page_id", "reviews"), "page_id", "left")
        j = j.select("page_id", F.lit(name).alias("population"), F.col("reviews").isNotNull().cast("int").alias("was_reviewed"), F.coalesce("reviews", F.lit(0)).alias("num_reviews"))
        out = j if out is None else out.unionByName(j)
    return out


def qcut_edges(rows: DataFrame, value: str, bins: int = 8) -> list[float]:
    """Distinct quantile edges of a column (bins + 1 numbers at most)."""
    return sorted(set(exact_quantiles(rows, value, [i / bins for i in range(bins + 1)])))


def qcut(value: str | Column, edges: list[float]) -> Column:
    """Bin number from 0: right-closed, the lowest edge included."""
    v = F.col(value) if isinstance(value, str) else value
    n = sum(((v > e).cast("int") for e in edges[1:-1]), F.lit(0))
    return F.when(v.isNotNull(), n)


def bin_label(edges: list[float], i: int, *, whole: bool = False) -> str:
    a, b = edges[i], edges[i + 1]
    return f"[{int(a)}, {int(b)})" if whole else f"[{a:.2f}, {b:.2f})"


def qcut_bins(rows: DataFrame, value: str, bins: int = 8, *, whole: bool = False) -> DataFrame:
    """rows with bin and label."""
    edges = qcut_edges(rows, value, bins)
    names = F.array(*(F.lit(bin_label(edges, i, whole=whole)) for i in range(len(edges) - 1))) if len(edges) > 1 else F.array(F.lit(""))
    return rows.withColumn("bin", qcut(value, edges)).withColumn("label", F.get(names, F.col("bin")))


def bin_heatmap(rows: DataFrame, a: str, b: str, label: str, *, bins: int = 8, least: int = 10) -> DataFrame:
    """Mean of the inverted label and n over two binned features; null in cells of fewer than `least` rows."""
    r = rows.withColumn("bin_a", qcut(a, qcut_edges(rows, a, bins))).withColumn("bin_b", qcut(b, qcut_edges(rows, b, bins)))
    return r.groupBy("bin_a", "bin_b").agg(F.count(F.lit(1)).alias("n"), F.avg(1 - F.col(label)).alias("m")).select("bin_a", "bin_b", "n", F.when(F.col("n") >= least, F.col("m")).alias("lost"))


def decile_cutoffs(rows: DataFrame, value: str) -> DataFrame:
    """decile (1 to 10) and cutoff, truncated."""
    cutoffs = [(i, int(c)) for i, c in enumerate(exact_quantiles(rows, value, [i / 10 for i in range(1, 11)]), 1)]
    return rows.sparkSession.createDataFrame(cutoffs, "decile int, cutoff long")


def relabel_by_cutoff(rows: DataFrame, cutoffs: DataFrame, value: str) -> DataFrame:
    """Each row under each of the ten cutoffs: 0 if the value is at most the cutoff, else (null too) 1."""
    return rows.crossJoin(F.broadcast(cutoffs)).withColumn("relabelled", F.when(F.col(value) <= F.col("cutoff"), 0).otherwise(1))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks for ties: ranks of distinct values come from cumulated counts."""
    known = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())

    def ranks(c: str) -> DataFrame:
        run = running_counts(known.groupBy(c).agg(F.count(F.lit(1)).alias("n")), c, "n")
        return run.select(c, (F.col("before") + (F.col("n") + 1) / 2).alias(f"rank_{c}"))

    return known.join(ranks(a), a).join(ranks(b), b).agg(F.corr(f"rank_{a}", f"rank_{b}").alias("spearman"))


def histogram(rows: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    b = F.least(F.lit(bins), F.expr(f"width_bucket({value}, {lo}D, {hi}D, {bins})"))
    return rows.where(F.col(value).between(lo, hi)).groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def density_curve(rows: DataFrame, value: str, label: str, *, points: int = 20) -> DataFrame:
    """Gaussian density of each class at grid points; bandwidth n ** -0.2 times the deviation. Rows are counted by value first."""
    s = rows.where(F.col(value).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("k"), F.stddev_samp(value).alias("sd"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    s = s.withColumn("h", F.col("sd") * F.pow("k", F.lit(-0.2)))
    grid = s.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1))
    per = rows.where(F.col(value).isNotNull()).groupBy(label, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("m"))
    z = (F.col("x") - F.col("v")) / F.nullif("h", F.lit(0.0))
    dens = F.sum(F.col("m") * F.exp(-z * z / 2)) / F.first(F.col("k") * F.nullif("h", F.lit(0.0)) * 2.5066282746310002)
    return per.join(F.broadcast(grid), label).groupBy(label, "i", "x").agg(dens.alias("density"))


def normalize_lift(table: DataFrame) -> DataFrame:
    """Lift of F1 over the minority share and of AUC over chance, with error bars, of rows f1, f1_std, auc, auc_std, minority."""
    m = F.col("minority")
    bar = lambda c, base: 1.96 * F.col(c) / 10 / base
    return table.select("*", F.try_divide(F.col("f1") - m, m).alias("f1_lift"), ((F.col("auc") - 0.5) / 0.5).alias("auc_lift"), bar("f1_std", F.nullif(m, F.lit(0.0))).alias("f1_bar"), bar("auc_std", F.lit(0.5)).alias("auc_bar"))


def contribution_summary(rows: DataFrame, *, top: int = 10) -> DataFrame:
    """feature, mean absolute contribution, sign of the mean over class 1, of a (row, feature, contribution, y) table; the first `top`."""
    g = rows.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("strength"), F.signum(F.avg(F.when(F.col("y") == 1, F.col("contribution")))).alias("direction"))
    return g.orderBy(F.desc("strength"), "feature").limit(top)


def top_k(rows: DataFrame, k: int, *, lowest: bool = True) -> DataFrame:
    """The k lowest or highest scored rows of each true class, ties by id."""
    w = Window.partitionBy("y").orderBy(F.col("p").asc() if lowest else F.col("p").desc(), "id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
