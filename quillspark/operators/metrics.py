"""Evaluation of predictions: rows of id, y (0 or 1) and p (score of class 1), all in aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLDS = [round(0.05 * i, 2) for i in range(1, 20)]
#: t(0.975) by degrees of freedom, to three digits (fixed values)
T975 = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228, 20: 2.086, 30: 2.042, 100: 1.984}


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def confusion(rows: DataFrame, threshold: float | Column, *by: str) -> DataFrame:
    """tp, fp, fn, tn of class 1 when 1 is predicted above the threshold."""
    one, t = F.col("p") > threshold, F.col("y") == 1
    n = lambda c: F.count(F.when(c, 1))
    return rows.groupBy(*by).agg(n(one & t).alias("tp"), n(one & ~t).alias("fp"), n(~one & t).alias("fn"), n(~one & ~t).alias("tn"))


def measures(counts: DataFrame, *keep: str) -> DataFrame:
    """Accuracy, macro precision, recall and F1, and those of class 0, from confusion counts; undefined ones are 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p1, r1, p0, r0 = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fn), ratio(tn, tn + fp)
    return counts.select(
        *keep, ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ((p1 + p0) / 2).alias("macro_precision"), ((r1 + r0) / 2).alias("macro_recall"),
        ((f1(tp, fp, fn) + f1(tn, fn, fp)) / 2).alias("macro_f1"), p0.alias("binary_precision"), r0.alias("binary_recall"), f1(tn, fn, fp).alias("binary_f1"),
    )


def threshold_scores(rows: DataFrame, *by: str) -> DataFrame:
    """Measures at the 19 thresholds; rows are counted by the step of their score first, so one shuffle of 20 rows a task."""
    step = F.aggregate(F.array(*map(F.lit, THRESHOLDS)), F.lit(0), lambda n, t: n + (F.col("p") > t).cast("int"))
    per = rows.groupBy(*by, step.alias("step")).agg(F.count(F.when(F.col("y") == 1, 1)).alias("n1"), F.count(F.when(F.col("y") == 0, 1)).alias("n0"))
    cuts = F.posexplode(F.array(*map(F.lit, THRESHOLDS))).alias("i", "threshold")
    each = per.select("*", cuts)
    above = F.col("step") > F.col("i")
    n = lambda c, v: F.sum(F.when(c, F.col(v)).otherwise(0))
    return measures(each.groupBy(*by, "threshold").agg(n(above, "n1").alias("tp"), n(above, "n0").alias("fp"), n(~above, "n1").alias("fn"), n(~above, "n0").alias("tn")), *by, "threshold")


def find_threshold(rows: DataFrame, *by: str, measure: str = "macro_f1") -> DataFrame:
    """The first threshold of the highest F1 (macro_f1, or binary_f1 of class 0)."""
    best = threshold_scores(rows, *by).groupBy(*by).agg(F.max_by(F.struct("threshold", measure), F.struct(F.round(measure, 12), -F.col("threshold"))).alias("b"))
    return best.select(*by, "b.*")


def rank_auc(rows: DataFrame, *by: str) -> DataFrame:
    """ROC AUC, ties counting half: of counts by distinct score, so equal scores are one row and the window is over scores only."""
    per = rows.groupBy(*by, "p").agg(F.count(F.when(F.col("y") == 1, 1)).alias("a"), F.count(F.when(F.col("y") == 0, 1)).alias("b"))
    below = F.sum("b").over(Window.partitionBy(*by).orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    return per.withColumn("w", F.col("a") * (F.coalesce(below, F.lit(0)) + F.col("b") / 2)).groupBy(*by).agg(F.try_divide(F.sum("w"), F.sum("a") * F.sum("b")).alias("auc"))


def average_precision(rows: DataFrame, *by: str, compat: bool = False) -> DataFrame:
    """Sum of precision times the rise of recall, from the highest score down. compat: over hard predictions (p > 0.5)."""
    if compat:
        rows = rows.withColumn("p", (F.col("p") > 0.5).cast("double"))
    per = rows.groupBy(*by, "p").agg(F.count(F.when(F.col("y") == 1, 1)).alias("a"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("v", F.col("a") * F.sum("a").over(w) / F.sum("n").over(w))
    return per.groupBy(*by).agg(F.try_divide(F.sum("v"), F.sum("a")).alias("average_precision"))


def precision_at_k(rows: DataFrame, k: float, *, target: int = 1) -> DataFrame:
    """Share of the target class among the first k percent by score (lowest first for class 0), ties by id."""
    if not 0 < k <= 100:
        raise ValueError("k must be above 0 and at most 100")
    order = F.col("p").asc() if target == 0 else F.col("p").desc()
    cutoff = int(rows.count() * k / 100)
    return rows.orderBy(order, "id").limit(cutoff).agg(F.avg((F.col("y") == target).cast("double")).alias("precision_at_k"))


def confusion_groups(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    one, t = F.col("p") > threshold, F.col("y") == 1
    return rows.withColumn("error_group", F.when(one & t, "TP").when(one, "FP").when(t, "FN").otherwise("TN"))


def eval_measures(rows: DataFrame, macro_threshold: float = 0.5, binary_threshold: float = 0.5, *, compat: bool = False) -> DataFrame:
    """One row with the 22 measures of a scored set (none of an empty one). The precision at 5 percent is named so, not after 10 percent."""
    cuts = rows.sparkSession.createDataFrame([(0, float(macro_threshold), float(binary_threshold))], "fold int, macro_optimal_th double, binary_optimal_th double")
    return eval_folds(rows.select(F.lit(0).alias("fold"), "id", "p", "y"), cuts, compat=compat).drop("fold")


def fold_thresholds(rows: DataFrame) -> DataFrame:
    """fold, macro_optimal_th, binary_optimal_th: find_threshold by both measures, from one table of the 19 thresholds."""
    best = lambda measure: F.max_by("threshold", F.struct(F.round(measure, 12), -F.col("threshold")))
    return threshold_scores(rows, "fold").groupBy("fold").agg(best("macro_f1").alias("macro_optimal_th"), best("binary_f1").alias("binary_optimal_th"))


def eval_folds(rows: DataFrame, cuts: DataFrame, *, compat: bool = False) -> DataFrame:
    """The 22 measures of eval_measures for each fold of rows (fold, id, y, p), at the fold's thresholds (0.5 where it has none).
    The confusion counts at all three thresholds are one aggregate."""
    r = rows.join(F.broadcast(cuts), "fold", "left").na.fill(0.5, ["macro_optimal_th", "binary_optimal_th"])
    cut = {"half": F.lit(0.5), "macro": F.col("macro_optimal_th"), "binary": F.col("binary_optimal_th")}
    one = F.col("y") == 1
    cells = {f"{name}_{c}": F.count(F.when(test, 1)) for name, t in cut.items() for c, test in (("tp", (F.col("p") > t) & one), ("fp", (F.col("p") > t) & ~one), ("fn", ~(F.col("p") > t) & one), ("tn", ~(F.col("p") > t) & ~one))}
    counts = r.groupBy("fold", "macro_optimal_th", "binary_optimal_th").agg(F.count(F.lit(1)).alias("n"), *(v.alias(k) for k, v in cells.items())).cache()
    plain = {"accuracy": "macro_accuracy"} | {c: c for c in ("macro_precision", "macro_recall", "macro_f1", "binary_precision", "binary_recall", "binary_f1")}
    names = {"half": plain} | {k: {"accuracy": f"{k}_accuracy_opt_th"} | {f"{k}_{m}": f"{k}_{m}_opt_th" for m in ("precision", "recall", "f1")} for k in ("macro", "binary")}
    out = counts.select("fold", "n", "macro_optimal_th", "binary_optimal_th")
    for name, kept in names.items():
        at = measures(counts.select("fold", *(F.col(f"{name}_{c}").alias(c) for c in ("tp", "fp", "fn", "tn"))), "fold")
        out = out.join(at.select("fold", *(F.col(a).alias(b) for a, b in kept.items())), "fold")
    w = Window.partitionBy("fold")
    placed = rows.withColumn("place", F.row_number().over(w.orderBy("p", "id"))).withColumn("size", F.count(F.lit(1)).over(w))
    lowest = placed.groupBy("fold").agg(*(F.avg(F.when(F.col("place") <= F.floor(F.col("size") * k / 100), (F.col("y") == 0).cast("double"))).alias(f"binary_prec_at_{k}_perc") for k in (2, 5)))
    for block in (rank_auc(rows, "fold"), average_precision(rows, "fold", compat=compat), lowest):
        out = out.join(block, "fold", "left")
    return out


def eval_summary(table: DataFrame, *, folds: int) -> DataFrame:
    """measure, mean, std, lo, hi of a long table (fold, measure, value). The published rule: the population deviation of the
    folds, and an interval of t(0.975, folds) times it, without the root of n, rounded to three digits."""
    t = T975.get(folds, 1.96)
    out = table.groupBy("measure").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return out.select("*", F.round(F.col("mean") - t * F.col("std"), 3).alias("lo"), F.round(F.col("mean") + t * F.col("std"), 3).alias("hi"))
