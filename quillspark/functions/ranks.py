"""Ranks and exact quantiles without a sort of all rows in one task: distinct values are dealt into ranges, whose bounds come from a
mergeable sketch; a range's offset is the sum of the ranges before it. Bounds only decide how even the ranges are."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256


def running_counts(per: DataFrame, value: str, count: str, *, ranges: int = RANGES) -> DataFrame:
    """per (distinct numbers and how often each occurs) with `before`, the sum of the counts of smaller values."""
    v = F.col(value).cast("double")
    per = per.where(v.isNotNull()).cache()
    bounds = per.agg(F.percentile_approx(v, F.array(*(F.lit(i / ranges) for i in range(1, ranges))), F.lit(20 * ranges)).alias("b")).first().b or []
    cuts = F.array(*map(F.lit, sorted(set(bounds)))).cast("array<double>")
    dealt = per.withColumn("__range", F.size(F.filter(cuts, lambda b: b < v)))
    sums = {r["__range"]: r.n for r in dealt.groupBy("__range").agg(F.sum(count).alias("n")).collect()}  # `ranges` numbers at most
    offsets, total = [], 0
    for i in range(len(set(bounds)) + 1):
        offsets.append(total)
        total += sums.get(i, 0)
    inside = F.sum(count).over(Window.partitionBy("__range").orderBy(v).rowsBetween(Window.unboundedPreceding, -1))
    return dealt.withColumn("before", F.get(F.array(*map(F.lit, offsets)), F.col("__range")).cast("long") + F.coalesce(inside, F.lit(0))).drop("__range")


def exact_quantiles(rows: DataFrame, value: str, shares: list[float]) -> list[float]:
    """Quantiles with linear interpolation between neighbours, as doubles; nulls are left out, no values give an empty list."""
    per = rows.groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    run = running_counts(per, "v", "n").cache()
    total = run.agg(F.sum("n")).first()[0]
    if not total:
        return []
    at = [s * (total - 1) for s in shares]
    places = sorted({i for p in at for i in (math.floor(p), math.ceil(p))})
    asked = F.filter(F.array(*map(F.lit, places)), lambda i: (i >= F.col("before")) & (i < F.col("before") + F.col("n")))
    held = {i: r.v for r in run.withColumn("i", asked).where(F.size("i") > 0).select("v", "i").collect() for i in r.i}
    return [held[math.floor(p)] if p == math.floor(p) else (math.ceil(p) - p) * held[math.floor(p)] + (p - math.floor(p)) * held[math.ceil(p)] for p in at]
