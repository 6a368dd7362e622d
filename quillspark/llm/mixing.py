"""Mixing sources to target weights by entropy balancing.

Document rates r minimise the sum of r log r - r + 1, that is, stay as near to 1 as they can, under the constraints that the
words taken from each source, the sum of rate times size, equal its target and that no rate exceeds `cap`. The solution is an
exponential tilt of the size, r = min(cap, exp(lambda * size / mean size)), with one multiplier for each source, where the
convex dual has its minimum. Newton iterations find them: the dual's gradient and curvature are sums over the histogram of
(source, size), which stands for all documents exactly and is summed by Spark in each iteration; a bracket around each
multiplier turns a step that leaves it into a bisection. Only these sums, a row for each source, come to the driver.

Sums are taken over rates in units of 2**-32, as whole numbers, so their order doesn't matter and reruns agree.

Rates become copies by systematic rounding: documents of a source stand in order of their size, and a document gets its extra
copy where the running sum of fractions passes the next half. As neighbours differ little in size, a source's words miss their
target by one document or so. A (source, size) of more than CELL documents is dealt into cells by a hash of the id; each
rounds for itself from a start drawn by its hash, so no task holds more than a cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST, to_table

SOURCES = 1 << 16  # sources at most; an error beyond
CELL, ONE = 512, 1 << 32
STEPS, CLOSE = 80, 1e-7


def word_count(text: str | Column) -> Column:
    """Number of maximal runs without ASCII blanks; null: 0."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shared_targets(sizes: dict[str | None, int], weights: tuple[int, ...], share: Fraction, cap: int) -> dict[str | None, float]:
    """Targets that share `share` of all sizes by weight: weights repeat over the sources by code point, null last. A target
    stops at cap times its source's size; what is left over goes to the others by weight, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        a_weight = Fraction(left) / sum(weight[s] for s in free)
        full = {s for s in free if a_weight * weight[s] > cap * sizes[s]}
        if not full:
            return out | {s: float(a_weight * weight[s]) for s in free}
        out |= {s: float(cap * sizes[s]) for s in full}
        left -= cap * sum(sizes[s] for s in full)
        free -= full
    return out


def rate_units(multiplier: Column, size: Column, mean: Column, cap: int) -> Column:
    """The rate in units of 1 / ONE, a whole number."""
    return F.round(F.least(F.lit(float(cap)), F.exp(multiplier * size / mean)) * ONE).cast("long")


class Multiplier:
    """One source's multiplier with its bracket."""

    def __init__(self, target: float, size: int, n: int, least: int, cap: int):
        self.target, self.size, self.mean = target, size, size / n
        self.at, self.done = 0.0, size == 0
        top = math.log(cap) * self.mean / least if least else 0.0  # there all rates are the cap
        self.low, self.high = -math.inf, max(top, 0.0)
        if not self.done and target >= cap * size:
            self.at, self.done = 2 * self.high + 1, True
        if not self.done and target <= 0:
            self.at, self.done = -1e6 * self.mean, True

    def step(self, taken: float, slope: float) -> None:
        if self.done or abs(taken - self.target) <= CLOSE * min(self.target, self.size):
            self.done = True
            return
        if taken < self.target:
            self.low = self.at
        else:
            self.high = self.at
        to = self.at + (self.target - taken) / slope if slope > 0 else math.nan
        if not self.low < to < self.high:
            to = 2 * min(self.high, 0.0) - 1 if self.low == -math.inf else (self.low + self.high) / 2
        self.done, self.at = to == self.at, to


def solve(histogram: DataFrame, targets: dict[str | None, float], cap: int) -> dict[str | None, Multiplier]:
    """Multipliers of all sources. histogram: source, size, n. Sources of no words keep rate 1."""
    spark = histogram.sparkSession
    rows = histogram.where("size > 0").groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("size"), F.min("size").alias("least")).collect()
    out = {r.source: Multiplier(targets[r.source], r.size, r.n, r.least, cap) for r in rows}
    for _ in range(STEPS):
        open_ = {s: m for s, m in out.items() if not m.done}
        if not open_:
            break
        now = spark.createDataFrame([(s, m.at, m.mean) for s, m in open_.items()], "source string, at double, mean double")
        here = histogram.where("size > 0").join(F.broadcast(now.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")))
        units = here.withColumn("r", rate_units(F.col("at"), F.col("size"), F.col("mean"), cap))
        words = F.col("r").cast("decimal(18,0)") * (F.col("n") * F.col("size")).cast("decimal(20,0)")
        bent = F.when(F.col("r") < cap * ONE, words * F.col("size").cast("decimal(10,0)"))
        sums = units.groupBy("source").agg(F.sum(words.cast("decimal(38,0)")).alias("g"), F.sum(F.coalesce(bent, F.lit(0)).cast("decimal(38,0)")).alias("h")).collect()
        for r in sums:
            m = open_[r.source]
            m.step(int(r.g) / ONE, int(r.h) / ONE / m.mean)
    return out


def mix(docs: DataFrame, targets: Callable[[dict], dict], *, cap: int = 2, seed: int = 42, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken (copies times size) of every row of docs.

    targets: from words by source to wanted words by source; one above cap times its source counts as that. Sizes are words
    (word_count). Null, empty and blank texts have size 0, rate and copies 1; a source of such texts only is not mixed. Null is
    a source of its own. Very long texts are counted whole. Repeated rows (equal id, source and size) are rounded together and
    returned each; an empty table gives none. Other columns aren't read. An id may be null.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(f"`{text}`").alias("size"))
    sized = to_table(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m")), "mix-sizes")
    histogram = to_table(sized.groupBy("source", "size").agg(F.sum("m").alias("n")), "mix-histogram")
    per = histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("size")).limit(SOURCES + 1).collect()
    if len(per) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    sizes = {r.source: r.size for r in per}
    wanted = targets(sizes) if sizes else {}
    found = solve(histogram, wanted, cap)
    spark = docs.sparkSession
    state = spark.createDataFrame(
        [(s, n, float(wanted[s]), found[s].at if s in found else 0.0, found[s].mean if s in found else 1.0) for s, n in sizes.items()],
        "s string, source_size long, target double, at double, mean double",
    )
    cells = histogram.join(F.broadcast(state), F.col("source").eqNullSafe(F.col("s")))
    cells = cells.withColumn("r", rate_units(F.col("at"), F.col("size"), F.col("mean"), cap)).withColumn("part", F.col("r") % ONE)
    total = F.sum(F.col("n").cast("decimal(18,0)") * F.col("part").cast("decimal(18,0)"))
    before = total.over(Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select(
        F.col("source").alias("s"), F.col("size").alias("z"), "source_size", "target", "r", "part", F.ceil(F.col("n") / CELL).cast("long").alias("cells"),
        F.coalesce(before % ONE, F.lit(0)).cast("long").alias("start"),
    )
    cells = to_table(cells, "mix-cells")
    small = cells.count() <= BROADCAST
    drawn = sized.join(F.broadcast(cells) if small else cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    drawn = drawn.withColumn("key", F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)))).withColumn("cell", F.pmod("key", F.col("cells")))
    from_ = F.when(F.col("cells") == 1, F.col("start")).otherwise(F.pmod(F.xxhash64(F.lit(seed), "source", "size", "cell"), F.lit(ONE)))
    upto = F.sum("m").over(Window.partitionBy("source", "size", "cell").orderBy("key", F.col("doc_id").asc_nulls_last()))

    def passed(rank: Column) -> Column:
        units = F.col("from").cast("decimal(20,0)") + rank.cast("decimal(18,0)") * F.col("part").cast("decimal(18,0)")
        return F.floor((units + ONE // 2) / ONE).cast("long")

    drawn = drawn.withColumn("from", from_).withColumn("upto", upto).withColumn("more", (passed(F.col("upto")) - passed(F.col("upto") - F.col("m"))).cast("long"))
    each = drawn.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    copies = (F.floor(F.col("r") / ONE) + (F.col("k") <= F.col("more")).cast("long")).cast("long")
    return each.select("doc_id", "source", "size", "source_size", "target", (F.col("r") / ONE).alias("rate"), copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, mixed: DataFrame, *, doc_id: str = "doc_id") -> DataFrame:
    """docs, each row as often as `mixed` says. Ids must be unique and not null; rows of other ids are left out."""
    copies = mixed.where("copies > 0").select(F.col("doc_id").alias("__id"), F.col("copies").cast("int").alias("__copies"))
    rows = docs.join(copies, F.col(f"`{doc_id}`").cast("long") == F.col("__id"))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.array_repeat(F.lit(0), F.col("__copies"))).alias("__copy")).drop("__copy")
