"""Modeling tables, splits, classifiers and time-aware evaluation. Rows have id, y (0 or 1) and features."""

from __future__ import annotations

from pyspark.ml.feature import Imputer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .edits import community_dynamics, edit_features
from .lifecycle import filter_until, valid_for_usecase
from .logit import coefficients, fit_splits, with_z
from .metrics import eval_folds, fold_thresholds
from .network import editor_edges, network_features
from .reports import decile_cutoffs, relabel_by_cutoff
from .trees import Bagged, Boosted, grow_splits, importances, tree_scores
from .wikitext import topic_pivot

SEED = 1984
PLACES = 6  # digits of a probability
LOGIT_STEPS = 12
LEARNERS = {"gbt": lambda trees: Boosted(trees=trees), "rf": lambda trees: Bagged(trees=trees)}


def select_feature_groups(columns: list[str], *, target: str = "y", off: tuple[str, ...] = (), only: list[str] | None = None) -> list[str]:
    """Feature columns: all but id, target and TIME_*, without disabled prefixes, or an explicit list."""
    return list(only) if only else [c for c in columns if c not in ("id", "page_id", target) and not c.startswith(("TIME_", *off))]


def join_blocks(blocks: list[DataFrame], key: str = "page_id") -> DataFrame:
    out = blocks[0]
    for b in blocks[1:]:
        out = out.join(b, key)
    return out


def article_features(revisions: DataFrame, pages: DataFrame, usecase: str) -> tuple[DataFrame, DataFrame]:
    """(feature rows of usable pages promoted to a level, ids of promoted pages left out). pages is a life-cycle table; the features
    are those of the revisions before promotion. A network column is null on a page without editor edges."""
    promoted = pages.where(F.col(f"{usecase}_promotion").isNotNull()).withColumn("promotion", F.col(f"{usecase}_promotion"))
    usable = F.col("is_valid") & valid_for_usecase(usecase)
    good = promoted.where(usable).cache()
    before = filter_until(revisions, good, "promotion").cache()
    last = before.groupBy("page_id").agg(F.max("ts").alias("TIME_last_revision_timestamp"))
    base = good.select(
        "page_id", F.col("label").cast("int").alias("y"), F.col("promotion").alias("TIME_promotion_date"), F.col(f"{usecase}_demotion").alias("TIME_demotion_date"),
        F.year("promotion").alias("TIME_promotion_year"), F.col(f"{usecase}_promotion_to_demotion").alias("TIME_days_to_demotion"),
    )
    community = community_dynamics(before.withColumn("sha1", F.lit(None).cast("string")) if "sha1" not in before.columns else before)
    community = community.withColumnsRenamed({c: f"COMPOSITION_{c}" for c in community.columns if c != "page_id"})
    out = base.join(last, "page_id", "left")
    for block in (edit_features(before, good), community, network_features(editor_edges(before))):
        out = out.join(block, "page_id", "left")
    return out, promoted.where(~usable).select("page_id")


def build_modeling_table(blocks: list[DataFrame], tags: DataFrame | None = None, *, topics: int = 247, max_year: int | None = None) -> DataFrame:
    """Inner join of feature blocks on page_id, with topic columns, up to a promotion year."""
    out = join_blocks(blocks + ([topic_pivot(tags, limit=topics)] if tags is not None else []))
    return out if max_year is None else out.where(F.col("TIME_promotion_year") <= max_year)


def place(rows: DataFrame, salt: str, *by: str) -> DataFrame:
    """rank (from 0) and size of each row within its class (of its group `by`), in the order of a hash of salt and id."""
    w = Window.partitionBy(*by, "y")
    h = F.md5(F.concat(F.lit(f"{salt}|"), F.col("id").cast("string")).cast("binary"))
    return rows.withColumn("rank", F.row_number().over(w.orderBy(h, "id")) - 1).withColumn("size", F.count(F.lit(1)).over(w))


def stratified_kfold(rows: DataFrame, k: int = 5, *, seed: int = SEED) -> DataFrame:
    """fold (0 to k - 1); classes are spread evenly."""
    return place(rows, str(seed)).withColumn("fold", F.col("rank") % k).drop("rank", "size")


def stratified_bootstrap(rows: DataFrame, n: int = 100, *, test: float = 0.2, seed: int = SEED) -> DataFrame:
    """Each row once for every replicate, with is_test for the first share of each class; the membership is computed, no split is stored."""
    each = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("replicate"))
    w = Window.partitionBy("replicate", "y")
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col("replicate").cast("string"), F.lit("|"), F.col("id").cast("string")).cast("binary"))
    placed = each.withColumn("rank", F.row_number().over(w.orderBy(h, "id"))).withColumn("size", F.count(F.lit(1)).over(w))
    return placed.withColumn("is_test", F.col("rank") <= F.ceil(F.col("size") * test)).drop("rank", "size")


def stratified_holdout(rows: DataFrame, *, test: float = 0.3, seed: int = SEED) -> DataFrame:
    return place(rows, f"{seed}|holdout").withColumn("is_test", F.col("rank") + 1 <= F.ceil(F.col("size") * test)).drop("rank", "size")


def mean_impute(train: DataFrame, rows: DataFrame, features: list[str]) -> DataFrame:
    """rows with missing values replaced by the means of train."""
    return Imputer(strategy="mean", inputCols=features, outputCols=features).fit(train).transform(rows)


def fold_run(train: DataFrame, test: DataFrame, features: list[str], **how) -> tuple[DataFrame, DataFrame, list[tuple[str, float]]]:
    """(measures of the test rows, their predictions id, p, y, pred at class 0's threshold, importances). Thresholds are those of the training rows."""
    columns = ["id", "y", *features]
    both = train.select(*columns, F.lit(False).alias("is_test")).unionByName(test.select(*columns, F.lit(True).alias("is_test"))).withColumn("fold", F.lit(0))
    trained, tested, weights = scored_splits(both, features, **how)
    cuts = fold_thresholds(trained).cache()
    return eval_folds(tested, cuts).drop("fold"), with_pred(tested, cuts).drop("fold"), [(r.feature, r.importance) for r in weights.collect()]


def long_measures(table: DataFrame) -> DataFrame:
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in table.columns if c != "fold"))).alias("e")
    return table.select("fold", cells).select("fold", "e.*")


def stacked(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def with_pred(tested: DataFrame, cuts: DataFrame) -> DataFrame:
    p = tested.join(F.broadcast(cuts), "fold", "left")
    return p.withColumn("pred", (F.col("p") > F.coalesce("binary_optimal_th", F.lit(0.5))).cast("int")).select("fold", "id", "p", "y", "pred")


def scored_splits(splits: DataFrame, features: list[str], *, learner: str = "gbt", trees: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(training rows, test rows: fold, id, p to PLACES digits, y; feature, importance summed over the splits).

    splits: fold, is_test, id, y and the features, a row for each split that it takes part in. All splits are fitted together, in grouped passes
    over the rows: Newton steps of `lr`, the levels of trees of `gbt` and `rf`."""
    splits = splits.select("fold", "is_test", "id", "y", *(F.col(f"`{f}`").cast("double").alias(f) for f in features)).cache()
    if learner == "lr":
        fits = fit_splits(splits, features)
        p = with_z(splits, features, fits)
        weights = [(f, float(sum(abs(fit.weights[j + 1]) for fit in fits.values()))) for j, f in enumerate(features)]
    else:
        nodes = grow_splits(splits, features, LEARNERS[learner](trees))
        p = tree_scores(splits, features, nodes)
        weights = importances(nodes, features)
    p = p.select("fold", "is_test", "id", F.round("p", PLACES).alias("p"), "y").cache()
    rows = splits.sparkSession.createDataFrame(weights, "feature string, importance double")
    return p.where("not is_test").drop("is_test"), p.where("is_test").drop("is_test"), rows


def run_splits(splits: DataFrame, features: list[str], **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fit every split: measures (fold, measure, value), predictions, summed importances (feature, importance)."""
    trained, tested, weights = scored_splits(splits, features, **how)
    cuts = fold_thresholds(trained).cache()
    return long_measures(eval_folds(tested, cuts)), with_pred(tested, cuts), weights


def kfold_splits(rows: DataFrame, k: int = 5, *by: str) -> DataFrame:
    """Every row once for each of the k folds (of its group `by`), with is_test in its own."""
    placed = place(rows, str(SEED), *by).withColumn("own", F.col("rank") % k).drop("rank", "size")
    return placed.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("is_test", F.col("own") == F.col("fold")).drop("own")


def cv_job(rows: DataFrame, features: list[str], *, k: int = 5, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    return run_splits(kfold_splits(rows, k), features, **how)


def bootstrap_job(rows: DataFrame, features: list[str], *, n: int = 100, test: float = 0.2, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    return run_splits(stratified_bootstrap(rows.select("id", "y", *features), n, test=test).withColumnRenamed("replicate", "fold"), features, **how)


def year_buckets(rows: DataFrame, year: str = "year", *, k: int = 5) -> DataFrame:
    """year, bucket: years in order, a new bucket when the next year would exceed 1.2 times an even part. Years are few."""
    counts = [(r[0], r[1]) for r in rows.where(F.col(year).isNotNull()).groupBy(year).count().orderBy(year).collect()]
    limit, bucket, held, out = 1.2 * sum(n for _, n in counts) / k, 0, 0, []
    for y, n in counts:
        if held + n > limit and bucket < k - 1:
            bucket, held = bucket + 1, 0
        out.append((int(y), bucket))
        held += n
    return rows.sparkSession.createDataFrame(out, "year int, bucket int")


def cv_by_time(rows: DataFrame, features: list[str], *, k: int = 5, **how):
    """Leave out one bucket of years at a time."""
    buckets = year_buckets(rows, k=k)
    each = rows.join(F.broadcast(buckets), "year")
    folds = buckets.select(F.col("bucket").alias("fold")).distinct()
    return run_splits(each.join(F.broadcast(folds), F.lit(True)).withColumn("is_test", F.col("bucket") == F.col("fold")), features, **how)


def per_period_holdout(rows: DataFrame, features: list[str], *, k: int = 5, test: float = 0.3, **how):
    """A stratified 70/30 split inside each bucket of years."""
    each = rows.join(F.broadcast(year_buckets(rows, k=k)), "year").withColumnRenamed("bucket", "fold")
    placed = place(each, f"{SEED}|holdout", "fold").withColumn("is_test", F.col("rank") + 1 <= F.ceil(F.col("size") * test))
    return run_splits(placed, features, **how)


def years_from(rows: DataFrame, initial: int) -> list[int]:
    """Years from the `initial`-th on. Years are few."""
    return sorted(r[0] for r in rows.select("year").distinct().where("year is not null").collect())[initial - 1 :]


def by_cutoff(rows: DataFrame, years: list[int]) -> DataFrame:
    """Every row once for each of the years, as `cutoff`."""
    return rows.withColumn("cutoff", F.explode(F.array(*map(F.lit, years)))) if years else rows.withColumn("cutoff", F.lit(0)).limit(0)


def expanding_year_eval(rows: DataFrame, features: list[str], *, initial: int = 3, k: int = 5, **how) -> DataFrame:
    """fold measures of a cross-validation on all rows up to each year, with that year; all years are fitted together."""
    upto = by_cutoff(rows, years_from(rows, initial)).where(F.col("year") <= F.col("cutoff"))
    splits = kfold_splits(upto, k, "cutoff").withColumn("fold", F.col("cutoff") * k + F.col("fold"))
    out = run_splits(splits, features, **how)[0]
    return out.select((F.col("fold") % k).alias("fold"), "measure", "value", F.floor(F.col("fold") / k).cast("int").alias("year"))


def sliding_year_eval(rows: DataFrame, features: list[str], *, initial: int = 3, lag: int = 3, move: bool = False, **how) -> DataFrame:
    """Train on years up to each year (or, moving, the years from year - lag to it, both included), test on later ones; splits with one class are skipped."""
    each = by_cutoff(rows, years_from(rows, initial)).withColumn("is_test", F.col("year") > F.col("cutoff")).withColumn("fold", F.col("cutoff"))
    each = each.where(F.col("year") >= F.col("cutoff") - lag if move else F.col("year").isNotNull()).cache()
    kinds = each.groupBy("fold", "is_test").agg(F.count_distinct("y").alias("n")).where("n = 2").groupBy("fold").count().where("count = 2").select("fold")
    return run_splits(each.join(F.broadcast(kinds), "fold", "left_semi"), features, **how)[0].withColumnRenamed("fold", "year")


def future_cohort_eval(rows: DataFrame, features: list[str], *, max_year: int, share: float = 0.05, **how) -> DataFrame:
    """Train up to a year, score newer pages: of the lowest `share`, n and the part that is of class 0."""
    newer = rows.where(F.col("year") > max_year)
    _, p, _ = fold_run(rows.where(F.col("year") <= max_year), newer, features, **how)
    k = max(1, int(p.count() * share))
    return p.orderBy("p", "id").limit(k).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("y") == 0).cast("double")).alias("precision"))


def decile_relabel_eval(rows: DataFrame, features: list[str], value: str, *, k: int = 5, **how) -> DataFrame:
    """decile, measure, n, mean: a cross-validation under each of the ten decile cutoffs of `value`, with the label that
    relabel_by_cutoff gives, all together. A cutoff that leaves one class has no rows."""
    each = relabel_by_cutoff(rows.drop("y"), decile_cutoffs(rows, value), value).withColumnRenamed("relabelled", "y").cache()
    mixed = each.groupBy("decile").agg(F.count_distinct("y").alias("n")).where("n = 2").select("decile")
    splits = kfold_splits(each.join(F.broadcast(mixed), "decile", "left_semi"), k, "decile").withColumn("fold", (F.col("decile") * k + F.col("fold")).cast("int"))
    out = run_splits(splits, features, **how)[0].withColumn("decile", F.floor(F.col("fold") / k))
    return out.groupBy("decile", "measure").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))


def ablation_compare(rows: DataFrame, models: dict[str, list[str]], *, k: int = 5, **how) -> DataFrame:
    """model, measure, mean of cross-validations on several feature lists."""
    out = None
    for name, features in models.items():
        m = cv_job(rows, features, k=k, **how)[0].groupBy("measure").agg(F.avg("value").alias("mean")).withColumn("model", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out


def logit(rows: DataFrame, sets: list[list[str]]) -> DataFrame:
    """feature, coefficient, p_value of a binomial regression on each set of features; rows with a missing feature of a set are left out.
    A constant feature is skipped."""
    out = []
    for features in sets:
        fits = fit_splits(rows.select(F.lit(0).alias("fold"), F.lit(False).alias("is_test"), "y", *features).na.drop(subset=features), features, steps=LOGIT_STEPS, ridge=0.0)
        out += [x for fit in fits.values() for j, x in enumerate(coefficients(fit, features)) if fit.scale[j]]
    return rows.sparkSession.createDataFrame(out, "feature string, coefficient double, p_value double")


def univariate_logit(rows: DataFrame, features: list[str]) -> DataFrame:
    """One regression for each feature; a constant one is skipped."""
    return logit(rows, [[f] for f in features])


def multivariate_logit(rows: DataFrame, features: list[str], *, level: float = 0.01) -> DataFrame:
    return logit(rows, [features]).where(F.col("p_value") < level)
