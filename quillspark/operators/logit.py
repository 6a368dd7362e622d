"""Logistic regression of many splits at once.

Rows have fold, is_test, id, y (0 or 1) and feature columns; a row stands once in each split that it takes part in. A Newton step needs only sums over a split's
training rows: the gradient and the weighted cross products of the features. One grouped pass gives them for all splits,
with partial sums in each task, so 100 replicates cost as many passes as one. The sums (folds times (d + 1)(d + 4) / 2 numbers)
come to the driver, which solves a system of d + 1 unknowns for each split.

Features are centred and scaled by the mean and deviation of the split's training rows; missing values count as the mean, a
constant feature as 0. Slopes have an L2 penalty (`ridge`); the number of steps is fixed, so a fit is a function of its rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS, RIDGE, FIRM = 8, 1.0, 1e-6  # FIRM keeps the system of a split without one of the classes or without variance solvable


@dataclass
class Fit:
    """One split: centre and scale (0 for a constant feature), weights of the scaled features with the intercept first, and the
    information matrix at the last step."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    information: np.ndarray | None = None


def scaled(features: list[str]) -> list[Column]:
    """1 and the scaled features, of rows that have the columns centre and scale."""
    return [F.lit(1.0)] + [F.coalesce((F.col(f"`{f}`").cast("double") - F.get("centre", F.lit(j))) * F.get("scale", F.lit(j)), F.lit(0.0)) for j, f in enumerate(features)]


def state(rows: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    data = [(int(k), [*map(float, f.centre)], [*map(float, f.scale)], [*map(float, f.weights)]) for k, f in sorted(fits.items())]
    return rows.sparkSession.createDataFrame(data, "__fold int, centre array<double>, scale array<double>, weights array<double>")


def with_z(rows: DataFrame, features: list[str], fits: dict[int, Fit]) -> DataFrame:
    """rows with z, the scaled features, and p, the probability of class 1. Splits are few, their state is broadcast."""
    joined = rows.join(F.broadcast(state(rows, fits)), F.col("fold") == F.col("__fold"))
    joined = joined.withColumn("z", F.array(*scaled(features)))
    margin = sum((F.get("z", F.lit(j)) * F.get("weights", F.lit(j)) for j in range(len(features) + 1)), F.lit(0.0))
    return joined.withColumn("p", 1 / (1 + F.exp(-margin))).drop("centre", "scale", "weights", "__fold")


def fit_splits(splits: DataFrame, features: list[str], *, steps: int = STEPS, ridge: float = RIDGE) -> dict[int, Fit]:
    """A fit for each fold that has training rows."""
    train, d = splits.where("not is_test and y is not null"), len(features)
    per = train.groupBy("fold").agg(*(f(F.col(f"`{c}`").cast("double")).alias(f"{n}{j}") for j, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).collect()
    fits = {}
    for r in per:
        spread = [r[f"s{j}"] for j in range(d)]
        fits[r.fold] = Fit(np.array([r[f"m{j}"] or 0.0 for j in range(d)]), np.array([1 / s if s else 0.0 for s in spread]), np.zeros(d + 1))
    pairs = [(j, k) for j in range(d + 1) for k in range(j + 1)]
    for _ in range(steps if fits else 0):
        z = lambda j: F.get("z", F.lit(j))
        w = F.col("p") * (1 - F.col("p"))
        sums = [F.sum(w * z(j) * z(k)).alias(f"h{j}_{k}") for j, k in pairs] + [F.sum((F.col("y") - F.col("p")) * z(j)).alias(f"g{j}") for j in range(d + 1)]
        for r in with_z(train, features, fits).groupBy("fold").agg(*sums).collect():
            f, h = fits[r.fold], np.zeros((d + 1, d + 1))
            for j, k in pairs:
                h[j, k] = h[k, j] = r[f"h{j}_{k}"]
            penalty = np.append(0.0, np.full(d, ridge))
            f.information = h
            f.weights = f.weights + np.linalg.solve(h + np.diag(penalty + FIRM), np.array([r[f"g{j}"] for j in range(d + 1)]) - penalty * f.weights)
    return fits


def coefficients(fit: Fit, features: list[str]) -> list[tuple[str, float, float]]:
    """(feature, coefficient in the feature's own unit, two-sided p value of the normal tail) of a fit without penalty. The standard
    errors are those of the inverted information matrix; a feature that the others determine gets a p value near 1."""
    covariance = np.linalg.inv(fit.information + FIRM * np.eye(len(features) + 1))
    out = []
    for j, f in enumerate(features):
        z = fit.weights[j + 1] / math.sqrt(covariance[j + 1, j + 1])
        out.append((f, float(fit.weights[j + 1] * fit.scale[j]), math.erfc(abs(z) / math.sqrt(2))))
    return out
