"""Ranks by ranges and exact quantiles against sorted lists."""

import random

import numpy as np
import pytest

from quillspark.functions import ranks
from quillspark.operators import reports


@pytest.mark.parametrize("values", [[], [5.0], [2.0] * 50, [float(i % 7) for i in range(200)], [random.Random(1).gauss(0, 100) for _ in range(500)], [-1e9, 0.0, 1e-9, 1e9, None, None]])
def test_quantiles(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    known = sorted(v for v in values if v is not None)
    shares = [0, 0.1, 0.25, 1 / 3, 0.5, 0.9, 1]
    want = np.quantile(known, shares).tolist() if known else []
    assert ranks.exact_quantiles(df, "v", shares) == pytest.approx(want)


def test_running_counts(spark):
    rng = random.Random(2)
    values = [rng.choice([1, 1, 1, 2, 3, rng.randint(-50, 50)]) for _ in range(300)]
    per = spark.createDataFrame([(v, values.count(v)) for v in set(values)], "v long, n long")
    for r in ranks.running_counts(per, "v", "n", ranges=8).collect():
        assert r.before == sum(x < r.v for x in values)


def test_spearman_has_no_unpartitioned_window(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 30), rng.choice([None, *range(9)])) for _ in range(200)]
    df = spark.createDataFrame(rows, "a long, b long")
    out = reports.spearman(df, "a", "b")
    known = [r for r in rows if r[1] is not None]
    place = lambda k: [sum(y[k] < x[k] for y in known) + (sum(y[k] == x[k] for y in known) + 1) / 2 for x in known]
    assert out.first().spearman == pytest.approx(np.corrcoef(place(0), place(1))[0, 1])
    assert "SinglePartition" not in out._jdf.queryExecution().optimizedPlan().toString() and "windowspecdefinition(v" not in out._jdf.queryExecution().optimizedPlan().toString()
