"""SQL of the regressions in operators/logit.py: the same steps, written out by a rule."""

from __future__ import annotations

from ..operators.logit import FIRM


def solved(source: str, name: str, n: int, right: int) -> str:
    """CTEs that reduce a<j>_<k> (n rows, n + right columns) of `source` to the identity; the last is `name`."""
    ctes, columns = [], [f"a{j}_{k}" for j in range(n) for k in range(n + right)]
    for i in range(n):
        row = lambda k, i=i: f"a{i}_{k} / a{i}_{i}"
        cells = [f"{row(k)} AS a{j}_{k}" if j == i else f"a{j}_{k} - a{j}_{i} * ({row(k)}) AS a{j}_{k}" for j in range(n) for k in range(n + right)]
        assert len(cells) == len(columns)
        ctes.append(f"{name if i == n - 1 else f'{name}_{i}'} AS (SELECT fold, {', '.join(cells)} FROM {source if i == 0 else f'{name}_{i - 1}'})")
    return ",\n".join(ctes)


def newton(d: int, steps: int, ridge: float, source: str = "splits") -> str:
    """CTEs from splits (fold, id, y, x: d numbers or nulls, is_test): zz with the scaled features z0 .. zd, b<steps> with the
    weights b0 .. bd, and h<steps>, the information matrix of the last step."""
    n = d + 1
    parts = [f"sc AS MATERIALIZED (SELECT fold, {', '.join(f'avg(x[{j}]) AS m{j}, stddev_pop(x[{j}]) AS s{j}' for j in range(1, n))} FROM {source} WHERE NOT is_test GROUP BY fold)"]
    parts.append(f"zz AS MATERIALIZED (SELECT fold, id, CAST(y AS DOUBLE) AS y, is_test, 1.0::DOUBLE AS z0, {', '.join(f'coalesce((x[{j}] - m{j}) / nullif(s{j}, 0), 0) AS z{j}' for j in range(1, n))} FROM {source} JOIN sc USING (fold))")
    parts.append(f"b0 AS (SELECT fold, {', '.join(f'0.0::DOUBLE AS b{j}' for j in range(n))} FROM sc)")
    margin = " + ".join(f"z{j} * b{j}" for j in range(n))
    for i in range(1, steps + 1):
        sums = [f"sum(w * z{j} * z{k}) AS h{j}_{k}" for j in range(n) for k in range(j + 1)] + [f"sum((y - p) * z{j}) AS g{j}" for j in range(n)]
        parts.append(f"h{i} AS MATERIALIZED (SELECT fold, {', '.join(sums)} FROM (SELECT *, p * (1 - p) AS w FROM (SELECT zz.*, 1 / (1 + exp(-({margin}))) AS p FROM zz JOIN b{i - 1} USING (fold) WHERE NOT is_test)) GROUP BY fold)")
        cells = [f"h{max(j, k)}_{min(j, k)}{f' + {(ridge if j else 0) + FIRM}' if j == k else ''} AS a{j}_{k}" for j in range(n) for k in range(n)]
        cells += [f"g{j} - {ridge if j else 0} * b{j} AS a{j}_{n}" for j in range(n)]
        parts.append(f"q{i} AS (SELECT fold, {', '.join(cells)} FROM h{i} JOIN b{i - 1} USING (fold))")
        parts.append(solved(f"q{i}", f"r{i}", n, 1))
        parts.append(f"b{i} AS MATERIALIZED (SELECT fold, {', '.join(f'b{j} + a{j}_{n} AS b{j}' for j in range(n))} FROM r{i} JOIN b{i - 1} USING (fold))")
    return ",\n".join(parts)


def predicted(d: int, steps: int, ridge: float) -> str:
    """newton, then tr and te: training and test rows (fold, id, y, p), p to 6 digits."""
    margin = " + ".join(f"z{j} * b{j}" for j in range(d + 1))
    return f"""{newton(d, steps, ridge)},
sp AS MATERIALIZED (SELECT fold, id, CAST(y AS BIGINT) AS y, is_test, round(1 / (1 + exp(-({margin}))), 6) AS p FROM zz JOIN b{steps} USING (fold)),
tr AS (FROM sp WHERE NOT is_test), te AS (FROM sp WHERE is_test)"""


def tail(u: str) -> str:
    """erfc(u), u at least 0: its Taylor series below 2, its continued fraction above."""
    deep = u
    for k in range(80, 0, -1):
        deep = f"({u} + {k / 2} / {deep})" if k < 80 else f"({u} + {k / 2} / {u})"
    near = f"1 - 2 / sqrt(pi()) * (SELECT sum((CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * {u} * exp(k * ln(nullif({u} * {u}, 0)) - lgamma(k + 1)) / (2 * k + 1)) FROM range(60) t(k))"
    return f"CASE WHEN {u} = 0 THEN 1 WHEN {u} < 2 THEN {near} ELSE exp(-{u} * {u}) / sqrt(pi()) / {deep} END"


def coefficients(d: int, steps: int, names: list[str]) -> str:
    """A select of feature, coefficient, p_value for each fold, after newton(.., ridge=0)."""
    n = d + 1
    cells = [f"h{max(j, k)}_{min(j, k)}{f' + {FIRM}' if j == k else ''} AS a{j}_{k}" for j in range(n) for k in range(n)] + [f"{1 if j == k else 0}.0::DOUBLE AS a{j}_{n + k}" for j in range(n) for k in range(n)]
    rows = " UNION ALL ".join(f"SELECT fold, '{f}' AS feature, b{j} / nullif(s{j}, 0) AS coefficient, abs(b{j}) / sqrt(a{j}_{n + j}) / sqrt(2) AS u FROM b{steps} JOIN inv USING (fold) JOIN sc USING (fold)" for j, f in enumerate(names, 1))
    return f"qi AS (SELECT fold, {', '.join(cells)} FROM h{steps}), {solved('qi', 'inv', n, n)}, cu AS MATERIALIZED ({rows}), pv AS (SELECT fold, feature, coalesce(coefficient, 0) AS coefficient, {tail('u')} AS p_value FROM cu)"
