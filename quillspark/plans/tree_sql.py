"""SQL of the tree ensembles in operators/trees.py: boosting as a recursive query of one level a step, forests level by level."""

from __future__ import annotations

import math

from ..operators.trees import BINS, DRAWS, M31, ONE


def number(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def binned(d: int) -> str:
    """bz (fold, id, y, is_test, b: bins) from splits (fold, id, y, x, is_test)."""
    ends = ", ".join(f"asinh(min(x[{j}])) AS l{j}, asinh(max(x[{j}])) AS u{j}" for j in range(1, d + 1))
    means = ", ".join(f"avg(x[{j}]) AS m{j}" for j in range(1, d + 1))
    bins = ", ".join(f"CASE WHEN u{j} > l{j} THEN CAST(greatest(0, least({BINS - 1}, floor((asinh(coalesce(x[{j}], m{j}, 0)) - l{j}) / (u{j} - l{j}) * {BINS}))) AS BIGINT) ELSE 0 END" for j in range(1, d + 1))
    return f"""ends AS MATERIALIZED (SELECT {ends} FROM splits), means AS MATERIALIZED (SELECT fold, {means} FROM splits WHERE NOT is_test GROUP BY fold),
bz AS MATERIALIZED (SELECT fold, id, y, is_test, [{bins}] AS b FROM splits JOIN means USING (fold), ends)"""


def scored() -> str:
    """tr and te from sp."""
    return "tr AS (FROM sp WHERE NOT is_test), te AS (FROM sp WHERE is_test)"


def boosted(d: int, trees: int, depth: int = 3, rate: float = 0.1, ridge: float = 1.0) -> str:
    """CTEs (WITH RECURSIVE) from splits to sp (fold, id, y, is_test, p), tr and te."""
    part = lambda g, h: f"CAST({g} AS DOUBLE) * CAST({g} AS DOUBLE) / (CAST({h} AS DOUBLE) + {number(ridge * ONE)})"
    value = lambda g, h: f"CAST(round({number(rate * ONE)} * (CAST({g} AS DOUBLE) / (CAST({h} AS DOUBLE) + {number(ridge * ONE)}))) AS BIGINT)"
    return f"""{binned(d)},
bs AS (SELECT 0 AS step, fold, id, y, is_test, b, CAST(0 AS BIGINT) AS f, CAST(1 AS BIGINT) AS node, CAST(0 AS BIGINT) AS v FROM bz UNION ALL (
 WITH gr AS (SELECT *, CAST(round((y - p) * {ONE}) AS BIGINT) AS g, CAST(round(p * (1 - p) * {ONE}) AS BIGINT) AS h FROM (SELECT *, 1 / (1 + exp(-(f / {ONE}.0::DOUBLE))) AS p FROM bs WHERE step < {trees * depth} AND NOT is_test AND node >= 1 << (step % {depth}))),
 ce AS (SELECT fold, node, j, b[j] AS bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM gr, range(1, {d + 1}) t(j) GROUP BY ALL),
 cu AS (SELECT *, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl, sum(g) OVER z AS ga, sum(h) OVER z AS ha, sum(n) OVER z AS na FROM ce WINDOW w AS (PARTITION BY fold, node, j ORDER BY bin), z AS (PARTITION BY fold, node, j)),
 ga AS (SELECT *, {part('gl', 'hl')} + {part('ga - gl', 'ha - hl')} - {part('ga', 'ha')} AS gain FROM cu WHERE nl < na),
 be AS (SELECT *, {value('gl', 'hl')} AS vl, {value('ga - gl', 'ha - hl')} AS vr FROM (SELECT *, row_number() OVER (PARTITION BY fold, node ORDER BY gain DESC, j, bin) AS rn FROM ga) WHERE rn = 1 AND gain > 1e-9),
 rt AS (SELECT fold, node, {value('sum(g)', 'sum(h)')} AS v0 FROM gr WHERE node = 1 GROUP BY ALL),
 mv AS (SELECT r.step, r.fold, r.id, r.y, r.is_test, r.b, r.f, CASE WHEN be.j IS NULL THEN r.node ELSE 2 * r.node + CAST(r.b[be.j] > be.bin AS BIGINT) END AS node,
   CASE WHEN be.j IS NULL THEN CASE WHEN r.step % {depth} = 0 THEN rt.v0 ELSE r.v END WHEN r.b[be.j] > be.bin THEN be.vr ELSE be.vl END AS v
   FROM bs r LEFT JOIN be ON be.fold = r.fold AND be.node = r.node LEFT JOIN rt ON rt.fold = r.fold AND rt.node = r.node WHERE r.step < {trees * depth})
 SELECT step + 1, fold, id, y, is_test, b, CASE WHEN step % {depth} = {depth - 1} THEN f + v ELSE f END, CASE WHEN step % {depth} = {depth - 1} THEN 1 ELSE node END, CASE WHEN step % {depth} = {depth - 1} THEN 0 ELSE v END FROM mv)),
sp AS MATERIALIZED (SELECT fold, id, CAST(y AS BIGINT) AS y, is_test, round(1 / (1 + exp(-(f / {ONE}.0::DOUBLE))), 6) AS p FROM bs WHERE step = {trees * depth}), {scored()}"""


def forest(d: int, trees: int, depth: int = 5) -> str:
    """CTEs from splits to sp, tr and te, and gn (fold, j, gain) of all nodes."""
    x = f"((id % {M31}) * 48271 + tree * 69621 + 12345) % {M31}"
    mixed = lambda x: f"(({x}) * ({x}) + (tree + 1) * 16807 + id % 8191) % {M31}"
    drawn = " + ".join(f"CAST(u >= {number(p)} AS BIGINT)" for p in DRAWS)
    part = lambda g, h: f"CAST({g} AS DOUBLE) * CAST({g} AS DOUBLE) / CAST({h} AS DOUBLE)"
    parts = [
        binned(d),
        f"al AS MATERIALIZED (SELECT tree, node, j FROM (SELECT tree, node, j, row_number() OVER (PARTITION BY tree, node ORDER BY md5(tree || '|' || node || '|' || (j - 1))) AS rn FROM range({trees}) a(tree), range(1, {1 << depth}) b(node), range(1, {d + 1}) c(j)) WHERE rn <= {math.ceil(math.sqrt(d))})",
        f"x0 AS (SELECT *, {x} AS x FROM bz, range({trees}) t(tree)), x1 AS (SELECT * EXCLUDE (x), {mixed('x')} AS x FROM x0), x2 AS (SELECT * EXCLUDE (x), {mixed('x')} AS x FROM x1)",
        f"n0 AS MATERIALIZED (SELECT fold, tree, id, y, is_test, b, w, CAST(1 AS BIGINT) AS node, sum(CASE WHEN NOT is_test THEN w * y END) OVER q / CAST(sum(CASE WHEN NOT is_test THEN w END) OVER q AS DOUBLE) AS v FROM (SELECT *, {drawn} AS w FROM (SELECT *, x / CAST({M31} AS DOUBLE) AS u FROM x2)) WINDOW q AS (PARTITION BY fold, tree))",
    ]
    for k in range(depth):
        parts.append(f"""ce{k} AS (SELECT fold, n.tree, n.node, j, b[j] AS bin, sum(w * y) AS g, sum(w) AS h FROM n{k} n JOIN al ON al.tree = n.tree AND al.node = n.node WHERE NOT is_test AND w > 0 AND n.node >= {1 << k} GROUP BY ALL),
cu{k} AS (SELECT *, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER z AS ga, sum(h) OVER z AS ha FROM ce{k} WINDOW w AS (PARTITION BY fold, tree, node, j ORDER BY bin), z AS (PARTITION BY fold, tree, node, j)),
ga{k} AS (SELECT *, {part('gl', 'hl')} + {part('(ga - gl)', '(ha - hl)')} - {part('ga', 'ha')} AS gain FROM cu{k} WHERE hl < ha),
be{k} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold, tree, node ORDER BY gain DESC, j, bin) AS rn FROM ga{k}) WHERE rn = 1 AND gain > 1e-9),
n{k + 1} AS MATERIALIZED (SELECT n.fold, n.tree, id, y, is_test, b, w, CASE WHEN e.j IS NULL THEN n.node ELSE 2 * n.node + CAST(b[e.j] > e.bin AS BIGINT) END AS node,
 CASE WHEN e.j IS NULL THEN v WHEN b[e.j] > e.bin THEN (ga - gl) / CAST(ha - hl AS DOUBLE) ELSE gl / CAST(hl AS DOUBLE) END AS v FROM n{k} n LEFT JOIN be{k} e ON e.fold = n.fold AND e.tree = n.tree AND e.node = n.node)""")
    parts.append(f"sp AS MATERIALIZED (SELECT fold, id, CAST(y AS BIGINT) AS y, is_test, round(sum(v) / {trees}, 6) AS p FROM n{depth} GROUP BY ALL), {scored()}")
    parts.append("gn AS (" + " UNION ALL ".join(f"SELECT fold, j, gain FROM be{k}" for k in range(depth)) + ")")
    return ",\n".join(parts)
