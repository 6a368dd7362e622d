"""SQL of the text classifier in operators/text_classifier.py: the same steps, written out by a rule."""

from __future__ import annotations

import string

from ..operators.text_classifier import BLANKS, BUCKETS, DECAY, RATE, STEPS


def features(source: str, name: str, keys: str) -> str:
    """CTEs of `name` (keys, k, v) from `source` (keys, text): distinct buckets and the constant, k = -1."""
    low = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"""{name}_t AS MATERIALIZED (SELECT {keys}, list_filter(regexp_split_to_array({low}, '{BLANKS}'), lambda x: x <> '') AS t FROM {source}),
{name}_g AS MATERIALIZED (SELECT {keys}, list_distinct(list_transform(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])), lambda g: CAST('0x' || substr(md5(g), 1, 8) AS BIGINT) % {BUCKETS})) AS ks FROM {name}_t),
{name} AS MATERIALIZED (SELECT {keys}, unnest(ks) AS k, 1 / sqrt(len(ks)) AS v FROM {name}_g UNION ALL SELECT {keys}, -1, 1.0 FROM {name}_g)"""


def probabilities(source: str, weights: str, keys: str, name: str) -> str:
    """CTEs of `name` (keys, c, p) from features and weights (k, c, w)."""
    return f"""{name}_l AS (SELECT {keys}, c, sum(v * w) AS l FROM {source} JOIN {weights} USING (k) GROUP BY {keys}, c),
{name}_e AS (SELECT {keys}, c, exp(l - max(l) OVER (PARTITION BY {keys})) AS e FROM {name}_l),
{name} AS MATERIALIZED (SELECT {keys}, c, e / sum(e) OVER (PARTITION BY {keys}) AS p FROM {name}_e)"""


def fitted(source: str) -> str:
    """CTEs of the weights w<STEPS> (k, c, w) from `source` (id, y, text)."""
    parts = [features(source, "fx", "id, y"), "cl AS (SELECT DISTINCT y AS c FROM fx)", "nn AS (SELECT count(DISTINCT id) AS n FROM fx)"]
    parts.append(f"w0 AS MATERIALIZED (SELECT CAST(k AS BIGINT) AS k, c, 0.0::DOUBLE AS w FROM range(-1, {BUCKETS}) r(k), cl), v0 AS (FROM w0)")
    for i in range(STEPS):
        parts.append(probabilities("fx", f"v{i}", "id, y", f"p{i}"))
        parts.append(f"g{i} AS (SELECT k, c, sum(v * (CASE WHEN y = c THEN 1 ELSE 0 END - p)) AS g FROM fx JOIN p{i} USING (id, y) GROUP BY k, c)")
        parts.append(f"w{i + 1} AS MATERIALIZED (SELECT k, c, w + {RATE} * (coalesce(g, 0) / n - {DECAY} * w) AS w FROM v{i} LEFT JOIN g{i} USING (k, c), nn)")
        parts.append(f"v{i + 1} AS MATERIALIZED (SELECT k, c, a.w + {i} / {i + 3} * (a.w - b.w) AS w FROM w{i + 1} a JOIN w{i} b USING (k, c))")
    return ",\n".join(parts)
