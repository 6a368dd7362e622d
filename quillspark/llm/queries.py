"""The registered queries of the corpus operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chosen, remainder, table

KEY = "quillspark"  # where the session's configuration has no key; a user sets a secret one
Query = Callable[[SparkSession, str], DataFrame]


def bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pii_key(spark: SparkSession) -> str:
    """The secret key of surrogates: spark.quillspark.pii.key."""
    return spark.conf.get("spark.quillspark.pii.key", KEY)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), bpe_path())


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality, train

    docs = table(spark, sf_dir, "documents")
    scored = score_quality(chosen(docs, "doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import predict_languages, profiles

    docs = table(spark, sf_dir, "documents")
    learned = profiles(docs.where(remainder("doc_id", 5) != 0))
    found = predict_languages(chosen(docs, "doc_id", "text"), learned)
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymise_checked

    found = pseudonymise_checked(chosen(table(spark, sf_dir, "documents"), "doc_id", "text"), pii_key(spark))
    return found.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), "entities")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import train

    docs = table(spark, sf_dir, "documents")
    scored = train(docs, table(spark, sf_dir, "labels")).score(chosen(docs, "doc_id", "text"))
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import digests, find_contamination

    return digests(find_contamination(chosen(table(spark, sf_dir, "documents"), "doc_id", "text"), table(spark, sf_dir, "benchmark")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import digests, pack_documents

    return digests(pack_documents(table(spark, sf_dir, "documents"), bpe_path()))


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .katz import score_texts

    return score_texts(table(spark, sf_dir, "documents"), remainder("doc_id", 10) == 0)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix, shared_targets

    mixed = mix(table(spark, sf_dir, "documents"), lambda sizes: shared_targets(sizes, (3, 1, 2), Fraction(3, 2), 2))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "rate")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import importance_resample

    drawn = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audit import audit_filters

    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_quality": op2_quality,
    "op3_fingerprints": op3_fingerprints,
    "op4_language": op4_language,
    "op5_simhash": op5_simhash,
    "op6_pii": op6_pii,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_decontamination": op9_decontamination,
    "op10_katz": op10_katz,
    "op11_mixing": op11_mixing,
    "op12_resampling": op12_resampling,
    "op13_filter_audit": op13_filter_audit,
}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

ORACLE: dict[str, str] = {
    "op9_decontamination": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i
             FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw USING (n, s)),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM m) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
      FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS k FROM m WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)""",
    "op13_filter_audit": """
WITH x AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM x),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
         100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text),
         regexp_matches(text, '[#$%&*|]'), doc_id IS DISTINCT FROM first] AS fails
      FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
p AS (SELECT [a, b, c, d, e] AS o FROM range(1, 6) t1(a), range(1, 6) t2(b), range(1, 6) t3(c), range(1, 6) t4(d), range(1, 6) t5(e)
      WHERE len(list_distinct([a, b, c, d, e])) = 5),
s AS (SELECT array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order, o, k FROM p, range(1, 6) t(k)),
m AS (SELECT part, filter_order, k, o[k] AS x, n, good, toxic, fails[o[k]] AS bad, list_contains([fails[i] FOR i IN o[1:k - 1]], true) AS gone,
        len(list_filter(fails, lambda b: b)) AS bads FROM c, s),
r AS (SELECT part, filter_order, k AS step, x, sum(CASE WHEN NOT gone AND NOT bad THEN n ELSE 0 END) AS kept, sum(CASE WHEN bad AND NOT gone THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN bad AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN bad AND bads = 1 THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN bad AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN bad AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
      FROM m GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM r""",
}
