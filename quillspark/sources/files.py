"""Sources and sinks: compressed JSON lines, CSV, many paths, fallbacks, incremental runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

REVISION = "id long, timestamp string, user struct<id:long>, text string, sha1 string, assessment_found string"


def scan_jsonl_bz2(spark: SparkSession, path: str | list[str], schema: str | T.StructType = REVISION) -> DataFrame:
    """JSON lines, bzip2 or plain; page_id is the number that the file name begins with (null if none)."""
    df = spark.read.schema(schema).json(path)
    return df.withColumn("page_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.", 1).try_cast("long"))


def sink_jsonl_bz2(df: DataFrame, path: str, *, by: str | None = None) -> None:
    w = df.write.option("compression", "bzip2")
    (w.partitionBy(by) if by else w).json(path)


def scan_csv(spark: SparkSession, path: str | list[str], schema: str, *, key: str = "page_id") -> DataFrame:
    """CSV with a header whose first column is the key, whatever its title."""
    df = spark.read.schema(schema).csv(path, header=True, enforceSchema=True)
    return df.withColumnRenamed(df.columns[0], key)


def sink_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def scan_multi(spark: SparkSession, paths: list[str], *, kind: str = "parquet") -> DataFrame:
    """Union of several tables by column names; missing columns are null."""
    out = None
    for p in paths:
        df = spark.read.format(kind).load(p)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def source_fallback(wanted: DataFrame, sources: list[DataFrame], key: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """(for every key the rows of the first source that has it, with its number in `source`; keys that none has)."""
    tagged = None
    for i, s in enumerate(sources):
        t = s.withColumn("source", F.lit(i))
        tagged = t if tagged is None else tagged.unionByName(t)
    best = F.min("source").over(Window.partitionBy(key))
    found = tagged.join(wanted.select(key).distinct(), key, "left_semi").withColumn("__best", best).where(F.col("source") == F.col("__best")).drop("__best")
    return found, wanted.join(tagged.select(key), key, "left_anti")


def skip_processed(rows: DataFrame, done: DataFrame, key: str = "page_id") -> DataFrame:
    return rows.join(done.select(key), key, "left_anti")


def project_revisions(raw: DataFrame, badges: dict[str, str] | None = None) -> DataFrame:
    """Scanned revisions in the library's shape: registered user or null, text length (0 without text), level by badge."""
    badges = badges or {"{{good article}}": "ga", "{{featured article}}": "fa"}
    level = F.lit(None).cast("string")
    for badge, name in badges.items():
        level = F.when(F.col("assessment_found") == badge, name).otherwise(level)
    return raw.select("page_id", F.col("id").alias("rev_id"), F.to_timestamp("timestamp").alias("ts"), F.col("user.id").alias("user_id"), F.coalesce(F.length("text"), F.lit(0)).alias("text_len"), "sha1", level.alias("level"))
