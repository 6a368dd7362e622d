"""Views that bring the test tables into the shapes that the operators read, in Spark and, as text, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import DAY, seconds

ORIGIN = 788_918_400  # 1995-01-01 UTC


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def edits(spark: SparkSession, sf: str) -> DataFrame:
    """Revisions with users and content hashes, from events."""
    e = read(spark, sf, "events")
    return e.select(
        F.get_json_object("props", "$.k").cast("long").alias("page_id"), F.col("event_id").alias("rev_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") != "error", F.col("user_id")).alias("user_id"),
        F.md5(F.concat("event_type", F.floor("value").cast("string")).cast("binary")).alias("sha1"),
    )


EDITS = """edits AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS page_id, event_id AS rev_id, ts,
 CASE WHEN event_type <> 'error' THEN user_id END AS user_id, md5(event_type || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)) AS sha1 FROM events)"""


def revisions(spark: SparkSession, sf: str) -> DataFrame:
    """Revisions with quality levels, from lineitem and orders."""
    j = read(spark, sf, "lineitem").join(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    phase = F.pmod(F.floor((seconds("l_shipdate") - ORIGIN) / DAY) + 37 * F.col("l_suppkey"), F.lit(1500))
    return j.select(
        F.col("l_suppkey").alias("page_id"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("rev_id"),
        F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("o_custkey").alias("user_id"),
        F.when(phase < 400, None).when(phase < 800, "ga").when(phase < 1200, "fa").alias("level"),
    )


def revisions_by_page(spark: SparkSession, sf: str) -> DataFrame:
    """The revisions for jobs that read them several times: joined, dealt out by page and ordered once, and kept."""
    return revisions(spark, sf).repartition("page_id").sortWithinPartitions("page_id", "ts", "rev_id").persist()


REVISIONS = f"""ph AS (SELECT *, (CAST(floor((epoch(l_shipdate) - {ORIGIN}) / 86400) AS BIGINT) + 37 * l_suppkey) % 1500 AS phase FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
revisions AS (SELECT l_suppkey AS page_id, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS rev_id, l_shipdate AS ts, o_custkey AS user_id,
 CASE WHEN phase < 400 THEN NULL WHEN phase < 800 THEN 'ga' WHEN phase < 1200 THEN 'fa' END AS level FROM ph)"""


def talk_dates(spark: SparkSession, sf: str) -> DataFrame:
    """A second source of dates: those of the revisions, shifted by -45 to 44 days; every seventh page has none."""
    from ..operators.lifecycle import dump_timeline

    t = dump_timeline(revisions(spark, sf)).where("page_id % 7 <> 0")
    shift = F.make_dt_interval((F.col("page_id") % 90 - 45).cast("int"))
    return t.select("page_id", *((F.col(f"{u}_{e}") + shift).alias(f"talkpage_{u}_{e}") for u in ("fa", "ga") for e in ("promotion", "demotion")))


def lists(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey") % 10
    return read(spark, sf, "supplier").where(k < 2).select(F.col("s_suppkey").alias("page_id"), F.when(k == 0, "former_fa").otherwise("current_ga").alias("type"))


LISTS = "lists AS (SELECT s_suppkey AS page_id, CASE WHEN s_suppkey % 10 = 0 THEN 'former_fa' ELSE 'current_ga' END AS type FROM supplier WHERE s_suppkey % 10 < 2)"


def comments(spark: SparkSession, sf: str) -> DataFrame:
    """Comments of threads, from conversations; scores are arithmetic of the text's length."""
    from pyspark.sql import Window

    c = read(spark, sf, "conversations").withColumn("author", F.concat("role", F.lit("_"), ((F.col("conv_id") * 7 + F.col("turn") * 3) % 11).cast("string")))
    w, n = Window.partitionBy("conv_id").orderBy("turn"), F.coalesce(F.length("text"), F.lit(0))
    name = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    start = F.lit(1_704_067_200) + F.col("conv_id") * 3600
    return c.select(
        (F.col("conv_id") % 20).alias("page_id"), F.col("conv_id").alias("thread"), F.col("turn").alias("pos"), name(F.col("turn")).alias("comment_id"),
        F.when(F.col("turn") > 0, name(F.lit(0))).alias("root_id"), "author", F.lag("author").over(w).alias("refers_to"), F.when(F.col("turn") > 0, F.first("author").over(w)).alias("root_author"),
        F.least(F.col("turn"), F.lit(2)).alias("depth"), F.timestamp_seconds(start + F.col("turn") * 420).alias("time"), F.timestamp_seconds(start).alias("thread_time"), "text",
        ((n % 101) / 100).alias("sentiment"), ((n % 53) / 52).alias("formality"), (1 + (n % 41) / 10).alias("politeness"), ((n % 67) / 100).alias("toxicity"), (1 + (n % 17) / 4).alias("certainty"),
    )


COMMENTS = """c0 AS (SELECT *, role || '_' || CAST((conv_id * 7 + turn * 3) % 11 AS VARCHAR) AS author, coalesce(length(text), 0) AS n FROM conversations),
comments AS (SELECT conv_id % 20 AS page_id, conv_id AS thread, turn AS pos, conv_id || '_' || turn AS comment_id, CASE WHEN turn > 0 THEN conv_id || '_0' END AS root_id, author,
 lag(author) OVER w AS refers_to, CASE WHEN turn > 0 THEN first_value(author) OVER w END AS root_author, least(turn, 2) AS depth,
 1704067200 + conv_id * 3600 + turn * 420 AS time, 1704067200 + conv_id * 3600 AS thread_time, text,
 (n % 101) / 100 AS sentiment, (n % 53) / 52 AS formality, 1 + (n % 41) / 10 AS politeness, (n % 67) / 100 AS toxicity, 1 + (n % 17) / 4 AS certainty
 FROM c0 WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


def wikitext(spark: SparkSession, sf: str) -> DataFrame:
    """Talk pages: a template, chosen by the id, before each document's text."""
    d, k = read(spark, sf, "documents"), F.col("doc_id") % 4
    day = (1 + F.col("doc_id") % 28).cast("string")
    a = F.concat(F.lit("{{ArticleHistory|action1=GAN|action1date=15:34, "), day, F.lit(" March 2011|action1result=listed|action2=GAR|action2date=2012-01-02|action2result=delisted|currentstatus=DGA}}"))
    b = F.concat(F.lit("{{GA|14 January 2008|topic="), "source", F.lit("}}"))
    c = F.concat(F.lit("{{Article history|action1=FAC|action1date=Sept "), day, F.lit(", 2006|action1result=promoted}} {{WikiProject "), "lang", F.lit("|importance=Top}}"))
    return d.select(F.col("doc_id").alias("page_id"), F.concat(F.when(k == 0, a).when(k == 1, b).when(k == 2, c).otherwise(""), F.lit(" "), F.coalesce("text", F.lit(""))).alias("content"))


#: kind, accepted result and outcome of the actions of wikitext_grammar
GRAMMAR = (("GAN", "Listed", "ga_promotion"), ("fac", "promoted", "fa_promotion"), ("Gar", "delisted", "ga_demotion"), ("FAR", "Demoted", "fa_demotion"))


def wikitext_grammar(spark: SparkSession, sf: str) -> DataFrame:
    """Talk pages as they are written: up to 12 actions over several lines, links and templates as values, three forms of dates,
    missing results, a repeated key, a history inside another template or behind open braces, and a second history."""
    k = F.col("doc_id")

    def action(i):
        j = k + i
        of = lambda at: F.element_at(F.array(*(F.lit(g[at]) for g in GRAMMAR)), (j % 4 + 1).cast("int"))
        key, day, year = F.concat(F.lit("\n|action"), i.cast("string")), (1 + j % 28).cast("string"), (2001 + j % 19).cast("string")
        date = F.when(j % 3 == 0, F.concat(year, F.lit("-05-"), F.lpad(day, 2, "0"))).when(j % 3 == 1, F.concat(day, F.lit(" May "), year)).otherwise(F.concat(F.lit("May "), day, F.lit(", "), year))
        link = F.when(j % 2 == 0, F.concat(F.lit("{{Oldid|"), k.cast("string"), F.lit("}}"))).otherwise(F.lit("[[Talk:Page/GA1|Review]]"))
        again = F.when((k % 7 == 0) & (i == 1), F.concat(key, F.lit("result=failed"))).otherwise("")
        result = F.when(j % 5 == 0, "").otherwise(F.concat(again, key, F.lit("result = "), of(1)))
        return F.concat(key, F.lit(" = "), of(0), key, F.lit("date="), date, key, F.lit("link= "), link, result)

    name = F.when(k % 2 == 0, F.lit("{{ArticleHistory")).otherwise(F.lit("{{article history"))
    status = F.when(k % 2 == 0, F.lit("\n| currentstatus = FFA")).otherwise("")
    listed = F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), 1 + k % 12), action), "")
    before = F.when(k % 3 == 0, F.lit("{{stub ")).when(k % 3 == 1, F.lit("{{Talk header|1=\n")).otherwise(F.lit("}} | ]] "))
    after = F.concat(F.when(k % 3 == 1, F.lit("}}")).otherwise(""), F.lit(" {{ArticleHistory|action1=FAC|action1date=1 May 1999|action1result=promoted}} "))
    page = F.concat(before, name, listed, status, F.lit("\n}}"), after, F.coalesce("text", F.lit("")))
    return read(spark, sf, "documents").select(k.alias("page_id"), page.alias("content"))


def topics(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") % 5
    imp = F.when(k == 0, "low").when(k == 1, "mid").when(k == 2, "high").when(k == 3, "top")
    return read(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), F.lit(0).alias("pos"), F.col("source").alias("project_name"), imp.alias("importance"))


TOPICS = "topics AS (SELECT doc_id AS page_id, source AS project_name, CASE doc_id % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'mid' WHEN 2 THEN 'high' WHEN 3 THEN 'top' END AS importance FROM documents)"


def preds(spark: SparkSession, sf: str) -> DataFrame:
    """Scored rows with ties."""
    p = F.floor(((F.col("doc_id") * 7919) % 1000 * 6 + F.col("quality") * 3000) / 100) / 100
    return read(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"), p.alias("p"))


PREDS = "preds AS (SELECT doc_id AS id, quality AS y, floor(((doc_id * 7919) % 1000 * 6 + quality * 3000) / 100) / 100 AS p FROM labels)"


def model(spark: SparkSession, sf: str) -> DataFrame:
    """A modeling table: label, year, days in promotion (null for every third), features of the text."""
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id")
    return d.select(
        F.col("doc_id").alias("id"), F.col("quality").alias("y"), (2004 + F.col("doc_id") % 16).cast("int").alias("year"),
        F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") * 37) % 900).alias("days"), F.col("n_chars").cast("double").alias("EDIT_chars"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("double").alias("EDIT_lines"),
        (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).cast("double").alias("COMPOSITION_words"), ((F.col("doc_id") * 31) % 97).cast("double").alias("NETWORK_hash"),
    )


MODEL = """model AS (SELECT doc_id AS id, quality AS y, CAST(2004 + doc_id % 16 AS INTEGER) AS year, CASE WHEN doc_id % 3 <> 0 THEN (doc_id * 37) % 900 END AS days,
 CAST(n_chars AS DOUBLE) AS EDIT_chars, CAST(length(text) - length(replace(text, chr(10), '')) AS DOUBLE) AS EDIT_lines,
 CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS COMPOSITION_words, CAST((doc_id * 31) % 97 AS DOUBLE) AS NETWORK_hash FROM documents JOIN labels USING (doc_id))"""
