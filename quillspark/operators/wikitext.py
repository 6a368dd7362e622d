"""Dates, events and topics from talk-page templates. Pages have page_id and content (null without a page).

A reader finds the templates of a page: braces are matched, nested templates too, and a template is cut at its own pipes (not
those of links or templates inside) into a name and arguments. Histories, badges, status and topics are all taken from
its result, an array of templates in order of their start.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.times import iso, parse_date

MARK = re.compile(r"\{\{|\}\}|\[\[|\]\]|\|")
ARG = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
TEMPLATES = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("args", T.ArrayType(ARG))]))
COLUMNS = 10_000  # topics that a table can have as columns
#: column, action, accepted results
OUTCOMES = (("fa_promotion", "fac", ("promoted",)), ("ga_promotion", "gan", ("listed", "passed")), ("fa_demotion", "far", ("demoted",)), ("ga_demotion", "gar", ("delisted",)))


def read_templates(text: str | None) -> list[dict]:
    """name and args (key, value) of every template of a text; an argument without `=` has its place as key, from 1."""
    found, open_ = [], []  # an open template: start, cuts, open links
    for m in MARK.finditer(text or ""):
        mark = m[0]
        if mark == "{{":
            open_.append([m.start(), [m.end()], 0])
        elif not open_:
            continue
        elif mark == "[[":
            open_[-1][2] += 1
        elif mark == "]]":
            open_[-1][2] = max(0, open_[-1][2] - 1)
        elif mark == "|":
            if not open_[-1][2]:
                open_[-1][1].append(m.end())
        else:
            start, cuts, _ = open_.pop()
            name, *parts = (text[a:b].strip() for a, b in zip(cuts, [c - 1 for c in cuts[1:]] + [m.start()], strict=True))
            args, place = [], 0
            for part in parts:
                key, sign, value = part.partition("=")
                if not sign:
                    place += 1
                args.append({"key": key.strip(), "value": value.strip()} if sign else {"key": str(place), "value": part})
            found.append((start, {"name": name, "args": args}))
    return [t for _, t in sorted(found, key=lambda x: x[0])]


@F.pandas_udf(TEMPLATES)
def templates(content: pd.Series) -> pd.Series:
    return content.map(read_templates)


def with_templates(pages: DataFrame) -> DataFrame:
    """pages with their templates, read once whatever is taken from them."""
    return pages if "templates" in pages.columns else pages.withColumn("templates", templates("content"))


def value_of(template: Column, key: str) -> Column:
    """The last argument of a key (lower-case); null if there is none."""
    found = F.filter(template["args"], lambda a: F.lower(a["key"]) == key)
    return F.when(F.size(found) > 0, F.element_at(found, -1)["value"])


def histories(found: Column) -> Column:
    """The templates whose name holds `history` and that list actions."""
    return F.filter(found, lambda t: F.contains(F.lower(t["name"]), F.lit("history")) & F.exists(t["args"], lambda a: F.lower(a["key"]).startswith("action1")))


def history_lines(found: Column) -> Column:
    """Lines of the first history, its name and each argument on its own."""
    h = F.get(histories(found), 0)
    return F.when(h.isNotNull(), F.concat(F.array(h["name"]), F.transform(h["args"], lambda a: F.concat(F.lit("|"), a["key"], F.lit("="), a["value"]))))


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, pos, key, value of each page's first history; of repeated keys the last value, at the first place."""
    e = with_templates(pages).select("page_id", F.posexplode(F.get(histories("templates"), 0)["args"]).alias("pos", "e"))
    return e.groupBy("page_id", F.col("e.key").alias("key")).agg(F.min("pos").alias("pos"), F.max_by("e.value", "pos").alias("value"))


def actions(pages: DataFrame, *, compat: bool = False) -> DataFrame:
    """One row for each action: page_id, n (number in the key), order, kind (value of its first key), and dates, results (arrays),
    date, link, result. compat: a run of keys belongs to the action whose key begins it, so action10 may join action1."""
    a = parsed(pages).where("key like 'action%'").withColumn("n", F.regexp_extract("key", r"^action(\d+)", 1).try_cast("int")).where("n is not null")
    suffix = F.regexp_replace("key", r"^action\d+", "")
    if compat:
        w = Window.partitionBy("page_id").orderBy("pos")
        first = F.col("n").cast("string")
        prior = F.lag(first).over(w)
        a = a.withColumn("n", F.when(first.startswith(prior) & F.coalesce(prior != first, F.lit(False)), F.lag("n").over(w)).otherwise(F.col("n")))
    value = lambda s: F.max(F.when(suffix == s, F.col("value")))
    listed = lambda word: F.sort_array(F.collect_list(F.when(F.contains("key", F.lit(word)), F.struct("pos", "value"))))["value"]
    return a.groupBy("page_id", "n").agg(
        F.min("pos").alias("order"), F.lower(F.min_by("value", "pos")).alias("kind"), listed("date").alias("dates"), listed("result").alias("results"),
        value("").alias("action"), value("date").alias("date"), value("link").alias("link"), value("result").alias("result"),
    )


def simple_badge(found: Column) -> Column:
    """(badge, date) of the first template ga or fa: its name and first argument, lower-case; null without arguments."""
    short = F.get(F.filter(found, lambda t: F.lower(t["name"]).isin("ga", "fa") & (F.size(t["args"]) > 0)), 0)
    first = F.get(short["args"], 0)
    written = F.when(first["key"] == "1", first["value"]).otherwise(F.concat(first["key"], F.lit("="), first["value"]))
    return F.when(short.isNotNull(), F.struct(F.lower(short["name"]).alias("badge"), F.lower(written).alias("date")))


def current_status(content: Column | str, *, compat: bool = False) -> Column:
    """What stands after the single `currentstatus=` of a text, lower-case, up to white space, `=`, a bar or a brace; null if there is
    none or several. compat: the published reading, in which a bar or a brace that follows stays."""
    c = F.col(content) if isinstance(content, str) else content
    parts = F.split(c, "currentstatus=", -1)
    return F.when(F.size(parts) == 2, F.lower(F.split(F.get(parts, 1), r"[\s=]" if compat else r"[\s=|{}]", 2)[0]))


def action_time(rows: DataFrame, kind: str, results: tuple[str, ...]) -> DataFrame:
    """page_id, time: the date of the first action of a kind with exactly one date and one accepted result."""
    ok = rows.where((F.col("kind") == kind) & (F.size("dates") == 1) & (F.size("results") == 1) & F.lower(F.get("results", 0)).isin(*results))
    return ok.groupBy("page_id").agg(F.regexp_replace(F.min_by(F.get("dates", 0), "order"), r"^[Dd]ate=", "").alias("time"))


def talk_promotion_dates(pages: DataFrame) -> DataFrame:
    """page_id, four dates, status and reached (false: neither a history nor a short badge). Pages without content have no row.
    Of several histories the first is read. One grouping by page gives all four dates and the status."""
    known = with_templates(pages.where("content is not null"))
    out = known.select("page_id", (F.size(histories("templates")) > 0).alias("has"), simple_badge(F.col("templates")).alias("b"), current_status("content", compat=True).alias("s"), F.lower(value_of(F.get(histories("templates"), 0), "currentstatus")).alias("listed"))
    rows = actions(known)
    first = lambda kind, results: F.min_by(F.get("dates", 0), F.when((F.col("kind") == kind) & (F.size("dates") == 1) & (F.size("results") == 1) & F.lower(F.get("results", 0)).isin(*results), F.col("order")))
    times = rows.groupBy("page_id").agg(*(F.regexp_replace(first(kind, results), r"^[Dd]ate=", "").alias(name) for name, kind, results in OUTCOMES))
    out = out.join(times, "page_id", "left")
    date = lambda name: F.coalesce(F.col(name), F.when(~F.col("has") & (F.col("b.badge") == name[:2]), F.col("b.date")) if name.endswith("promotion") else F.lit(None))
    status = F.when(F.col("has"), F.coalesce("listed", F.regexp_replace("s", r"[|}].*$", ""))).otherwise(F.col("b.badge"))
    return out.select("page_id", *(parse_date(date(n)).alias(n) for n, _, _ in OUTCOMES), status.alias("status"), (F.col("has") | F.col("b").isNotNull()).alias("reached"))


def talk_events(pages: DataFrame) -> DataFrame:
    """page_id, action, date, link, result (lower-case; date as text in ISO form) of every listed action; a short badge is one event."""
    known = with_templates(pages.where("content is not null")).withColumn("has", F.size(histories("templates")) > 0)
    a = actions(known).select("page_id", "action", "date", "link", "result")
    b = known.where("not has").select("page_id", simple_badge(F.col("templates")).alias("b")).where("b is not null")
    b = b.select("page_id", F.when(F.col("b.badge") == "ga", "gan").otherwise("fac").alias("action"), F.col("b.date").alias("date"), F.lit(None).cast("string").alias("link"), F.lit(None).cast("string").alias("result"))
    return a.unionByName(b).select("page_id", F.lower("action").alias("action"), iso(parse_date("date")).alias("date"), F.lower("link").alias("link"), F.lower("result").alias("result"))


def unreached(pages: DataFrame) -> DataFrame:
    """Pages with neither a history nor a short badge, or without content."""
    known = with_templates(pages)
    return known.where(F.col("content").isNull() | ((F.size(histories("templates")) == 0) & simple_badge(F.col("templates")).isNull())).select("page_id")


def normalize_importance(c: Column) -> Column:
    low = F.trim(F.lower(c))
    return F.when(low.isin("low", "mid", "high", "top"), low)


def topic_tags(pages: DataFrame) -> DataFrame:
    """page_id, pos, project_name, importance of every project template (`WikiProject` and a name); the importance is the value of
    the first argument whose key holds the word."""
    rows = with_templates(pages).select("page_id", F.posexplode("templates").alias("pos", "t"))
    name = F.trim(F.regexp_replace("t.name", r"\s+", " "))
    rows = rows.withColumn("name", name).where(F.lower("name").startswith("wikiproject ") & ~F.contains(F.lower("name"), F.lit("banner shell")))
    given = F.filter("t.args", lambda a: F.contains(a["key"], F.lit("importance")))
    return rows.select("page_id", "pos", F.expr("substring(name, 13)").alias("project_name"), normalize_importance(F.get(given, 0)["value"]).alias("importance"))


def top_topics(tags: DataFrame, *, top: int = 250, leave_out: tuple[str, ...] = ()) -> DataFrame:
    """Tags of the `top` most frequent projects (ties by name), without some; the list is small by its parameter."""
    best = tags.groupBy("project_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "project_name").limit(top).select("project_name")
    return tags.join(F.broadcast(best), "project_name", "left_semi").where(~F.col("project_name").isin(*leave_out) if leave_out else F.lit(True))


def most_common(tags: DataFrame, column: str = "project_name") -> DataFrame:
    return tags.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def feature_name(name: Column) -> Column:
    return F.concat(F.lit("TOPIC_i_"), F.regexp_replace(F.lower(name), " ", "_"))


def topic_pivot(tags: DataFrame, *, limit: int | None = None, binary: bool = False) -> DataFrame:
    """One column for each topic in order of frequency: low 1, mid 2, unknown 3, high 4, top 5, absent 0; of a page's repeated tags
    the last counts. Topics of one column name (case and blanks aside) are one topic. Of more than `limit` topics the
    most frequent are kept; without `limit` all are, and more than COLUMNS raise an error."""
    named = tags.withColumn("project_name", F.regexp_replace(F.lower("project_name"), " ", "_"))
    names = [r.project_name for r in most_common(named).limit(COLUMNS + 1 if limit is None else limit).collect()]
    if limit is None and len(names) > COLUMNS:
        raise ValueError(f"more than {COLUMNS} topics: give a limit, or take the most frequent by top_topics")
    value = F.when(F.col("importance") == "low", 1).when(F.col("importance") == "mid", 2).when(F.col("importance") == "high", 4).when(F.col("importance") == "top", 5).otherwise(3)
    last = named.groupBy("page_id", "project_name").agg(F.max_by(F.lit(1) if binary else value, "pos").alias("v"))
    out = last.groupBy("page_id").pivot("project_name", names).agg(F.max("v")).na.fill(0)
    return out.select("page_id", *(F.col(f"`{n}`").alias("TOPIC_i_" + n) for n in names))
