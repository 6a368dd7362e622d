"""Run registered queries and their SQL side by side: python -m tests.oracle [sf dir] [name ...]."""

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return None if math.isnan(v) else round(float(v), 5) + 0.0
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=str)


def compare(spark, con, sf, query, sql):
    df = query(spark, sf)
    got = rows(df.columns, df.collect())
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    want = rows(names, r.fetchall())
    bad = [(a, b) for a, b in zip(got, want) if str(a) != str(b) and not all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-5 * max(1, abs(x))) for x, y in zip(a, b))]
    assert len(got) == len(want) and not bad, (len(got), len(want), bad[:2])
    return len(got)


if __name__ == "__main__":
    import __spark_entry__ as e

    sf = sys.argv[1]
    spark = SparkSession.builder.master("local[3]").config("spark.sql.shuffle.partitions", "6").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, sqls = connect(sf), e.oracle_sql()
    skip = ("op", "pipeline")
    for name, q in e.queries().items():
        if (sys.argv[2:] and name not in sys.argv[2:]) or (not sys.argv[2:] and name.startswith(skip)):
            continue
        t = time.time()
        try:
            n = compare(spark, con, sf, q, sqls[name]) if name in sqls else q(spark, sf).count()
            print(f"ok {name} {n} rows {time.time() - t:.1f} s" + ("" if name in sqls else " (no SQL)") + (" EMPTY" if not n else ""), flush=True)
        except Exception as x:
            print(f"BAD {name}: {str(x)[:600]}", flush=True)
