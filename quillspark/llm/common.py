"""Helpers shared by the corpus operators: shared-folder tables, held-out splits, Arrow batches."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


BROADCAST = 1 << 20  # rows of a few numbers that are broadcast at most, about 40 MB


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one on a single machine, an error on a cluster."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if where is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        where = sc.getCheckpointDir()
    return where


_tables: list[list[str]] = []


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that to_table writes inside are deleted at the end, but for those that the body takes out of the list."""
    _tables.append(made := [])
    try:
        yield made
    finally:
        _tables.remove(made)
        for path in made:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def to_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _tables[-1:]:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """An eager checkpoint() in the shared folder."""
    shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], text: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that column `text` holds about `limit` bytes in each; one row may hold more."""
    for batch in batches:
        n, at = batch.num_rows, 0
        if n == 0:
            continue
        step = max(1, int(n * limit / max(1, batch.column(text).nbytes)))
        while at < n:
            yield batch.slice(at, step)
            at += step


_held: dict[tuple, object] = {}


def held(owner: str, key: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task for one operator; what it has kept for others goes first, so that a reused
    worker never holds the tables of two."""
    others = [k for k in _held if k[0] != owner]
    for k in others:
        del _held[k]
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
    if (owner, key) not in _held:
        _held[owner, key] = make()
    return _held[owner, key]


def packed(docs: DataFrame, text: str, leave_out: list[str] | tuple[str, ...] = ()) -> tuple[DataFrame, Callable[[], list[Column]]]:
    """(`row`, a struct of all columns but `text` and those left out (whatever the case), and `text` as a string; a function
    that gives the kept columns back, text included, in their order). Inside an operator no name of the input can then clash
    with another, and the text is sent once."""
    out = {n.lower() for n in leave_out}
    kept = [f for f in docs.schema.fields if f.name.lower() not in out]
    other = [f.name for f in kept if f.name != text]
    row = F.struct(*(F.col(f"`{c}`") for c in other)) if other else F.lit(None).cast("boolean")

    def back() -> list[Column]:
        return [F.col("text").cast(f.dataType).alias(text) if f.name == text else F.col(f"row.`{f.name}`").alias(f.name) for f in kept]

    return docs.select(row.alias("row"), F.col(f"`{text}`").cast("string").alias("text")), back


def annotate(docs: DataFrame, text: str, fields: T.StructType, make: Callable, limit: int = 1 << 22) -> DataFrame:
    """docs with added columns, without a shuffle: `make()` runs once a task and gives a function from a list of texts
    (null: None) to a list of Arrow arrays, one for each field. A column of docs with the name of a field (whatever the
    case) gives way to it, `text` included, which is read first; all others pass through unchanged."""
    rows, back = packed(docs, text, fields.fieldNames())
    names = [f"v{i}" for i in range(len(fields))]
    n = 1 if text.lower() in [f.lower() for f in fields.fieldNames()] else 2  # a replaced text does not come back

    def run(batches):
        held("annotate", 0, object)
        f = make()
        for b in slices(batches, 1, limit):
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *f(b.column(1).to_pylist())], [*("row", "text")[:n], *names])

    out = rows.mapInArrow(run, T.StructType([*rows.schema.fields[:n], *(T.StructField(k, f.dataType) for k, f in zip(names, fields, strict=True))]))
    return out.select(*back(), *(F.col(k).alias(f.name) for k, f in zip(names, fields, strict=True)))


def chosen(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The two columns that most operators read, under their usual names."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def keep_winners(docs: DataFrame, rooted: DataFrame, key: Callable[[str | None], int], *, doc_id: str, text: str) -> DataFrame:
    """docs with one row of each root. rooted: doc_id, t, root of every row, where t is key(text), an unsigned 64-bit number.

    The row of the smallest doc_id stays (nulls last, then the smallest t). Rows are known by doc_id and t, which are
    computed from the row itself and so are the same in a retried task. The others are taken out by an anti-join, a
    broadcast one if they are BROADCAST or fewer; rows equal in doc_id and t are folded with partial sums.
    """
    best = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "t"))
    per = to_table(rooted.groupBy("root", "doc_id", "t").agg(F.count(F.lit(1)).alias("n")), "near-rows")
    first = per.groupBy("root").agg(best.alias("m")).select(F.col("root").alias("__root"), "m")
    judged = per.join(first, per.root == first["__root"]).withColumn("won", F.col("doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("t") == F.col("m.t")))
    judged = to_table(judged.select(F.col("doc_id").alias("__d"), F.col("t").alias("__k"), "won", "n"), "near-judged")
    rows, back = packed(docs, text)
    where = F.col("text") if doc_id == text else F.col(f"row.`{doc_id}`")
    rows = rows.withColumn("d", where.cast("long"))

    def run(batches):
        for b in slices(batches, 1, 1 << 22):
            t = np.array([key(x) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(t)], ["row", "text", "d", "k"])

    keyed = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("k", T.LongType())]))
    same = lambda other: F.col("d").eqNullSafe(other["__d"]) & (F.col("k") == other["__k"])
    lost = judged.where("not won or n > 1")
    if lost.count() <= BROADCAST:
        lost = F.broadcast(lost)
    out = keyed.join(lost, same(lost), "left_anti").select(*back())
    twice = judged.where("won and n > 1")
    if twice.isEmpty():
        return out
    one = keyed.join(twice, same(twice), "left_semi").groupBy("d", "k").agg(F.first(F.struct("row", "text")).alias("r"))
    return out.unionByName(one.select("r.row", "r.text").select(*back()))
