"""Registered queries of the library's operators on the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to 6 digits, times as ISO text, whole numbers as long: comparable with the SQL."""
    from .functions.times import iso

    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6) + 0.0
        elif isinstance(f.dataType, T.TimestampType):
            c = iso(c)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def register(name: str, query: Query, sql: str | None = None) -> None:
    _QUERIES[name] = lambda spark, sf: tidy(query(spark, sf))
    if sql:
        _SQL[name] = sql


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL


def _load() -> None:
    if not _QUERIES:
        from .plans import lifecycle_queries, model_queries, page_queries

        for module in (lifecycle_queries, page_queries, model_queries):
            module.register_all(register)
