"""Name -> query and name -> oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidencia.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy attribute access to the tables of one folder: `t.orders`, `t.documents`, ..."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.root, name)


def query(sql: str | None = None, name: str | None = None):
    """Register `fn(tables)` as a query; `sql` is the equivalent statement for the oracle."""

    def register(fn):
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = lambda spark, root: fn(Tables(spark, root))
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register
