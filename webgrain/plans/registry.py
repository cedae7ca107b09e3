"""Registered queries: a Spark function and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webgrain.session import configure, spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables of one data folder; Spark reads only what a query selects."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str, key: str) -> DataFrame:
        """A table for CPU-heavy work, with at least one partition per core."""
        return spread(getattr(self, name), key)

    def view(self, view: View) -> DataFrame:
        return getattr(self, view.table).selectExpr(*[f"{e} AS {c}" for c, e in view.columns.items()])


class View:
    """A projection of a given table, in expressions that Spark and SQL share."""

    def __init__(self, table: str, **columns: str) -> None:
        self.table = table
        self.columns = columns

    @property
    def sql(self) -> str:
        picked = ", ".join(f"{e} AS {c}" for c, e in self.columns.items())
        return f"(SELECT {picked} FROM {self.table})"


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(configure(spark), folder))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
