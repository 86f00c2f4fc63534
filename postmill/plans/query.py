"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postmill.sources.tables import table


class Tables:
    """The tables of a folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)


class Registry:
    def __init__(self):
        self.QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.SQL: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Registers a function of Tables under its name."""

        def register(f: Callable[[Tables], DataFrame]):
            self.QUERIES[f.__name__] = lambda spark, d: f(Tables(spark, d))
            if sql:
                self.SQL[f.__name__] = sql
            return f

        return register
