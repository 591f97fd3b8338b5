"""Collects demonstration queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postlake.tables import read


class Registry:
    """queries and sql by name; a query gets a function that reads tables by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(make):
            self.queries[name] = lambda spark, folder: make(lambda table: read(spark, folder, table))
            if sql:
                self.sql[name] = sql
            return make

        return keep
