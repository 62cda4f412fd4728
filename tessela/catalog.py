"""The registry behind ``queries()`` and ``oracle_sql()``."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessela.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]


def _shipped(f: Query) -> Query:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return f(spark, sf_dir)

    return run


class Catalog:
    """Named queries, each with its DuckDB statement where SQL can say it."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = _shipped(f)
            if sql:
                self.oracle[name] = sql
            return f

        return register

    def merge(self, other: Catalog) -> None:
        """Takes over another catalog's queries; a name that both have is an error."""
        twice = self.queries.keys() & other.queries.keys()
        if twice:
            raise ValueError(f"queries are registered twice: {sorted(twice)}")
        self.queries |= other.queries
        self.oracle |= other.oracle
