"""Collects queries and their SQL while the modules of this package are imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a function under its own name, with the DuckDB SQL that gives the same rows."""

        def add(f: Query) -> Query:
            if f.__name__ in self.queries:
                raise ValueError(f"two queries are named {f.__name__}")
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return add
