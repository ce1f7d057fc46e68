"""A set of named queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        """Register the decorated function under its own or another name."""

        def add(function: Query) -> Query:
            key = name or function.__name__
            if key in self.queries:
                raise ValueError(f"{key} is registered twice")
            self.queries[key] = function
            if sql:
                self.oracles[key] = sql
            return function

        return add
