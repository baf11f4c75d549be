"""Registry helper: a query is a callable plus, where possible, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.functions: dict[str, QueryFn] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def register(fn: QueryFn) -> QueryFn:
            if name in self.functions:
                raise ValueError(f"query {name} registered twice")
            self.functions[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn
        return register
