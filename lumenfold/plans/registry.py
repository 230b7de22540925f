"""Registry of named queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name; ``sql`` is missing where SQL cannot express one."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return add

    def merge(self, other: "Registry") -> "Registry":
        for name, f in other.queries.items():
            self.query(name, other.sql.get(name))(f)
        return self
