"""Named queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Table = Callable[[str], DataFrame]


class Registry:
    """Collects queries: a function of a table loader, and its DuckDB SQL or None."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable:
        def add(build: Callable[[Table], DataFrame]) -> Callable:
            if name in self.queries:
                raise ValueError(f"{name} is registered twice")
            self.queries[name] = lambda spark, sf_dir: build(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
            if sql:
                self.oracles[name] = sql
            return build

        return add
