"""Registration of queries with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.shipping import ship


class Registry:
    """Queries of one area: a decorator adds a query and, where SQL can express it, its oracle."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def register(f):
            self.queries[name] = f
            if sql:
                self.oracles[name] = sql
            return f

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
