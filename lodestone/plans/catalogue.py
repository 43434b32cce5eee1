"""Every registered query of the library with, where SQL can express it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import corpus_queries, detection_queries, evaluation_queries, extra_queries, release_queries, retrieval_queries, scaling_queries, selection_queries, source_queries, verification_queries

_MODULES = (corpus_queries, selection_queries, retrieval_queries, detection_queries, scaling_queries, source_queries, extra_queries, evaluation_queries, verification_queries, release_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to ``(spark, sf_dir) -> DataFrame``."""
    return {k: v for m in _MODULES for k, v in m.query.queries.items()}


def oracle_sql() -> dict[str, str]:
    """Query name to the DuckDB SQL of the same result."""
    return {k: v for m in _MODULES for k, v in m.query.oracles.items()}
