"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import aggregate_queries, catalog_queries, function_queries, join_queries, loop_queries, sequence_queries, source_queries

_MODULES = (source_queries, catalog_queries, function_queries, join_queries, aggregate_queries, sequence_queries, loop_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for m in _MODULES for name, run in m.book.runs.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.book.sql.items()}
