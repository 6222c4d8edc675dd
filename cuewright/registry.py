"""All queries of the library outside the llm subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import catalog_io, catalog_more, catalog_runs, catalog_streams, catalog_text

_CATALOGS = [catalog_text, catalog_runs, catalog_io, catalog_more, catalog_streams]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for c in _CATALOGS for name, (fn, _) in c.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for c in _CATALOGS for name, (_, sql) in c.QUERIES.items() if sql}
