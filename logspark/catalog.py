"""The library's queries over the given tables, and DuckDB SQL that restates each one from the base tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import queries_alerts, queries_ingest, queries_search, queries_traces

_MODULES = (queries_search, queries_traces, queries_ingest, queries_alerts)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["histogram"](spark, sf_dir)
