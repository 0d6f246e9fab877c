"""Queries that apply the operators to the driver's tables, each beside DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL for its rows if SQL can express them."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def load_all() -> None:
    from sparkmere.catalogue import chunking, evaluation, evidence, governance, ingest, library, logs, matching, narrowing, tags, texts, upkeep, vectors  # noqa: F401
