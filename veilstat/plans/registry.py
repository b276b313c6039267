"""Name to (Spark query, SQL twin or None) for the operators of the statistical engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register a query function under a name, with the SQL that any engine can run on the same tables."""

    def put(f: Query) -> Query:
        QUERIES[name] = (f, sql)
        return f

    return put


def load_all() -> dict[str, tuple[Query, str | None]]:
    """Import every module that registers queries."""
    from veilstat.plans import catalog  # noqa: F401

    return QUERIES
