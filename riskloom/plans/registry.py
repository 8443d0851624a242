"""Named queries over the driver's tables and the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its SQL if it has one."""

    def add(run: Callable[[SparkSession, str], DataFrame]):
        key = name or run.__name__
        QUERIES[key] = run
        if sql:
            ORACLE_SQL[key] = sql.strip()
        return run

    return add


from . import cycles, feeds, ingest, more, refresh, reports, risk, series, tagging, texts, validation  # noqa: E402, F401 (they register their queries)
