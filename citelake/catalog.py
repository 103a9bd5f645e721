"""All queries of the library by key, and their SQL for the DuckDB check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(key: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[key] = f
        if oracle is not None:
            ORACLE[key] = oracle
        return f

    return put


def _load() -> None:
    from citelake.plans import composed, graph_queries, records, text_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
