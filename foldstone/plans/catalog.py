"""The catalogue of queries: each is a function of a session and a folder of tables."""

from __future__ import annotations

from . import kv_queries, maintenance, store_queries


def queries() -> dict:
    return {**kv_queries.QUERIES, **store_queries.QUERIES, **maintenance.queries()}


def oracle_sql() -> dict[str, str]:
    return {**kv_queries.SQL, **store_queries.SQL, **maintenance.oracle_sql()}
