"""Registration of queries: a function over Tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.ledger import Tables, with_tables

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, *tables: str):
    """Registers a function under its name; ``tables`` are the ledger tables that its SQL names."""

    def put(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = with_tables(sql, *tables)
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from ..operators import actions, activity, backfill, contract, graph, ingest, ledger_ops, lifecycle, living_index, maintenance, questions, retrieval, similarity, streams, text_ops, vectors  # noqa: F401

    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
