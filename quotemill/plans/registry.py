"""The registry of queries: name -> (function of the proxy tables, SQL that says the same or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quotemill.sources.proxy import Tables, oracle

REGISTRY: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def query(sql: str | None = None, **views: str):
    """Register a function under its name; ``views`` are further named views of its SQL."""

    def add(f: Callable[[Tables], DataFrame]):
        if f.__name__ in REGISTRY:
            raise ValueError(f"{f.__name__} is registered twice")
        REGISTRY[f.__name__] = (f, None if sql is None else oracle(sql, views))
        return f

    return add


def _load() -> None:
    from quotemill.plans import gold_queries, incremental_queries, job_queries, serve_queries, silver_queries, text_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql is not None}
