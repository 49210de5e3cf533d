"""Query registry: name -> (Spark plan over the test tables, oracle SQL).

Each plan reads the given parquet tables through :mod:`quarry.plans.tables`
and applies the library's operators. The oracle SQL is written by hand from
the original semantics and runs on DuckDB over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from . import (q_conventions, q_corpus, q_arch, q_graph, q_patterns,  # noqa: F401
                   q_coverage, q_context, q_facts, q_dictionary, q_sources)
