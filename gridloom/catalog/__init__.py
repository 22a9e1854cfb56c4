"""Named queries over the given tables, each with the same query in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_SECTIONS = ["sources", "tables", "cleaning", "resampling", "windows", "joins", "sets", "metadata", "scalars"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with its SQL."""

    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is there twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for section in _SECTIONS:
        import_module(f"gridloom.catalog.{section}")
    return dict(QUERIES), dict(ORACLES)
