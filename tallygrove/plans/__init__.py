"""Registered queries over the given tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and its SQL counterpart where SQL can state it."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def load_all() -> tuple[dict[str, Query], dict[str, str]]:
    from . import catalogs, cohorts, demographics, files, frames, measurements, streams, texts, versions  # noqa: F401

    return QUERIES, ORACLES
