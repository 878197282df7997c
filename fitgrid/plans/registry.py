"""Where registered queries and their SQL twins are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fitgrid.bindings import Domain

_QUERIES: dict[str, Callable[[Domain], DataFrame]] = {}
_TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query over the domain tables, with its SQL twin if one exists."""
    def register(build: Callable[[Domain], DataFrame]) -> Callable[[Domain], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = build
        if sql is not None:
            _TWINS[name] = sql
        return build
    return register


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build):
        return lambda spark, directory: build(Domain(spark, directory))
    return {name: bind(build) for name, build in _QUERIES.items()}


def all_twins() -> dict[str, str]:
    return dict(_TWINS)
