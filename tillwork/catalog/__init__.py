"""Named queries over the standard tables, each beside its SQL form where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillwork.session import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, root: fn(Tables(spark, root))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def load_all() -> None:
    from tillwork.catalog import (  # noqa: F401
        billing, cleaning, evaluation, experiments, features, filters, joins, loading, profiling, reports, sampling, splits, windows,
    )
