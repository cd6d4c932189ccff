"""Named queries over the input tables, each with an equivalent SQL text where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_PREPARED: dict[tuple, object] = {}


def prepared(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]):
    """Inputs several queries share, built and written once per session and input folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _PREPARED:
        _PREPARED[key] = build()
    return _PREPARED[key]


def query(name: str, sql: str | None = None):
    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
