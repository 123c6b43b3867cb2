"""Name -> (Spark query, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.ordered import release

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def _fresh(fn: Query) -> Query:
    """Start each query without the tables the one before it persisted."""
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        release()
        return fn(spark, sf_dir)
    return run


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function name with the SQL that must give the same rows."""
    def add(fn: Query) -> Query:
        key = name or fn.__name__
        if key in REGISTRY:
            raise ValueError(f"query {key} registered twice")
        REGISTRY[key] = (_fresh(fn), sql)
        return fn
    return add
