"""Where queries are registered."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table, view, with_views

Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None, *inputs: str) -> Callable:
    """Registers a function of the named tables and views (views end in _v); sql is None where SQL has no form for it."""

    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        Q[name] = (lambda spark, sf: f(*((view if i.endswith("_v") else table)(spark, sf, i) for i in inputs)), with_views(sql) if sql else None)
        return f

    return put
