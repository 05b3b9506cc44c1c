"""Registration of catalogue queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    ids: str
    run: QueryFn
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(ids: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a function as a query. ``ids`` names the inventory entries it covers; ``sql`` is the check."""
    def register(fn: QueryFn) -> QueryFn:
        if fn.__name__ in CATALOG:
            raise ValueError(f"duplicate query {fn.__name__}")
        CATALOG[fn.__name__] = Query(fn.__name__, ids, fn, sql)
        return fn
    return register
