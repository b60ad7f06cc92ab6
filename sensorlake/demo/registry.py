"""Name -> (Spark query, equivalent SQL or None)."""

from collections.abc import Callable
from importlib import import_module
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]

_MODULES = ("normalization", "transformation", "computations", "profiling", "operations", "ranking", "graphs",
            "ingest", "streams")


class Query(NamedTuple):
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(run, sql)
        return run
    return register


def _load() -> dict[str, Query]:
    for module in _MODULES:
        import_module(f"{__package__}.{module}")
    return QUERIES


def queries() -> dict[str, Run]:
    return {name: q.run for name, q in _load().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in _load().items() if q.sql is not None}
