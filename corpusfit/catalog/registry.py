"""Registry that fills ``queries()`` and ``oracle_sql()`` of the driver contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusfit.catalog.views import Inputs, duck_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(inputs)`` as ``name``, with its DuckDB twin when there is one."""

    def wrap(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        MODULES[name] = fn.__module__.rsplit(".", 1)[-1]
        QUERIES[name] = lambda spark, folder: fn(Inputs(spark, folder))
        if oracle is not None:
            ORACLES[name] = duck_sql(oracle)
        return fn

    return wrap
