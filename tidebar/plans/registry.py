"""Query registry: name -> Spark plan, name -> DuckDB twin."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidebar.functions.core import tidy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; results are put in report form."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark, sf):
            spark.conf.set("spark.sql.session.timeZone", "UTC")  # the views are defined in UTC
            return tidy(fn(spark, sf))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn
    return wrap
