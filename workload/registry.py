"""Registered queries and the SQL text each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workload.inputs import Catalog, check_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}
# Intermediate results in SQL, written for the checks only.
PARTS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register ``fn(catalog)``; ``check`` is SQL over inputs and parts in braces."""

    def register(fn: Callable[[Catalog], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Catalog(spark, sf_dir))
        if check is not None:
            CHECKS[name] = check
        return fn

    return register


def checks() -> dict[str, str]:
    return {name: check_sql(body, PARTS) for name, body in CHECKS.items()}


def run_ts():
    """The run time every registered query uses."""
    from pyspark.sql import functions as F

    return F.lit("2024-02-01 00:00:00").cast("timestamp")
