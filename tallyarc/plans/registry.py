"""Registry of runnable plans: Spark callable plus the DuckDB text that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def plan(name: str, sql: str | None = None):
    def register(fn):
        if name in PLANS:
            raise ValueError(f"plan {name} registered twice")
        PLANS[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
