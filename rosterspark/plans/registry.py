"""All core queries and oracles in one place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rosterspark.plans import core_queries, pipeline_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**core_queries.QUERIES, **pipeline_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**core_queries.ORACLES, **pipeline_queries.ORACLES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core_queries.flagship(spark, sf_dir)
