"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievewright.plans import state_queries, text_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return text_queries.Q | state_queries.Q


def oracle_sql() -> dict[str, str]:
    return text_queries.SQL | state_queries.SQL
