"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import base, reading_queries, search_queries, table_queries, text_queries  # noqa: F401  the modules register their queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.QUERIES["flagship_search"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return base.QUERIES


def oracle_sql() -> dict[str, str]:
    return base.SQL
