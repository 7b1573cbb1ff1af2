"""Registry of runnable queries and the independent SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliptide.session import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` with its DuckDB counterpart."""

    def add(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose rows cost much CPU (whole texts), spread over the cluster if its file is not split."""
    return spread(table(spark, folder, name))


def big(column: str) -> Column:
    return F.col(column).cast("bigint").alias(column)


def digits(column: str, places: int = 6) -> Column:
    """Rounded double without a negative zero."""
    return (F.round(F.col(column).cast("double"), places) + F.lit(0.0)).alias(column)
