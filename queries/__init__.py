"""Queries of the library's operators on the shared tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


REGISTERED: dict[str, Query] = {}


def query(sql: str | None = None):
    """Register a function ``(spark, folder) -> DataFrame`` under its name."""
    def add(f):
        if f.__name__ in REGISTERED:
            raise ValueError(f"duplicate query {f.__name__}")
        REGISTERED[f.__name__] = Query(f, sql)
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load_all() -> dict[str, Query]:
    from queries import aggregates, charts, designs, frames, jobs, outputs, reshaping, rows, trees  # noqa: F401

    return REGISTERED
