"""Reading the shared tables, and registering a query with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """The tables of one folder, opened by name: ``t.orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def register(catalog: dict, sql: str | None = None):
    """Add the decorated function to ``catalog`` under its own name."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        catalog[fn.__name__] = (lambda spark, folder: fn(Tables(spark, folder)), sql)
        return fn

    return wrap


def r(c: str | Column, digits: int = 6) -> Column:
    """Rounded column, so that sums in another order compare equal."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)
