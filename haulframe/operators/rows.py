"""Row-level verbs: select, rename, filter, recode, drop, fill."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pick(df: DataFrame, **named: str | Column) -> DataFrame:
    """Select, reorder and rename in one step: ``pick(df, New="old")``."""
    return df.select(
        *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in named.items()]
    )


def rename_all(df: DataFrame, fn: Callable[[str], str] = str.lower) -> DataFrame:
    """Rename every column by a function."""
    return df.toDF(*[fn(c) for c in df.columns])


def add_steps(df: DataFrame, *steps: tuple[str, Column]) -> DataFrame:
    """Add or overwrite columns one after another; later ones see earlier ones."""
    for name, column in steps:
        df = df.withColumn(name, column)
    return df


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with any missing value."""
    return df.dropna("any", subset=list(columns) if columns else None)


def fill_missing(df: DataFrame, values: dict) -> DataFrame:
    """Replace missing values by constants."""
    return df.fillna(values)


def matching_columns(df: DataFrame, pattern: str) -> list[str]:
    """Names of the columns that match a regular expression."""
    return [c for c in df.columns if re.search(pattern, c)]


def preview(df: DataFrame, order: Sequence[Column], n: int = 6) -> DataFrame:
    """First rows in a stated order."""
    return df.orderBy(*order).limit(n)
