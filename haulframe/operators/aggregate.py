"""Grouped aggregation.

Everything here combines on the map side; groups of any size cost one
partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulframe.functions.nulls import as_col, safe_corr, safe_ratio, strict


def mean(c: str | Column, strict_nulls: bool = False) -> Column:
    return strict(F.avg(as_col(c)), c) if strict_nulls else F.avg(as_col(c))


def sd(c: str | Column, strict_nulls: bool = False) -> Column:
    out = F.stddev_samp(as_col(c))
    return strict(out, c) if strict_nulls else out


def cv(c: str | Column, digits: int | None = None) -> Column:
    """Standard deviation over mean."""
    out = safe_ratio(F.stddev_samp(as_col(c)), F.avg(as_col(c)))
    return out if digits is None else F.round(out, digits)


def std_error(c: str | Column) -> Column:
    return safe_ratio(F.stddev_samp(as_col(c)), F.sqrt(F.count(as_col(c))))


def group_counts(df: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))


def count_where(cond: Column) -> Column:
    """Conditional count; a group without a match counts zero."""
    return F.count_if(F.coalesce(cond, F.lit(False)))


def first_seen_mode(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    seq: str | Column,
    name: str = "mode",
) -> DataFrame:
    """Most frequent value; among equals the one seen first by ``seq``.

    Counting per (key, value) comes first, so a group reaches its final task
    as one row per distinct value and task, already reduced by ``min_by``.
    """
    tallies = df.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("__n"), F.min(as_col(seq)).alias("__first")
    )
    return tallies.groupBy(*keys).agg(
        F.min_by(F.col(value), F.struct(-F.col("__n"), F.col("__first"))).alias(name)
    )


def correlation(
    df: DataFrame, keys: Sequence[str], x: str, y: str, name: str = "cor"
) -> DataFrame:
    return df.groupBy(*keys).agg(safe_corr(x, y).alias(name))


def with_subtotals(
    df: DataFrame,
    outer: Sequence[str],
    inner: str,
    label: str,
    aggs: dict[str, Column],
) -> DataFrame:
    """Rows per (outer, inner) and one labelled subtotal row per outer key.

    One pass over the rows with grouping sets.
    """
    fine = [F.col(k) for k in (*outer, inner)]
    coarse = [F.col(k) for k in outer]
    grouped = df.groupingSets([fine, coarse], *fine).agg(
        F.grouping(inner).alias("__sub"),
        *[c.alias(n) for n, c in aggs.items()],
    )
    named = F.when(F.col("__sub") == 1, F.lit(label)).otherwise(
        F.col(inner).cast("string")
    )
    return grouped.withColumn(inner, named).select(*outer, inner, *aggs)


def screen(
    df: DataFrame, keys: Sequence[str], aggs: dict[str, Column], keep: Column
) -> DataFrame:
    """Aggregate, then keep the groups that meet a condition."""
    return (
        df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()]).filter(keep)
    )


def share_check(
    df: DataFrame, keys: Sequence[str], share: str, tolerance: float = 1e-9
) -> DataFrame:
    """Sum of shares per group and whether it is one."""
    return df.groupBy(*keys).agg(F.sum(share).alias("total")).withColumn(
        "ok", F.abs(F.col("total") - 1) <= tolerance
    )
