"""Group results attached to rows.

These are grouped aggregates joined back by ``attach`` rather than window
functions: a window would gather each group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulframe.functions.nulls import safe_ratio
from haulframe.operators.aggregate import first_seen_mode
from haulframe.operators.joins import null_safe_join, attach
from haulframe.operators.ordered import quantiles


def group_shares(
    df: DataFrame, within: Sequence[str], names: dict[str, str], aggregated: bool = False
) -> DataFrame:
    """Shares of the group totals for several columns at once.

    ``df`` is read twice; hand in a written table when it is costly.  ``aggregated``
    says that it holds one row per category of a group, so that a group has as many rows
    as there are categories: a window over it then needs no second pass.
    """
    if aggregated:
        group = Window.partitionBy(*within)
        return df.withColumns(
            {p: safe_ratio(F.col(n), F.sum(n).over(group)) for n, p in names.items()}
        )
    totals = df.groupBy(*within).agg(
        *[F.sum(n).alias(f"__total_{n}") for n in names]
    )
    return (
        attach(df, totals, within)
        .withColumns({p: safe_ratio(n, f"__total_{n}") for n, p in names.items()})
        .drop(*[f"__total_{n}" for n in names])
    )


def group_share(
    df: DataFrame,
    within: Sequence[str],
    n: str = "n",
    name: str = "prop",
    aggregated: bool = False,
) -> DataFrame:
    """Each row's share of its group total, as ``group_shares``."""
    return group_shares(df, within, {n: name}, aggregated)


def zscore(
    df: DataFrame,
    within: Sequence[str],
    value: str,
    name: str = "std",
    aggregated: bool = False,
) -> DataFrame:
    """Distance from the group mean in standard deviations.

    ``aggregated`` as in ``group_shares``.
    """
    if aggregated:
        group = Window.partitionBy(*within)
        off = F.col(value) - F.avg(value).over(group)
        return df.withColumn(name, safe_ratio(off, F.stddev_samp(value).over(group)))
    stats = df.groupBy(*within).agg(
        F.avg(value).alias("__mean"), F.stddev_samp(value).alias("__sd")
    )
    return attach(df, stats, within).withColumn(
        name, safe_ratio(F.col(value) - F.col("__mean"), "__sd")
    ).drop("__mean", "__sd")


def group_stats(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    seq: str | None = None,
    median: bool = True,
) -> DataFrame:
    """One row per group: n, mean, sd, median and, with ``seq``, the mode."""
    stats = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
    )
    if median:
        stats = null_safe_join(
            stats, quantiles(df, keys, value, {"median": 0.5}), keys, "left"
        )
    if seq:
        stats = null_safe_join(
            stats, first_seen_mode(df, keys, value, seq), keys, "left"
        )
    return stats


def attach_group_stats(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    seq: str | None = None,
    median: bool = True,
) -> DataFrame:
    """Rows with the statistics of their group."""
    return attach(df, group_stats(df, keys, value, seq, median), keys)


def group_max_rows(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows holding their group's maximum; ties are all kept.

    The value is part of the join key, so a big group spreads over its values.
    """
    top = df.groupBy(*keys).agg(F.max(value).alias(value))
    return attach(
        df, top.filter(F.col(value).isNotNull()), [*keys, value], "left_semi"
    )
