"""Sorting and category order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulframe.operators.joins import attach
from haulframe.operators.ordered import quantiles, running_totals


def order_columns(keys: Sequence[str]) -> list[Column]:
    """Sort columns, missing last; a leading minus means descending."""
    return [
        F.col(k[1:]).desc_nulls_last() if k.startswith("-")
        else F.col(k).asc_nulls_last()
        for k in keys
    ]


def arrange(df: DataFrame, keys: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """Total sort; ``tie`` columns make it stable and let a run of equal keys
    spread over several sort partitions."""
    return df.orderBy(*order_columns([*keys, *tie]))


def fixed_rank(c: str, levels: Sequence[str]) -> Column:
    """Rank of a category in a stated order; unknown categories are NULL."""
    at = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(c))
    return F.when(at > 0, at).cast("int")


def rank_by_median(
    df: DataFrame, category: str, value: str, name: str = "rank", aggregated: bool = False
) -> DataFrame:
    """Categories ranked by descending median; equal medians share a rank.

    ``aggregated`` says that ``df`` holds one row per category and group of a stated,
    short list, as a table of results does: its medians and ranks need no passes of
    their own.
    """
    if aggregated:
        few = df.groupBy(category).agg(F.percentile(value, 0.5).alias("median"))
        ranked = F.dense_rank().over(Window.orderBy(F.col("median").desc())).cast("long")
        return few.withColumn(name, F.when(F.col("median").isNotNull(), ranked))
    medians = quantiles(df, [category], value, {"median": 0.5})
    steps = (
        medians.select((-F.col("median")).alias("__down"))
        .filter("__down IS NOT NULL")
        .distinct()
    )
    ranks = running_totals(steps, [], ["__down"], {name: F.lit(1).cast("long")})
    keyed = medians.withColumn("__down", -F.col("median"))
    return attach(keyed, ranks, ["__down"]).drop("__down")
