"""Mergeable sketches as columns: quantiles and distinct counts kept and merged later.

A sketch takes a few kilobytes whatever the rows behind it, so those of a year can be
stored with its tables; groups of several years, or coarser groups, come from merging
them, without the rows.  Quantiles are within ``RANK_ERROR`` of the wanted rank and
distinct counts within ``COUNT_ERROR`` of the true one, nearly always; both are exact
while a group has few values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Items that a quantile sketch keeps per level, and bits of the index of a distinct sketch.
KEPT, BITS = 400, 12
# Rank error of a quantile, and relative error of a distinct count (three standard errors).
RANK_ERROR, COUNT_ERROR = 0.01, 0.05


def sketches(
    df: DataFrame,
    keys: Sequence[str],
    quantiles: Mapping[str, str],
    distinct: Mapping[str, str],
) -> DataFrame:
    """Rows per group, and a sketch column for each named value column.

    Missing values are in no sketch.  A group without a value has an empty sketch or
    none.
    """
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.kll_sketch_agg_double(F.col(c).cast("double"), KEPT).alias(n)
          for n, c in quantiles.items()],
        *[F.hll_sketch_agg(F.col(c).cast("string"), BITS).alias(n) for n, c in distinct.items()],
    )


def merge_sketches(
    stored: DataFrame, keys: Sequence[str], quantiles: Sequence[str], distinct: Sequence[str]
) -> DataFrame:
    """One row per coarser group, of stored sketches; ``n`` adds up."""
    return stored.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        *[F.kll_merge_agg_double(c, KEPT).alias(c) for c in quantiles],
        *[F.hll_union_agg(c).alias(c) for c in distinct],
    )


def quantile_of(sketch: str, prob: float) -> Column:
    """A value of the group near the wanted rank; NULL of an empty sketch."""
    some = F.kll_sketch_get_n_double(sketch) > 0
    return F.when(some, F.kll_sketch_get_quantile_double(sketch, F.lit(float(prob))))


def distinct_of(sketch: str) -> Column:
    """About how many different values the group has."""
    return F.hll_sketch_estimate(sketch)
