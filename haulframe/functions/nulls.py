"""Missing-value rules.

The analyses were specified in a language where a missing value spreads
through conditions and totals, equals itself as a key, and sorts last.  SQL
decides each of these differently, so every rule gets one named helper.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def if_else_na(cond: Column, yes, no) -> Column:
    """Two-way choice whose result is NULL when the condition is NULL."""
    return F.when(cond, yes).when(~cond, no)


def case_na(*branches: tuple[Column, object]) -> Column:
    """First true branch wins; NULL when none is true."""
    out = F.when(branches[0][0], branches[0][1])
    for cond, value in branches[1:]:
        out = out.when(cond, value)
    return out


def recode(c: str | Column, mapping: dict, keep_other: bool = False) -> Column:
    """Value-for-value replacement; unknown values become NULL or stay."""
    c = as_col(c)
    out = case_na(*[(c == k, F.lit(v)) for k, v in mapping.items()])
    return out.otherwise(c) if keep_other else out


def is_member(c: str | Column, values: Iterable) -> Column:
    """Membership that is never NULL: a missing value is not a member."""
    return F.coalesce(as_col(c).isin(list(values)), F.lit(False))


def not_member(c: str | Column, values: Iterable) -> Column:
    """Non-membership that keeps missing values."""
    return ~is_member(c, values)


def strict(agg: Column, c: str | Column) -> Column:
    """Aggregate that is NULL as soon as one input is NULL."""
    return F.when(F.count(as_col(c)) == F.count(F.lit(1)), agg)


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """Division giving NULL, not an error, for a zero denominator."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def safe_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation over complete pairs; NULL for a constant series."""
    x, y = as_col(x).cast("double"), as_col(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    return F.try_divide(
        F.covar_samp(xs, ys), F.stddev_samp(xs) * F.stddev_samp(ys)
    )


def distinct_with_null(c: str | Column, approx: bool = False) -> Column:
    """Distinct count in which NULL counts as one more value.

    Exact by default; ``approx`` swaps in the mergeable sketch.
    """
    c = as_col(c)
    counted = F.approx_count_distinct(c) if approx else F.count_distinct(c)
    return counted + F.max(c.isNull().cast("int"))


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Join condition in which a missing key matches a missing key."""
    return reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys]
    )
