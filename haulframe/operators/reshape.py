"""Long to wide and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot_wider(
    df: DataFrame,
    ids: Sequence[str],
    names: str,
    values: str,
    levels: Sequence[str] | None = None,
    fill=None,
    agg: Column | None = None,
) -> DataFrame:
    """One column per level of ``names``.

    Without ``agg`` a cell must hold at most one row; two raise an error.
    Passing ``levels`` avoids the extra job that discovers them; a value that is
    not among them is an error, as its rows would be lost.
    """
    if levels is not None:
        known = F.col(names).isin(*levels)
        unknown = F.concat(F.lit(f"{names} outside the levels: "),
                           F.coalesce(F.col(names).cast("string"), F.lit("NULL")))
        df = df.withColumn(names, F.when(known, F.col(names)).otherwise(F.raise_error(unknown)))
    one = F.when(
        F.count(F.lit(1)) > 1,
        F.raise_error(F.lit("more than one value per cell")),
    ).otherwise(F.first(values))
    grouped = df.groupBy(*ids)
    wide = grouped.pivot(names, list(levels) if levels is not None else None).agg(
        one if agg is None else agg
    )
    if fill is None:
        return wide
    cells = [c for c in wide.columns if c not in ids]
    return wide.fillna(fill, subset=cells)


def pivot_longer(
    df: DataFrame, columns: Sequence[str], names_to: str, values_to: str
) -> DataFrame:
    """One row per former column."""
    ids = [c for c in df.columns if c not in columns]
    return df.unpivot(ids, list(columns), names_to, values_to)
