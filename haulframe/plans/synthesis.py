"""Comparisons over several survey years."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulframe.functions.nulls import if_else_na, recode
from haulframe.functions.text import join_text
from haulframe.operators.joins import tagged_union
from haulframe.operators.ordered import quantiles
from haulframe.operators.sketches import merge_sketches, quantile_of, sketches
from haulframe.operators.stats import boxplot, kernel_density
from haulframe.plans.survey import depth_correlation, sex_ratio

__all__ = [
    "union_years", "harmonise", "detailed_gear", "medians_by", "facet_rows",
    "medians_by_facets", "sex_ratio_by_facets", "year_sketches", "medians_from_sketches",
    "boxes_by", "densities_by", "sex_ratio", "depth_correlation",
]


def union_years(tables: dict[int, DataFrame]) -> DataFrame:
    """Stack the years, tagged; a column missing in one year is NULL there."""
    return tagged_union(tables, "year")


def harmonise(
    df: DataFrame, gears: dict[str, str], stations: dict[str, int]
) -> DataFrame:
    """One gear name and one station number for what years named differently."""
    return df.withColumns(
        {
            "gear": recode("gear", gears, keep_other=True),
            "station": recode("station", stations),
        }
    )


def detailed_gear(df: DataFrame) -> DataFrame:
    """Gear with its pot size in front where there is one."""
    return df.withColumn(
        "gear2",
        if_else_na(
            F.col("pot_size").isNotNull(),
            join_text(" ", "pot_size", "gear", show_na=True),
            F.col("gear"),
        ),
    )


def medians_by(
    df: DataFrame, by: Sequence[str], value: str = "length", approx: bool = False
) -> DataFrame:
    """Median per any choice of gear, year, station, stratum and sex."""
    return quantiles(df, list(by), value, {"median": 0.5}, approx)


def facet_rows(
    df: DataFrame, facets: Sequence[Sequence[str]], values: Sequence[str]
) -> tuple[DataFrame, list[str]]:
    """Each row once per facet, and the columns that tell the groups of all facets apart.

    ``facet`` names the facet, a column that is not of the facet is NULL.  One pass over the
    rows serves all facets: what follows combines on the map side.
    """
    keys = list(dict.fromkeys(k for by in facets for k in by))
    kind = {f.name: f.dataType for f in df.schema.fields}
    copies = [
        F.struct(
            F.lit("_".join(by)).alias("facet"),
            *[(F.col(k) if k in by else F.lit(None).cast(kind[k])).alias(k) for k in keys],
        )
        for by in facets
    ]
    spread = df.select(*values, F.explode(F.array(*copies)).alias("__facet"))
    return spread.select("__facet.*", *values), ["facet", *keys]


def medians_by_facets(
    df: DataFrame, facets: Sequence[Sequence[str]], value: str = "length", approx: bool = False
) -> DataFrame:
    """Medians of several groupings from the same two passes over the rows."""
    rows, keys = facet_rows(df, facets, [value])
    return quantiles(rows, keys, value, {"median": 0.5}, approx)


def sex_ratio_by_facets(df: DataFrame, facets: Sequence[Sequence[str]]) -> DataFrame:
    """Sex ratios of several groupings from one pass over the rows."""
    rows, keys = facet_rows(df, facets, ["sex"])
    return sex_ratio(rows, keys)


def year_sketches(df: DataFrame, by: Sequence[str], value: str = "length") -> DataFrame:
    """A mergeable sketch of a value per group, to be kept with each year's tables."""
    return sketches(df, by, {"length_sketch": value}, {})


def medians_from_sketches(stored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Approximate medians of several years together from what was kept of each."""
    merged = merge_sketches(stored, by, ["length_sketch"], [])
    return merged.select(*by, "n", quantile_of("length_sketch", 0.5).alias("median"))


def boxes_by(df: DataFrame, by: Sequence[str], value: str = "n_target") -> DataFrame:
    return boxplot(df, list(by), value)


def densities_by(
    df: DataFrame,
    by: Sequence[str],
    value: str = "length",
    adjust: float = 1.0,
    panel: Sequence[str] = (),
) -> DataFrame:
    return kernel_density(df, list(by), value, adjust, panel=panel)
