"""Commercial landings: extract, gear attribution, screening, summaries."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulframe.functions.nulls import (
    case_na,
    distinct_with_null,
    not_member,
)
from haulframe.operators.aggregate import group_counts, screen
from haulframe.operators.joins import attach, lookup, restrict
from haulframe.operators.ranking import fixed_rank
from haulframe.operators.reshape import pivot_wider
from haulframe.operators.rows import rename_all
from haulframe.operators.window import group_share, group_shares
from haulframe.plans.codes import (
    LANDED_SPECIES,
    MIXED_POT,
    POT_CLASS_PREFIX,
    PROGRAMS,
    SUBAREAS,
    UNKNOWN_POT,
    UNUSED_GEARS,
)

MODIFIER = "gear_modifier_description"
SOURCE = "catch_report_source_pk"


def gear_class(kinds: Sequence[str] | None = None) -> Column:
    """Gear class: hooks, trawl, or pots by the first word of their modifier.

    ``kinds`` limits the pot modifiers that are recognised.
    """
    pots = F.col("fmp_gear") == "POT"
    modifier = F.col(MODIFIER)
    known = modifier.isNotNull() if kinds is None else modifier.isin(*kinds)
    kind = F.concat(
        F.lit(POT_CLASS_PREFIX), F.upper(F.substring_index(modifier, " ", 1))
    )
    return case_na(
        (F.col("fmp_gear").isin("HAL", "TRW"), F.col("fmp_gear")),
        (pots & known, kind),
        (pots & modifier.isNull(), F.lit(UNKNOWN_POT)),
    )


def landings_extract(
    landings: DataFrame,
    tickets: DataFrame,
    years: tuple[int, int] = (2015, 2022),
    species: Sequence[str] = LANDED_SPECIES,
    areas: Sequence[str] = SUBAREAS,
    programs: Sequence[str] = PROGRAMS,
    unused: Sequence[str] = UNUSED_GEARS,
    kinds: Sequence[str] | None = None,
    aliases: dict[str, str] | None = None,
) -> DataFrame:
    """Selected landings with their gear modifier, class and area rank.

    ``aliases`` maps column names of the source (in lower case) to those used here.
    """
    wanted = rename_all(landings).withColumnsRenamed(aliases or {}).filter(
        F.col("species_code").isin(*species)
        & F.col("year").between(*years)
        & F.col("fmp_subarea").isin(*areas)
        & F.col("management_program_code").isin(*programs)
    )
    modifiers = rename_all(tickets).select(SOURCE, MODIFIER)
    return (
        lookup(wanted, modifiers, [SOURCE])
        .filter(not_member("fmp_gear", unused))
        .withColumns(
            {
                "week_end_date": F.to_date("week_end_date"),
                "gear": gear_class(kinds),
                "area_rank": fixed_rank("fmp_subarea", areas),
            }
        )
    )


def confidentiality_screen(
    landings: DataFrame,
    keys: Sequence[str] = ("year", "fmp_subarea"),
    at_most: int = 6,
    vessel: str = "vessel_id",
    trip: str = SOURCE,
    weight: str = "weight_posted",
) -> DataFrame:
    """Groups with too few vessels or trips to be shown."""
    return screen(
        landings,
        keys,
        {
            "nvessel": distinct_with_null(vessel).cast("long"),
            "ntrip": distinct_with_null(trip).cast("long"),
            "catch": F.sum(weight),
        },
        (F.col("nvessel") <= at_most) | (F.col("ntrip") <= at_most),
    )


def share_by_gear(
    landings: DataFrame,
    by: Sequence[str] = ("year", "fmp_subarea"),
    gear: str = "gear",
) -> DataFrame:
    """Catch and its share per gear within the groups."""
    sums = landings.groupBy(*by, gear).agg(F.sum("weight_posted").alias("catch"))
    return group_share(sums, list(by), "catch", "prop", aggregated=True)


def known_vessel_gear(
    landings: DataFrame, years: Sequence[int] = (2021, 2022), pots_only: bool = False
) -> DataFrame:
    """Gear classes each vessel reported with a modifier."""
    known = landings.filter(
        F.col("year").isin(*years) & F.col(MODIFIER).isNotNull()
    )
    if pots_only:
        known = known.filter(F.col("fmp_gear") == "POT")
    return known.select(
        "vessel_id", "fmp_gear", F.col("gear").alias("obsgear")
    ).distinct()


def several_gears(known: DataFrame) -> DataFrame:
    """Vessels that reported more than one gear class."""
    return group_counts(known, ["vessel_id"]).filter("n > 1").select("vessel_id")


def attribute_gear(
    landings: DataFrame, years: Sequence[int] = (2021, 2022), pots_only: bool = False
) -> DataFrame:
    """Give unreported pot landings the vessel's only known class, or mixed.

    One left join; landings that carry a modifier keep their own class.
    ``landings`` is read twice.
    """
    known = known_vessel_gear(landings, years, pots_only)
    # one row per vessel and class: the window sees few
    classes = F.count(F.lit(1)).over(Window.partitionBy("vessel_id"))
    observed = (
        known.withColumn("__n", classes)
        .withColumn(
            "obsgear",
            F.when(F.col("__n") > 1, F.lit(MIXED_POT)).otherwise(F.col("obsgear")),
        )
        .select("vessel_id", "fmp_gear", "obsgear")
        .distinct()
    )
    joined = attach(landings, observed, ["vessel_id", "fmp_gear"]).withColumn(
        "obsgear", F.when(F.col(MODIFIER).isNull(), F.col("obsgear"))
    )
    return joined.withColumn(
        "newgear",
        case_na(
            (F.col("fmp_gear") == "HAL", F.col("gear")),
            (F.col("fmp_gear") == "POT", F.coalesce("obsgear", "gear")),
        ),
    )


def unresolved(attributed: DataFrame) -> DataFrame:
    """Landings whose gear could not be decided; expected to be empty."""
    return attributed.filter(F.col("newgear").isNull())


def landings_summary(
    attributed: DataFrame, leave_out: Sequence[str] = ("BS", "AI")
) -> DataFrame:
    """Catch, landings and both shares per year, area and gear."""
    by = ["year", "fmp_subarea"]
    sums = (
        attributed.filter(not_member("fmp_subarea", leave_out))
        .groupBy(*by, F.col("newgear").alias("gear"))
        .agg(
            F.sum("weight_posted").alias("catch_mt"),
            distinct_with_null(SOURCE).cast("long").alias("number_of_landings"),
        )
    )
    return group_shares(
        sums,
        by,
        {
            "catch_mt": "proportion_catch",
            "number_of_landings": "proportion_landings",
        },
        aggregated=True,
    )


def vessel_gear_matrix(
    landings: DataFrame,
    vessels: DataFrame,
    since: date,
    gears: Sequence[str] | None = None,
) -> DataFrame:
    """Catch per gear of the listed vessels, one row per vessel.

    Without ``gears`` every gear class of these vessels gets a column; a class that a
    given list lacks is an error.
    """
    ids = ["vessel_id", "ves_akr_name", "ves_akr_length"]
    chosen = restrict(
        landings.filter(F.col("week_end_date") >= F.lit(since)), vessels, ["vessel_id"]
    )
    return pivot_wider(
        chosen, ids, "gear", "weight_posted", gears, 0.0, F.sum("weight_posted")
    ).orderBy(F.col("ves_akr_length").asc_nulls_last(), "vessel_id")


def weekly_catch(
    landings: DataFrame, year: int = 2021, fmp_gear: str = "POT"
) -> DataFrame:
    """Catch per week and gear modifier."""
    return (
        landings.filter((F.col("year") == year) & (F.col("fmp_gear") == fmp_gear))
        .groupBy("week_end_date", MODIFIER)
        .agg(F.sum("weight_posted").alias("catch"))
    )


def unidentified_vessels(attributed: DataFrame) -> DataFrame:
    """Vessels whose pots stayed of unknown class."""
    return (
        attributed.filter(F.col("newgear") == UNKNOWN_POT)
        .select("fmp_gear", "ves_akr_name", "ves_akr_length")
        .distinct()
    )


def monitoring_counts(
    hauls: DataFrame,
    after_year: int = 2017,
    keys: Sequence[str] = ("year", "fmp_area", "agency_gear_code", "em_gear_name"),
) -> DataFrame:
    """Records per year, area, gear and monitoring type, sorted."""
    return group_counts(hauls.filter(F.col("year") > after_year), keys).orderBy(
        *[F.col(k).asc_nulls_last() for k in keys]
    )
