"""The three ways the analyses are run end to end.

Each returns its tables by name as functions that build them, so that a
caller pays for the tables it asks for; ``write_all`` writes every one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulframe.operators.stats import (
    boxplot,
    histogram,
    kernel_density,
    ks_test,
    welch_test,
)
from haulframe.operators.ordered import ecdf
from haulframe.plans import landings as L
from haulframe.plans import survey as S
from haulframe.plans import synthesis as Y
from haulframe.plans.codes import GearCodes
from haulframe.sources.scratch import materialize
from haulframe.sources.sinks import write_csv

Tables = dict[str, Callable[[], DataFrame]]


def survey_year(
    catch: DataFrame,
    lengths: DataFrame,
    stations: DataFrame,
    year: int,
    codes: GearCodes,
    fish_group: str = "gear",
    fish_levels: tuple[str, str] | None = None,
    gear_names: dict | None = None,
    station_names: dict | None = None,
) -> Tables:
    """All tables of one survey year.

    ``catch`` and ``lengths`` are decoded rows, ``stations`` has one row per
    station and gear with ``date`` and times.  Intermediate tables used by
    many results are written once.  ``gear_names`` and ``station_names`` map the
    year's names to those of the clean tables.
    """
    tally = S.tally_events(catch, codes)
    sized = materialize(S.label_pot_size(tally, codes))
    facts = materialize(S.unit_facts(catch, codes))
    rates = S.rates_of(facts, codes)
    depths = materialize(S.depths_of(facts))
    deep = materialize(S.assign_depth(rates, depths))
    fish = materialize(S.parse_lengths(lengths))
    target = fish.filter(F.col("species") == codes.target)
    split = S.split_mixed(fish, sized)
    parts = materialize(S.split_rows(split))
    gears = [codes.hooks, codes.pots]
    x, y = fish_levels or (codes.pots, codes.hooks)
    dates = stations.groupBy("station").agg(F.min("date").alias("date"))
    out = {
        "station_table": lambda: S.station_table(stations, catch),
        "units_omitted": lambda: S.omitted_units(tally, codes),
        "detailed_rates": lambda: rates,
        "rate_summary": lambda: S.rate_summary(rates),
        "rate_boxes": lambda: boxplot(rates, ["station", "detailed_gear"], "n_target"),
        "rate_ecdf": lambda: ecdf(rates, ["detailed_gear"], "n_target"),
        "rates_by_depth": lambda: deep,
        "depth_totals": lambda: S.depth_totals(deep, codes),
        "depth_correlation_by_station": lambda: S.depth_correlation(deep, tuple(gears)),
        "depth_correlation": lambda: S.depth_correlation(deep, tuple(gears), by=[]),
        "mixed_split": lambda: split,
        "sample_sizes": lambda: S.sample_sizes(fish, sized, parts, gears),
        "species_composition": lambda: S.species_composition(sized, parts, codes.not_fish),
        "length_summary": lambda: S.length_summary(target, ["gear", "station", "sex"]),
        "length_ks": lambda: ks_test(target, fish_group, "length", x, y),
        "length_welch": lambda: welch_test(target, fish_group, "length", x, y),
        "length_density": lambda: kernel_density(
            target, ["station", "gear"], "length", 1.5, panel=["station"]
        ),
        "length_ecdf": lambda: ecdf(target, ["station", "sex", "gear"], "length"),
        "length_histogram": lambda: histogram(
            target, ["station", "sex", "gear"], "length", panel=["station", "sex"],
            mirrored=F.col("gear") == codes.pots,
        ),
        "sex_ratio": lambda: S.sex_ratio(target, ["station", "gear"]),
        "sex_length_table": lambda: S.sex_length_table(target),
        "equivalence": lambda: S.equivalence_labels(
            S.equivalence_spacing(rates, codes.hooks, codes.pots)
        ),
        "clean_lengths": lambda: S.in_standard_order(S.standard_lengths(
            fish, dates, year, codes, gears=gear_names, stations=station_names
        )),
        "clean_catch": lambda: S.in_standard_order(S.standard_catch(
            sized, depths, dates, year, codes, gears=gear_names, stations=station_names
        )),
        "ineffective_units": lambda: S.ineffective_units(tally, codes),
        "lengths_with_stats": lambda: S.length_rows_with_stats(
            target.filter("length is not null"), ["station", "gear"]
        ),
        "species_density": lambda: kernel_density(
            fish.filter("length is not null"), ["species", "gear"], "length", 1.5,
            panel=["species"],
        ),
    }
    if codes.large_marker:
        out["pot_counts"] = lambda: S.pot_counts(sized, codes)
        out["totals_by_size"] = lambda: S.totals_by_size(fish, sized, codes.target)
        out["size_welch_rates"] = lambda: welch_test(
            rates, "pot_size", "n_target", "Small", "Large"
        )
        out["size_welch_lengths"] = lambda: welch_test(
            target, "pot_size", "length", "Small", "Large"
        )
        out["size_ks_lengths"] = lambda: ks_test(
            target, "pot_size", "length", "Small", "Large"
        )
        out["lengths_with_size_stats"] = lambda: S.length_rows_with_stats(
            target.filter("length is not null and pot_size is not null"), ["gear", "pot_size"]
        )
    return out


def synthesis(
    rates: dict[int, DataFrame],
    lengths: dict[int, DataFrame],
    gears: dict[str, str],
    stations: dict[str, int],
    target: str,
    pair: tuple[str, str],
) -> Tables:
    """Comparisons over the years, from each year's rates and clean lengths."""
    all_rates = materialize(Y.harmonise(Y.union_years(rates), gears, stations))
    fish = materialize(
        Y.harmonise(Y.union_years(lengths), gears, stations).filter(
            F.col("species") == target
        )
    )
    facets: list[Sequence[str]] = [
        ["gear"],
        ["gear", "year"],
        ["gear", "year", "station"],
        ["gear", "stratum"],
        ["gear", "year", "stratum"],
        ["gear", "stratum", "station"],
        ["gear", "station", "sex"],
    ]
    # all facets from the same two passes
    medians = materialize(Y.medians_by_facets(fish, facets))
    out: Tables = {"median_length": lambda: medians}
    for by in facets:
        name = "_".join(by)
        out[f"median_length_{name}"] = partial(
            lambda by, name: medians.filter(F.col("facet") == name).select(*by, "median"), by, name)
        out[f"density_length_{name}"] = partial(Y.densities_by, fish, by)
    for by in (["gear"], ["station", "gear"], ["station", "gear", "year"]):
        out["sex_ratio_" + "_".join(by)] = partial(Y.sex_ratio, fish, by)
    for by in (["gear", "station"], ["gear", "year", "station"]):
        out["rate_boxes_" + "_".join(by)] = partial(Y.boxes_by, all_rates, by)
    for by in (["year", "station"], ["year"], []):
        name = "_".join(["depth_correlation", *by])
        out[name] = partial(Y.depth_correlation, all_rates, pair, by)
    return out


def landings_report(
    landings: DataFrame,
    tickets: DataFrame,
    years: tuple[int, int] = (2015, 2022),
    known_years: Sequence[int] = (2021, 2022),
    since: date = date(2021, 9, 25),
    gears: Sequence[str] | None = None,
    kinds: Sequence[str] | None = None,
    weekly_year: int = 2021,
    hauls: DataFrame | None = None,
) -> Tables:
    """All landings tables.  The extract is written once, never collected.

    Without ``gears`` the vessel matrix has every gear class of the data.  ``hauls``
    are monitored hauls, counted if given.
    """
    extract = materialize(
        L.landings_extract(landings, tickets, years=years, kinds=kinds)
    )
    known = L.known_vessel_gear(extract, known_years)
    attributed = materialize(L.attribute_gear(extract, known_years))
    monitored = {} if hauls is None else {
        "monitoring_counts": lambda: L.monitoring_counts(hauls)
    }
    return monitored | {
        "extract": lambda: extract,
        "too_few": lambda: L.confidentiality_screen(extract),
        "share_by_gear": lambda: L.share_by_gear(extract),
        "weekly_catch": lambda: L.weekly_catch(extract, weekly_year),
        "ambiguous_vessels": lambda: L.vessel_gear_matrix(
            extract, L.several_gears(known), since, gears
        ),
        "unresolved": lambda: L.unresolved(attributed),
        "summary": lambda: L.landings_summary(attributed),
        "unidentified_vessels": lambda: L.unidentified_vessels(attributed),
    }


def write_all(tables: Tables, folder: str) -> None:
    """Write every table as CSV into its own sub-folder."""
    for name, build in tables.items():
        write_csv(build(), f"{folder}/{name}")
