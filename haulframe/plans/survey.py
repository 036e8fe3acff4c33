"""Yearly gear-comparison analyses.

Canonical columns: ``gear, station, haul, skate`` name one unit of gear (a
skate of hooks or a pot), ``species`` the decoded event, ``depredation`` the
0/1 flag, ``depth`` the recorded depth (0 when not recorded), ``row_seq`` the
order of recording.  Measured fish carry ``gear, station, haul, stratum,
species, length``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulframe.functions.nulls import (
    case_na,
    distinct_with_null,
    if_else_na,
    is_member,
    not_member,
    recode,
    safe_ratio,
)
from haulframe.functions.text import (
    big_int,
    clock_hours,
    cylinder_volume,
    fixed,
    floor_to,
    join_text,
    leading_letters,
    trailing_number,
)
from haulframe.operators.aggregate import (
    count_where,
    cv,
    group_counts,
    std_error,
    with_subtotals,
)
from haulframe.operators.joins import (
    attach,
    bind_by_key,
    exclude,
    full_outer,
    null_safe_join,
    union_all,
)
from haulframe.operators.ordered import interpolate
from haulframe.operators.ranking import arrange, rank_by_median
from haulframe.operators.reshape import pivot_longer, pivot_wider
from haulframe.operators.stats import bar_totals, profile_correlation
from haulframe.operators.window import attach_group_stats, group_share
from haulframe.plans.codes import (
    ALL_SETS,
    AVERAGE,
    HOOK_AND_LINE,
    HOOKS,
    LARGE_POTS,
    METRES_PER_FATHOM,
    METRES_PER_INCH,
    MIXED_LABEL,
    MIXED_PARTS,
    NONE_MEASURED_OR_CAUGHT,
    NOT_CATCH,
    POT_SIZES_INCHES,
    SEX_LABELS,
    SEXED_SPECIES,
    SMALL_POTS,
    STRATA,
    STUCK,
    GearCodes,
)

UNIT = ["station", "haul", "skate"]
#: Order of the tables shared by all years, which a sink applies.
STANDARD_ORDER = ["date", "station", "haul"]


def decode(
    rows: DataFrame, species: DataFrame, code: str, stations: dict | None = None
) -> DataFrame:
    """Add the species name from its code table and relabel stations."""
    named = species.filter(F.col(code).isNotNull())
    out = attach(rows, named, [code], unique=True)
    if stations:
        out = out.withColumn("station", recode("station", stations))
    return out


def pot_dimensions(spark) -> DataFrame:
    """Pot volume by size, from the gear dimensions."""
    rows = [(s, d, h) for s, (d, h) in POT_SIZES_INCHES.items()]
    table = spark.createDataFrame(rows, "pot_size string, d_in double, h_in double")
    d, h = F.col("d_in") * METRES_PER_INCH, F.col("h_in") * METRES_PER_INCH
    return table.select(
        "pot_size", d.alias("diameter_m"), h.alias("height_m"),
        cylinder_volume(d, h).alias("volume_m3"),
    )


# -- tally -----------------------------------------------------------------


def tally_events(catch: DataFrame, codes: GearCodes) -> DataFrame:
    """Events per unit, species and flag, with reused codes read per gear.

    On pots the flag means a fish stuck in the escape ring, so it moves to its
    own column there.  Events without a species name stay, unless the codes
    say otherwise.
    """
    pots = F.col("gear") == codes.pots
    tally = catch.groupBy("gear", *UNIT, "species", "depredation").agg(
        F.count(F.lit(1)).alias("catch")
    )
    tally = tally.withColumn(
        "species",
        F.when(pots, recode("species", codes.relabel, keep_other=True)).otherwise(
            F.col("species")
        )
        if codes.relabel
        else F.col("species"),
    )
    zero = pots & is_member("species", codes.zeroed)
    tally = tally.withColumns(
        {
            "catch": F.when(zero, F.lit(0)).otherwise(F.col("catch")).cast("long"),
            "escape_ring": F.when(
                pots & (F.col("depredation") == 1), F.lit(STUCK)
            ),
        }
    ).withColumn(
        "depredation", if_else_na(pots, F.lit(None).cast("int"), F.col("depredation"))
    )
    if codes.dropped:
        lost = F.col("species").isin(codes.dropped)
        unnamed = F.lit(codes.drops_undecoded)
        tally = tally.filter(~F.coalesce(lost, unnamed))
    return tally


def label_pot_size(tally: DataFrame, codes: GearCodes) -> DataFrame:
    """Mark units holding the marker event as large pots; drop the marker rows.

    Without a marker all pots have the size that the codes name.
    """
    hooks = F.col("gear") == codes.hooks
    if not codes.large_marker:
        return tally.withColumn(
            "pot_size", case_na((hooks, F.lit(HOOKS)), (~hooks, F.lit(f"{codes.pot_size} pots")))
        )
    marker = (F.col("gear") == codes.pots) & (F.col("species") == codes.large_marker)
    marker = F.coalesce(marker, F.lit(codes.drops_undecoded) & (F.col("gear") == codes.pots))
    # a unit has a row per species in the tally: the window sees few
    unit = Window.partitionBy("gear", *UNIT)
    large = F.max(marker & F.col("species").isNotNull()).over(unit)
    flagged = tally.withColumn("__large", F.coalesce(large, F.lit(False)))
    return flagged.filter(~marker).withColumn(
        "pot_size",
        case_na(
            (F.col("__large"), F.lit(LARGE_POTS)),
            (hooks, F.lit(HOOKS)),
            (~hooks, F.lit(SMALL_POTS)),
        ),
    ).drop("__large")


def pot_counts(tally: DataFrame, codes: GearCodes) -> DataFrame:
    """Pots fished per station and size."""
    counts = (
        tally.filter(F.col("gear") == codes.pots)
        .groupBy("gear", "station", "pot_size")
        .agg(distinct_with_null("skate").cast("long").alias("npots"))
    )
    return pivot_wider(
        counts, ["station", "gear"], "pot_size", "npots", [LARGE_POTS, SMALL_POTS]
    )


def soak_hours(start: Column, end: Column, as_written: bool = False) -> Column:
    """Hours between two HHMM integers; ``as_written`` divides their
    difference by 100."""
    if as_written:
        return F.round((end - start) / 100, 1)
    return F.round(clock_hours(end) - clock_hours(start), 1)


def effort_by_station(catch: DataFrame) -> DataFrame:
    """Units fished and recorded depth range per station and gear."""
    deep = F.when(F.col("depth") > 0, F.col("depth"))
    return catch.groupBy("station", "gear").agg(
        distinct_with_null("skate").cast("long").alias("units_fished"),
        F.min(deep).alias("min_depth"),
        F.max(deep).alias("max_depth"),
    )


def station_table(
    stations: DataFrame, catch: DataFrame, as_written: bool = False
) -> DataFrame:
    """Station facts with soak time, joined to effort by (station, gear)."""
    facts = stations.withColumn(
        "soak_hours", soak_hours(F.col("start_time"), F.col("end_time"), as_written)
    )
    return bind_by_key(facts, effort_by_station(catch), ["station", "gear"])


# -- catch rates -----------------------------------------------------------


def unit_id() -> Column:
    return join_text("_", *UNIT, show_na=True)


def omitted_units(tally: DataFrame, codes: GearCodes) -> DataFrame:
    """Units left out of the rates, with the reason."""
    return (
        tally.filter(
            (F.col("gear") == codes.pots)
            & is_member("species", codes.omitting)
        )
        .select(
            *UNIT, unit_id().alias("skate_id"),
            recode("species", codes.omitting).alias("reason"),
        )
        .distinct()
    )


def unit_facts(catch: DataFrame, codes: GearCodes) -> DataFrame:
    """Everything the rates and depths need of each unit, in one pass.

    The events are shuffled once, as one partial row per unit and task.
    """
    pots = F.col("gear") == codes.pots
    source = {r.label: r.source for r in codes.rules}
    omitting = [source[label] for label in codes.omitting]
    no_effort = [source[label] for label in codes.dropped]
    large = (
        pots & (F.col("species") == codes.large_marker)
        if codes.large_marker
        else F.lit(False)
    )
    aggs = [
        count_where(~(pots & is_member("species", no_effort))).alias("n_effort"),
        count_where(F.col("species") == codes.target).alias("n_target"),
        F.max(F.coalesce(large, F.lit(False))).alias("is_large"),
        F.max(pots & is_member("species", omitting)).alias("is_omitted"),
    ]
    if "depth" in catch.columns:
        deep = F.when(F.col("depth") > 0, F.col("depth").cast("double"))
        aggs += [
            F.max(deep).alias("recorded_depth"),
            F.min("row_seq").alias("first_seen"),
        ]
    return catch.groupBy("gear", *UNIT).agg(*aggs)


def rates_of(
    facts: DataFrame, codes: GearCodes, omitted: DataFrame | None = None
) -> DataFrame:
    """Target count per unit of the units that count as effort."""
    rates = facts.filter(
        (F.col("n_effort") > 0) & ~F.coalesce(F.col("is_omitted"), F.lit(False))
    )
    if omitted is not None:
        rates = exclude(rates, omitted, UNIT)
    size = F.when(
        F.col("gear") == codes.pots,
        F.when(F.col("is_large"), F.lit("Large")).otherwise(F.lit("Small")),
    )
    return rates.select(
        "gear", *UNIT, "n_target", unit_id().alias("skate_id"), size.alias("pot_size")
    ).withColumn(
        "detailed_gear",
        F.when(F.col("pot_size").isNull(), F.lit(HOOK_AND_LINE)).otherwise(
            F.concat("pot_size", F.lit(" pots"))
        ),
    )


def catch_rates(
    catch: DataFrame, codes: GearCodes, omitted: DataFrame | None = None
) -> DataFrame:
    """Target count per unit; units without a target stay, with zero.

    Units holding an omitting event and rows that are no effort are decided in
    the same aggregate.  ``omitted`` lists further units to leave out.
    """
    return rates_of(unit_facts(catch, codes), codes, omitted)


def rates_with_depth(
    catch: DataFrame, codes: GearCodes, step: float = 25
) -> DataFrame:
    """Rates with binned depth, both from the facts of each unit."""
    facts = unit_facts(catch, codes)
    return assign_depth(rates_of(facts, codes), depths_of(facts), step)


def rate_summary(
    rates: DataFrame,
    value: str = "n_target",
    outer: Sequence[str] = ("gear",),
    inner: str = "station",
    digits: int | None = 1,
) -> DataFrame:
    """Mean and coefficient of variation per station, and over all stations."""
    rounded = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    return with_subtotals(
        rates,
        outer,
        inner,
        ALL_SETS,
        {
            "mean_catch_rate": rounded(F.avg(value)),
            "cv_catch_rate": rounded(cv(value)),
        },
    )


def ineffective_units(
    tally: DataFrame, codes: GearCodes, more_than: int = 15, pattern: str = "Ineffective"
) -> DataFrame:
    """Hook units with more than the given number of ineffective hooks."""
    return tally.filter(
        (F.col("gear") == codes.hooks)
        & F.col("species").rlike(pattern)
        & (F.col("catch") > more_than)
    )


# -- depth -----------------------------------------------------------------


def _fill_depths(units: DataFrame) -> DataFrame:
    return interpolate(
        units, ["station", "haul"], ["first_seen"], "recorded_depth", "interp_depth"
    ).drop("first_seen")


def depths_of(facts: DataFrame) -> DataFrame:
    """Depth of each unit from the unit facts, gaps filled along its haul."""
    units = facts.groupBy(*UNIT).agg(
        F.max("recorded_depth").alias("recorded_depth"),
        F.min("first_seen").alias("first_seen"),
    )
    return _fill_depths(units)


def unit_depths(catch: DataFrame, fanout: bool = False) -> DataFrame:
    """Depth of each unit, gaps filled along its haul in order of recording.

    A unit's depth is its deepest record.  ``fanout`` keeps one row per
    recorded depth instead, which repeats units in later joins.
    """
    deep = F.when(F.col("depth") > 0, F.col("depth").cast("double"))
    units = catch.groupBy(*UNIT, *(["depth"] if fanout else [])).agg(
        F.max(deep).alias("recorded_depth"), F.min("row_seq").alias("first_seen")
    )
    return _fill_depths(units.drop("depth"))


def assign_depth(
    rates: DataFrame, depths: DataFrame, step: float = 25
) -> DataFrame:
    """Rates with their unit's depth, floored to a bin."""
    return null_safe_join(rates, depths, UNIT).withColumn(
        "depth", floor_to("interp_depth", step)
    )


def depth_totals(
    rates: DataFrame, codes: GearCodes | None = None, value: str = "n_target"
) -> DataFrame:
    """Totals per gear, station and depth bin; pots downwards when asked."""
    mirrored = None if codes is None else F.col("gear") == codes.pots
    return bar_totals(rates, ["gear", "station", "depth"], value, mirrored, value)


def depth_correlation(
    rates: DataFrame,
    gears: tuple[str, str],
    by: Sequence[str] = ("station",),
    value: str = "n_target",
) -> DataFrame:
    """Correlation of the gears' standardised depth profiles."""
    return profile_correlation(rates, "gear", gears, ["depth"], list(by), value)


# -- composition -----------------------------------------------------------


def split_mixed(
    lengths: DataFrame,
    tally: DataFrame,
    parts: Sequence[str] = MIXED_PARTS,
    mixed: str = MIXED_LABEL,
) -> DataFrame:
    """The combined catch of each haul divided by its measured fish.

    A part gets the whole number of its measured share of the catch; what is left,
    all of it where no fish was measured, stays under the mixed label, so that parts
    and rest add up to the catch.  ``reconciles`` is 1 where the measured fish are
    the whole catch.  A haul with measured fish but no combined catch keeps the
    measured numbers, with ``catch`` NULL.
    """
    keys = ["gear", "station", "haul"]
    measured = group_counts(
        lengths.filter(F.col("species").isin(*parts)), [*keys, "species"], "nlen"
    )
    wide = pivot_wider(measured, keys, "species", "nlen", parts, fill=0)
    caught = (
        tally.filter(F.col("species") == mixed)
        .groupBy(*keys)
        .agg(F.sum("catch").alias("catch"))
    )
    both = full_outer(wide, caught, keys).fillna(0, subset=list(parts))
    total = sum((F.col(f"`{p}`") for p in parts[1:]), F.col(f"`{parts[0]}`"))
    share = {
        p: F.when(F.col("catch").isNull(), F.col(f"`{p}`"))
        .when(F.col("__total") == 0, F.lit(0).cast("long"))
        .otherwise(F.floor(F.col("catch") * F.col(f"`{p}`") / F.col("__total")))
        for p in parts
    }
    divided = both.withColumn("__total", total).select(
        *keys, *[c.cast("long").alias(p) for p, c in share.items()], "catch",
        F.coalesce(F.col("__total") == F.col("catch"), F.lit(False)).cast("int").alias("reconciles"),
    )
    return divided.withColumn(mixed, F.coalesce(F.col("catch") - total, F.lit(0)))


def split_rows(
    split: DataFrame, parts: Sequence[str] = MIXED_PARTS, mixed: str = MIXED_LABEL
) -> DataFrame:
    """The split as tally rows, one per part, and one for a rest that is not divided."""
    kept = split.select("gear", "station", "haul", *[F.col(f"`{p}`") for p in [*parts, mixed]])
    rows = pivot_longer(kept, [*parts, mixed], "species", "catch")
    return rows.filter((F.col("species") != mixed) | (F.col("catch") > 0))


def sample_sizes(
    lengths: DataFrame,
    tally: DataFrame,
    split: DataFrame,
    gears: Sequence[str],
    mixed: str = MIXED_LABEL,
    not_catch: Sequence[str] = NOT_CATCH,
) -> DataFrame:
    """Measured / caught per station, species and gear as ``1,174 / 1,267``."""
    keys = ["gear", "station", "species"]
    both = full_outer(
        group_counts(lengths, keys, "n_lengths"),
        union_all(tally.filter(not_member("species", [mixed])), split)
        .groupBy(*keys)
        .agg(F.sum("catch").alias("n_catch")),
        keys,
    ).filter(not_member("species", not_catch))
    both = both.fillna(0, subset=["n_lengths", "n_catch"])
    label = F.concat(big_int("n_lengths"), F.lit(" / "), big_int("n_catch"))
    # one row per gear: the window sees few
    most = F.max("n_lengths").over(Window.partitionBy("station", "species"))
    wide = pivot_wider(
        both.withColumns({"n": label, "__most": most}), ["station", "species", "__most"],
        "gear", "n", gears, fill=NONE_MEASURED_OR_CAUGHT,
    )
    return wide.orderBy("station", F.desc("__most"), "species").drop("__most")


def totals_by_size(
    lengths: DataFrame, tally: DataFrame, target: str
) -> DataFrame:
    """Measured and caught target fish per gear and pot size."""
    keys = ["gear", "pot_size"]
    measured = group_counts(
        lengths.filter(F.col("species") == target), keys, "n_lengths"
    )
    caught = (
        tally.filter(F.col("species") == target)
        .withColumn(
            "pot_size",
            F.when(
                F.col("pot_size") != HOOKS,
                F.regexp_replace("pot_size", " pots$", ""),
            ),
        )
        .groupBy(*keys)
        .agg(F.sum("catch").alias("n_catch"))
    )
    return bind_by_key(measured, caught, keys)


def species_composition(
    tally: DataFrame,
    split: DataFrame | None = None,
    not_fish: Sequence[str] = (),
    by: Sequence[str] = ("gear", "station"),
    mixed: str = MIXED_LABEL,
) -> DataFrame:
    """Count, share and display rank (by median share) of each species.

    With a ``split`` its rows, also an undivided rest, stand for the mixed catch.
    """
    rows = tally.filter(not_member("species", not_fish))
    if split is not None:
        fish = [s for s in not_fish if s != mixed]
        rows = union_all(
            rows.filter(not_member("species", [mixed])),
            split.filter(not_member("species", fish)),
        )
    counts = (
        rows
        .groupBy(*by, "species")
        .agg(F.sum("catch").alias("n"))
    )
    # a table of results: one row per species and group
    shares = group_share(counts, list(by), aggregated=True)
    ranks = rank_by_median(shares, "species", "prop", "species_rank", aggregated=True)
    return null_safe_join(shares, ranks.drop("median"), ["species"])


# -- lengths ---------------------------------------------------------------


def parse_lengths(lengths: DataFrame, code: str = "length") -> DataFrame:
    """Split the packed code into sex letter and length in cm."""
    return lengths.withColumn("sex", leading_letters(code)).withColumn(
        "length", trailing_number(code)
    )


def length_summary(
    lengths: DataFrame, keys: Sequence[str], digits: int = 1
) -> DataFrame:
    """Mean, SD, n and a text label per group."""
    stats = lengths.groupBy(*keys).agg(
        F.round(F.avg("length"), digits).alias("mean"),
        F.round(F.stddev_samp("length"), digits).alias("SD"),
        F.count(F.lit(1)).alias("n"),
    )
    label = F.concat(
        join_text(" ", *keys, show_na=True),
        F.lit(", n="), F.col("n").cast("string"),
        F.lit(", mean="), fixed("mean", digits),
        F.lit(" cm, SD="), fixed("SD", digits),
    )
    return stats.withColumn("label", label)


def length_rows_with_stats(
    lengths: DataFrame, keys: Sequence[str], seq: str = "row_seq"
) -> DataFrame:
    """Every fish with mode, mean, median, sd and n of its group."""
    return attach_group_stats(lengths, keys, "length", seq)


def sex_ratio(lengths: DataFrame, by: Sequence[str]) -> DataFrame:
    """Count and share of each sex within the groups."""
    counts = group_counts(lengths, [*by, "sex"])
    return group_share(counts, list(by), "n", "sex_ratio", aggregated=True)


def sex_length_table(
    lengths: DataFrame, by: Sequence[str] = ("station", "gear"), female: str = "F"
) -> DataFrame:
    """N, share of females and mean (SE) length as report text, one pass."""
    stats = (
        lengths.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            count_where(F.col("sex") == female).alias("n_f"),
            F.avg("length").alias("mean_length"),
            std_error("length").alias("se_length"),
        )
    )
    return stats.select(
        *by,
        big_int("n").alias("N"),
        fixed(F.col("n_f") / F.col("n"), 2).alias("proportion_female"),
        F.concat(
            fixed("mean_length", 1), F.lit(" ("), fixed("se_length", 2), F.lit(")")
        ).alias("mean_se_length_cm"),
    )


# -- equivalence -----------------------------------------------------------


def equivalence_spacing(
    rates: DataFrame,
    hooks: str,
    pots: str,
    value: str = "n_target",
    n_skates: int = 90,
    skate_space: float = 100.0,
) -> DataFrame:
    """Pots equal to one set of hooks, and their spacing in metres and fathoms."""
    means = with_subtotals(
        rates, ["gear"], "station", AVERAGE, {"mean_rate": F.avg(value)}
    )
    wide = pivot_wider(means, ["station"], "gear", "mean_rate", [hooks, pots])
    hook, pot = F.col(f"`{hooks}`"), F.col(f"`{pots}`")
    ratio = safe_ratio(hook, pot)
    n_pots = ratio * n_skates
    spacing = safe_ratio(F.lit(skate_space * n_skates), n_pots)
    return wide.select(
        "station",
        hook.alias("hook_rate"),
        pot.alias("pot_rate"),
        ratio.alias("rate_ratio"),
        n_pots.alias("equivalent_pots"),
        spacing.alias("spacing_m"),
        (spacing / METRES_PER_FATHOM).alias("spacing_fm"),
    )


def equivalence_labels(spacing: DataFrame) -> DataFrame:
    """The spacing table as report text."""
    return spacing.select(
        "station",
        *[fixed(c, 1).alias(c) for c in ("hook_rate", "pot_rate", "rate_ratio")],
        *[
            fixed(c, 0).alias(c)
            for c in ("equivalent_pots", "spacing_m", "spacing_fm")
        ],
    )


# -- standard output -------------------------------------------------------


def _ring(codes: GearCodes) -> Column:
    return F.when(F.col("gear") == codes.pots, recode("pot_size", codes.rings))


def _relabelled(rows: DataFrame, gears: dict | None, stations: dict | None) -> DataFrame:
    """Names shared by all years."""
    if gears:
        rows = rows.withColumn("gear", recode("gear", gears, keep_other=True))
    if stations:
        rows = rows.withColumn("station", recode("station", stations))
    return rows


def in_standard_order(rows: DataFrame) -> DataFrame:
    """A shared table by date, station and haul, for the file that it goes to."""
    return arrange(rows, STANDARD_ORDER)


def standard_lengths(
    lengths: DataFrame,
    dates: DataFrame,
    year: int,
    codes: GearCodes,
    sexed: Sequence[str] = SEXED_SPECIES,
    gears: dict | None = None,
    stations: dict | None = None,
) -> DataFrame:
    """Lengths in the layout shared by all years; ``in_standard_order`` sorts them.

    ``dates`` holds one (station, date) row per station.  Where no marker tells pots
    apart, all have the size of the codes.  ``gears`` and ``stations`` map the
    year's names to the shared ones.
    """
    rows = lengths
    if not codes.large_marker:
        size = F.when(F.col("gear") == codes.pots, F.lit(codes.pot_size))
        rows = rows.withColumn("pot_size", size)
    elif "pot_size" not in rows.columns:
        rows = rows.withColumn("pot_size", F.lit(None).cast("string"))
    sex = F.when(is_member("species", sexed), F.col("sex")).otherwise(F.lit("U"))
    out = (
        attach(rows, dates, ["station"], unique=True)
        .withColumns(
            {
                "year": F.lit(year),
                "stratum": recode("stratum", STRATA),
                "sex": recode(sex, SEX_LABELS),
                "escape_ring": _ring(codes),
            }
        )
        .select(
            "year", "date", "gear", "station", "haul", "stratum", "species",
            "sex", "length", "pot_size", "escape_ring",
        )
    )
    return _relabelled(out, gears, stations)


def standard_catch(
    tally: DataFrame,
    depths: DataFrame,
    dates: DataFrame,
    year: int,
    codes: GearCodes,
    gears: dict | None = None,
    stations: dict | None = None,
) -> DataFrame:
    """Tally with unit depth in the layout shared by all years, as ``standard_lengths``."""
    deep = depths.select(*UNIT, F.col("interp_depth").alias("depth"))
    size = F.when(
        F.col("pot_size") != HOOKS, F.regexp_replace("pot_size", " pots$", "")
    )
    rows = attach(null_safe_join(tally, deep, UNIT), dates, ["station"], unique=True)
    out = (
        rows.withColumn("pot_size", size)
        .withColumn("escape_ring_notes", F.col("escape_ring"))
        .withColumn("escape_ring", _ring(codes))
        .select(
            F.lit(year).alias("year"), "date", "gear", "station", "haul",
            F.col("skate").alias("skate_or_pot"), "depth", "species", "catch",
            "depredation", "pot_size", "escape_ring", "escape_ring_notes",
        )
    )
    return _relabelled(out, gears, stations)
