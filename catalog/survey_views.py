"""The survey analyses on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as V
from catalog.tables import r, register
from haulframe.operators.joins import attach
from haulframe.operators.sketches import RANK_ERROR
from haulframe.plans import survey as S
from haulframe.plans import synthesis as Y
from haulframe.plans.codes import EventRule, GearCodes
from haulframe.sources.scratch import new_path

QUERIES: dict = {}

VISITS = GearCodes(
    target="purchase", rules=(EventRule("error", "Broken", omits_unit="broken"),)
)

VISIT_RATES_SQL = """
    WITH visits AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'POT' ELSE 'HAL' END AS gear,
                      CAST((day(ts) - 1) // 7 AS INTEGER) AS station,
                      CAST(day(ts) AS INTEGER) AS haul, user_id AS skate, event_type
                    FROM events),
         units AS (SELECT gear, station, haul, skate,
                     count(*) FILTER (event_type = 'purchase') AS n_target
                   FROM visits GROUP BY ALL
                   HAVING NOT (gear = 'POT' AND bool_or(event_type = 'error'))),
         kept AS (SELECT * FROM units WHERE (station, haul, skate) NOT IN
                    (SELECT (station, haul, skate) FROM visits WHERE event_type = 'signup'
                     AND skate % 5 = 0))
"""


def visits(t):
    return t.events.select(
        F.when(F.col("user_id") % 2 == 0, "POT").otherwise("HAL").alias("gear"),
        F.floor((F.dayofmonth("ts") - 1) / 7).cast("int").alias("station"),
        F.dayofmonth("ts").alias("haul"),
        F.col("user_id").alias("skate"),
        F.col("event_type").alias("species"),
    )


@register(QUERIES, VISIT_RATES_SQL + """
    SELECT gear, CASE WHEN grouping(station) = 1 THEN 'All_sets_combined'
                      ELSE CAST(station AS VARCHAR) END AS station,
      round(avg(n_target), 6) AS mean_catch_rate,
      round(stddev_samp(n_target) / avg(n_target), 6) AS cv_catch_rate
    FROM kept GROUP BY GROUPING SETS ((gear, station), (gear))
""")
def catch_rate_summary(t):
    rows = visits(t)
    omitted = rows.filter((F.col("species") == "signup") & (F.col("skate") % 5 == 0))
    return S.rate_summary(S.catch_rates(rows, VISITS, omitted), digits=6)


@register(QUERIES, f"""
    WITH {V.CATCH_SQL}
    SELECT gear, station, haul, skate, species, depredation, catch, escape_ring FROM tally
""")
def event_tally(t):
    return V.tally(t)


@register(QUERIES, f"""
    WITH {V.CATCH_SQL}
    SELECT gear, station, haul, skate, species, depredation, catch, escape_ring, pot_size
    FROM sized
""")
def pot_size_labels(t):
    return V.sized(t)


@register(QUERIES, f"""
    WITH {V.CATCH_SQL}
    SELECT station, gear, count(DISTINCT skate) FILTER (pot_size = 'Large pots') AS "Large pots",
      count(DISTINCT skate) FILTER (pot_size = 'Small pots') AS "Small pots"
    FROM sized WHERE gear = 'POT' GROUP BY ALL
""")
def pot_counts(t):
    return S.pot_counts(V.sized(t), V.CODES)


@register(QUERIES, f"""
    WITH {V.CATCH_SQL},
      e AS (SELECT station, gear, count(DISTINCT skate) AS units_fished,
              min(CASE WHEN depth > 0 THEN depth END) AS min_depth,
              max(CASE WHEN depth > 0 THEN depth END) AS max_depth
            FROM caught GROUP BY ALL),
      f AS (SELECT station, gear, CAST(500 + min(haul) AS BIGINT) AS start_time,
              CAST(1400 + max(haul) * 7 AS BIGINT) AS end_time FROM caught GROUP BY ALL)
    SELECT station, gear, start_time, end_time,
      round((end_time // 100 + end_time % 100 / 60.0)
            - (start_time // 100 + start_time % 100 / 60.0), 1) AS soak_hours,
      units_fished, min_depth, max_depth
    FROM e JOIN f USING (station, gear)
""")
def station_table(t):
    rows = V.catch(t)
    facts = rows.groupBy("station", "gear").agg(
        (500 + F.min("haul")).cast("long").alias("start_time"),
        (1400 + F.max("haul") * 7).cast("long").alias("end_time"),
    )
    return S.station_table(facts, rows)


@register(QUERIES, f"""
    WITH {V.CATCH_SQL}
    SELECT DISTINCT station, haul, skate, station || '_' || haul || '_' || skate AS skate_id,
      'door' AS reason
    FROM tally WHERE gear = 'POT' AND species = 'Trap door open'
""")
def omitted_units(t):
    return S.omitted_units(V.tally(t), V.CODES)


@register(QUERIES, f"""
    WITH {V.CATCH_SQL}
    SELECT gear, station, haul, skate, n_target, skate_id, pot_size,
      CASE WHEN pot_size IS NULL THEN 'Hook-and-line' ELSE pot_size || ' pots' END
        AS detailed_gear
    FROM rates
""")
def detailed_rates(t):
    return V.rates(t)


@register(QUERIES, f"""
    WITH {V.CATCH_SQL}
    SELECT station, haul, skate, recorded_depth, interp_depth
    FROM depths
""")
def unit_depths(t):
    return S.unit_depths(V.catch(t))


@register(QUERIES, f"""
    WITH {V.CATCH_SQL},
      seen AS (SELECT DISTINCT station, haul, skate, CAST(depth AS DOUBLE) AS depth FROM caught)
    SELECT rates.station, rates.haul, rates.skate, n_target, nullif(depth, 0) AS recorded_depth
    FROM rates LEFT JOIN seen USING (station, haul, skate)
""")
def rates_per_recorded_depth(t):
    """The join that repeats a unit for each of its recorded depths."""
    from haulframe.operators.joins import lookup

    depths = S.unit_depths(V.catch(t), fanout=True).drop("interp_depth")
    joined = lookup(V.rates(t), depths, S.UNIT)
    return joined.select(*S.UNIT, "n_target", "recorded_depth")


@register(QUERIES, f"""
    WITH {V.CATCH_SQL}
    SELECT gear, station, depth,
      CAST(CASE WHEN gear = 'POT' THEN -sum(n_target) ELSE sum(n_target) END AS BIGINT) AS n_target
    FROM deep GROUP BY gear, station, depth
""")
def depth_totals(t):
    return S.depth_totals(V.deep(t), V.CODES)


@register(QUERIES, f"""
    WITH {V.CATCH_SQL},
      s AS (SELECT gear, station, depth, sum(n_target) AS v FROM deep GROUP BY ALL),
      z AS (SELECT *, (v - avg(v) OVER w) / stddev_samp(v) OVER w AS std FROM s
            WINDOW w AS (PARTITION BY gear, station))
    SELECT a.station, round(corr(a.std, b.std), 6) AS cor
    FROM z a JOIN z b ON a.station = b.station AND a.depth IS NOT DISTINCT FROM b.depth
      AND a.gear = 'HAL' AND b.gear = 'POT' GROUP BY ALL
""")
def depth_correlation(t):
    return S.depth_correlation(V.deep(t), ("HAL", "POT")).withColumn("cor", r("cor"))


@register(QUERIES, f"""
    WITH {V.CATCH_SQL},
      s AS (SELECT gear, depth, sum(n_target) AS v FROM deep GROUP BY ALL),
      z AS (SELECT *, (v - avg(v) OVER w) / stddev_samp(v) OVER w AS std FROM s
            WINDOW w AS (PARTITION BY gear))
    SELECT round(corr(a.std, b.std), 6) AS cor
    FROM z a JOIN z b ON a.depth IS NOT DISTINCT FROM b.depth
      AND a.gear = 'HAL' AND b.gear = 'POT'
""")
def depth_correlation_overall(t):
    return S.depth_correlation(V.deep(t), ("HAL", "POT"), by=[]).withColumn("cor", r("cor"))


SPLIT_SQL = """
  split AS (SELECT gear, station, haul,
              count(*) FILTER (species = 'Rougheye Rockfish') AS a,
              count(*) FILTER (species = 'Shortraker Rockfish') AS b
            FROM fish WHERE species IN ('Rougheye Rockfish', 'Shortraker Rockfish')
            GROUP BY ALL),
  mixed AS (SELECT gear, station, haul, CAST(sum(catch) AS BIGINT) AS catch FROM tally
            WHERE species = 'Rougheye/Shortraker Rockfish' GROUP BY ALL),
  sides AS (SELECT gear, station, haul, coalesce(a, 0) AS a, coalesce(b, 0) AS b, catch
           FROM split FULL JOIN mixed USING (gear, station, haul)),
  divided AS (SELECT gear, station, haul, catch,
      CAST(coalesce(a + b = catch, false) AS INTEGER) AS reconciles,
      CASE WHEN catch IS NULL THEN a WHEN a + b = 0 THEN 0
           ELSE CAST(floor(catch * a / (a + b)) AS BIGINT) END AS a,
      CASE WHEN catch IS NULL THEN b WHEN a + b = 0 THEN 0
           ELSE CAST(floor(catch * b / (a + b)) AS BIGINT) END AS b
    FROM sides),
  parts AS (SELECT gear, station, haul, 'Rougheye Rockfish' AS species, a AS catch FROM divided
            UNION ALL SELECT gear, station, haul, 'Shortraker Rockfish', b FROM divided
            UNION ALL SELECT gear, station, haul, 'Rougheye/Shortraker Rockfish', catch - a - b
            FROM divided WHERE catch - a - b > 0)
"""


@register(QUERIES, f"""
    WITH {V.CATCH_SQL}, {V.LENGTH_SQL}, {SPLIT_SQL}
    SELECT gear, station, haul, a AS "Rougheye Rockfish", b AS "Shortraker Rockfish", catch,
      reconciles, coalesce(catch - a - b, 0) AS "Rougheye/Shortraker Rockfish"
    FROM divided
""")
def mixed_split(t):
    return S.split_mixed(V.fish(t), V.tally(t))


@register(QUERIES, f"""
    WITH {V.CATCH_SQL}, {V.LENGTH_SQL}, {SPLIT_SQL}
    SELECT gear, station, haul, species, catch FROM parts
""")
def mixed_split_rows(t):
    return S.split_rows(S.split_mixed(V.fish(t), V.tally(t)))


@register(QUERIES, f"""
    WITH {V.CATCH_SQL}, {V.LENGTH_SQL}, {SPLIT_SQL},
      l AS (SELECT gear, station, species, count(*) AS n_lengths FROM fish GROUP BY ALL),
      c AS (SELECT gear, station, species, CAST(sum(catch) AS BIGINT) AS n_catch
            FROM (SELECT gear, station, species, catch FROM tally
                  WHERE species <> 'Rougheye/Shortraker Rockfish'
                  UNION ALL SELECT gear, station, species, catch FROM parts)
            GROUP BY ALL),
      j AS (SELECT coalesce(l.gear, c.gear) AS gear, coalesce(l.station, c.station) AS station,
              coalesce(l.species, c.species) AS species,
              format('{{:,}}', coalesce(n_lengths, 0)) || ' / '
                || format('{{:,}}', coalesce(n_catch, 0)) AS n
            FROM l FULL JOIN c ON l.gear = c.gear AND l.station = c.station
              AND l.species = c.species)
    SELECT station, species,
      coalesce(max(n) FILTER (gear = 'HAL'), '0 / 0') AS "HAL",
      coalesce(max(n) FILTER (gear = 'POT'), '0 / 0') AS "POT"
    FROM j
    WHERE species NOT IN ('Baited Hook', 'Empty pot', 'Ineffective Hook', 'Trap door open')
    GROUP BY ALL
""")
def sample_sizes(t):
    fish, tally = V.fish(t), V.tally(t)
    split = S.split_rows(S.split_mixed(fish, tally))
    return S.sample_sizes(fish, tally, split, ["HAL", "POT"])


@register(QUERIES, f"""
    WITH {V.CATCH_SQL}, {V.LENGTH_SQL},
      l AS (SELECT gear, pot_size, count(*) AS n_lengths FROM fish
            WHERE species = 'Sablefish' GROUP BY ALL),
      c AS (SELECT gear, CASE WHEN pot_size <> 'Hooks' THEN replace(pot_size, ' pots', '') END
              AS pot_size, CAST(sum(catch) AS BIGINT) AS n_catch
            FROM sized WHERE species = 'Sablefish' GROUP BY ALL)
    SELECT l.gear, l.pot_size, n_lengths, n_catch
    FROM l JOIN c ON l.gear = c.gear AND l.pot_size IS NOT DISTINCT FROM c.pot_size
""")
def totals_by_size(t):
    return S.totals_by_size(V.fish(t), V.sized(t), "Sablefish")


@register(QUERIES, f"""
    WITH {V.CATCH_SQL}, {V.LENGTH_SQL}, {SPLIT_SQL},
      s AS (SELECT gear, station, species, CAST(sum(catch) AS BIGINT) AS n
            FROM (SELECT gear, station, species, catch FROM tally
                  WHERE species <> 'Rougheye/Shortraker Rockfish'
                  UNION ALL SELECT gear, station, species, catch FROM parts)
            WHERE species NOT IN ('Baited Hook', 'Ineffective Hook', 'Trap door open',
                                  'Empty pot', 'Brittle Starfish') GROUP BY ALL),
      p AS (SELECT *, n / sum(n) OVER (PARTITION BY gear, station) AS prop FROM s),
      m AS (SELECT species, round(quantile_cont(prop, 0.5), 12) AS median FROM p GROUP BY ALL),
      k AS (SELECT species, dense_rank() OVER (ORDER BY median DESC) AS species_rank FROM m)
    SELECT gear, station, species, n, round(prop, 8) AS prop, species_rank
    FROM p JOIN k USING (species)
""")
def species_composition(t):
    tally = V.tally(t)
    comp = S.species_composition(
        tally, S.split_rows(S.split_mixed(V.fish(t), tally)),
        not_fish=["Baited Hook", "Ineffective Hook", "Trap door open", "Empty pot",
                  "Brittle Starfish"],
    )
    return comp.withColumn("prop", r("prop", 8))


@register(QUERIES, f"""
    WITH {V.CATCH_SQL}
    SELECT gear, station, haul, skate, species, depredation, catch, escape_ring
    FROM tally WHERE gear = 'HAL' AND regexp_matches(species, 'Ineffective') AND catch > 1
""")
def ineffective_units(t):
    return S.ineffective_units(V.tally(t), V.CODES, more_than=1)


@register(QUERIES, """
    SELECT CAST(day(ts) AS INTEGER) AS day, user_id, count(*) AS n FROM events
    WHERE event_type = 'error' GROUP BY ALL HAVING count(*) > 1
""")
def repeated_errors(t):
    from haulframe.operators.aggregate import screen

    return screen(
        t.events.filter("event_type = 'error'").withColumn("day", F.dayofmonth("ts")),
        ["day", "user_id"], {"n": F.count(F.lit(1))}, F.col("n") > 1,
    )


@register(QUERIES, f"""
    WITH {V.LENGTH_SQL}
    SELECT gear, station, haul, stratum, species, sex, length, pot_size, row_seq, year FROM fish
""")
def parsed_lengths(t):
    return V.fish(t)


@register(QUERIES, f"""
    WITH {V.LENGTH_SQL}
    SELECT gear, sex, round(avg(length), 1) AS mean, round(stddev_samp(length), 1) AS "SD",
      count(*) AS n, gear || ' ' || coalesce(sex, 'NA') || ', n=' || count(*) || ', mean='
        || printf('%.1f', round(avg(length), 1)) || ' cm, SD='
        || printf('%.1f', round(stddev_samp(length), 1)) AS label
    FROM fish WHERE species = 'Sablefish' GROUP BY gear, sex
""")
def length_summary(t):
    return S.length_summary(V.fish(t).filter("species = 'Sablefish'"), ["gear", "sex"])


@register(QUERIES, f"""
    WITH {V.LENGTH_SQL},
      s AS (SELECT * FROM fish WHERE species = 'Sablefish'),
      c AS (SELECT pot_size, length, count(*) AS c, min(row_seq) AS f FROM s GROUP BY ALL),
      m AS (SELECT pot_size, arg_min(length, struct_pack(a := -c, b := f)) AS mode
            FROM c GROUP BY ALL),
      g AS (SELECT pot_size, count(*) AS n, round(avg(length), 6) AS mean,
              round(stddev_samp(length), 6) AS sd, quantile_cont(length, 0.5) AS median
            FROM s GROUP BY ALL)
    SELECT s.row_seq, s.pot_size, s.length, n, mean, sd, median, mode
    FROM s JOIN g ON s.pot_size IS NOT DISTINCT FROM g.pot_size
    JOIN m ON s.pot_size IS NOT DISTINCT FROM m.pot_size
""")
def lengths_with_group_stats(t):
    rows = V.fish(t).filter("species = 'Sablefish'").select("row_seq", "pot_size", "length")
    return S.length_rows_with_stats(rows, ["pot_size"]).withColumns(
        {"mean": r("mean"), "sd": r("sd")}
    )


@register(QUERIES, f"""
    WITH {V.LENGTH_SQL}
    SELECT station, gear, format('{{:,}}', count(*)) AS "N",
      printf('%.2f', round(count(*) FILTER (sex = 'F') / count(*), 2)) AS proportion_female,
      printf('%.1f', round(avg(length), 1)) || ' ('
        || printf('%.2f', round(stddev_samp(length) / sqrt(count(*)), 2)) || ')'
        AS mean_se_length_cm
    FROM fish WHERE species = 'Sablefish' GROUP BY station, gear
""")
def sex_length_table(t):
    return S.sex_length_table(V.fish(t).filter("species = 'Sablefish'"))


@register(QUERIES, f"""
    WITH {V.LENGTH_SQL}
    SELECT station, gear, year, sex, count(*) AS n,
      round(count(*) / sum(count(*)) OVER (PARTITION BY station, gear, year), 8) AS sex_ratio
    FROM fish GROUP BY station, gear, year, sex
""")
def sex_ratio(t):
    return S.sex_ratio(V.fish(t), ["station", "gear", "year"]).withColumn(
        "sex_ratio", r("sex_ratio", 8)
    )


SPACING_SQL = f"""
    WITH {V.CATCH_SQL},
      m AS (SELECT CASE WHEN grouping(station) = 1 THEN 'Average' ELSE station END AS station,
              gear, avg(n_target) AS rate
            FROM rates GROUP BY GROUPING SETS ((gear, station), (gear))),
      w AS (SELECT station, max(rate) FILTER (gear = 'HAL') AS h,
              max(rate) FILTER (gear = 'POT') AS p FROM m GROUP BY ALL)
"""


@register(QUERIES, SPACING_SQL + """
    SELECT station, round(h, 8) AS hook_rate, round(p, 8) AS pot_rate,
      round(h / p, 6) AS rate_ratio, round(h / p * 90, 6) AS equivalent_pots,
      round(9000 / (h / p * 90), 6) AS spacing_m,
      round(9000 / (h / p * 90) / 1.8288, 6) AS spacing_fm
    FROM w
""")
def equivalence_spacing(t):
    out = S.equivalence_spacing(V.rates(t), "HAL", "POT")
    digits = {"hook_rate": 8, "pot_rate": 8}
    return out.select(
        "station", *[r(c, digits.get(c, 6)).alias(c) for c in out.columns[1:]]
    )


@register(QUERIES, SPACING_SQL + """
    SELECT station, printf('%.1f', round(h, 1)) AS hook_rate,
      printf('%.1f', round(p, 1)) AS pot_rate, printf('%.1f', round(h / p, 1)) AS rate_ratio,
      printf('%.0f', round(h / p * 90)) AS equivalent_pots,
      printf('%.0f', round(9000 / (h / p * 90))) AS spacing_m,
      printf('%.0f', round(9000 / (h / p * 90) / 1.8288)) AS spacing_fm
    FROM w
""")
def equivalence_labels(t):
    return S.equivalence_labels(S.equivalence_spacing(V.rates(t), "HAL", "POT"))


DATES_SQL = """
  dates AS (SELECT CASE o_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS station,
              CAST(min(o_orderdate) AS DATE) AS date FROM orders GROUP BY 1)
"""


def station_dates(t):
    from haulframe.functions.nulls import recode

    return t.orders.groupBy(
        recode(F.col("o_custkey") % 3, {0: "A", 1: "N", 2: "R"}).alias("station")
    ).agg(F.min("o_orderdate").cast("date").alias("date"))


RING_SQL = """CASE WHEN gear = 'POT' THEN CASE pot_size
      WHEN 'Small' THEN 'Four 3.5 inch escape rings'
      WHEN 'Large' THEN 'Four modified 4 inch escape rings' END END"""


@register(QUERIES, f"""
    WITH {V.LENGTH_SQL}, {DATES_SQL}
    SELECT CAST(2021 AS INTEGER) AS year, date, gear, station, haul,
      CASE stratum WHEN 4 THEN '301-400 m' WHEN 5 THEN '401-600 m' WHEN 6 THEN '601-800 m' END
        AS stratum, species,
      CASE CASE WHEN species IN ('Sablefish', 'Giant Grenadier', 'Spiny Dogfish') THEN sex
           ELSE 'U' END WHEN 'M' THEN 'Male' WHEN 'F' THEN 'Female' WHEN 'U' THEN 'Unidentified'
        END AS sex, length, pot_size, {RING_SQL} AS escape_ring
    FROM fish LEFT JOIN dates USING (station)
""")
def standard_lengths(t):
    return S.standard_lengths(V.fish(t), station_dates(t), 2021, V.CODES)


@register(QUERIES, f"""
    WITH {V.CATCH_SQL}, {DATES_SQL},
      s AS (SELECT sized.* REPLACE (CASE WHEN pot_size <> 'Hooks'
              THEN replace(pot_size, ' pots', '') END AS pot_size) FROM sized)
    SELECT CAST(2021 AS INTEGER) AS year, date, gear, station, haul, skate AS skate_or_pot,
      interp_depth AS depth, species, catch, depredation, pot_size,
      {RING_SQL} AS escape_ring, escape_ring AS escape_ring_notes
    FROM s LEFT JOIN depths USING (station, haul, skate) LEFT JOIN dates USING (station)
""")
def standard_catch(t):
    return S.standard_catch(
        V.sized(t), S.unit_depths(V.catch(t)), station_dates(t), 2021, V.CODES
    )


NUMBERED = {"A": 201, "N": 202, "R": 203}
NUMBERED_SQL = """CAST(CASE station WHEN 'A' THEN 201 WHEN 'N' THEN 202
      WHEN 'R' THEN 203 END AS INTEGER) AS station"""
LATE_SQL = "CASE WHEN gear = 'POT' THEN 'Small' END AS pot_size, " + (
    "CASE WHEN gear = 'POT' THEN 'None' END AS escape_ring")


@register(QUERIES, f"""
    WITH {V.LENGTH_SQL}, {DATES_SQL}
    SELECT CAST(2023 AS INTEGER) AS year, date,
      CASE gear WHEN 'HAL' THEN 'Hooks' ELSE 'Traps' END AS gear, {NUMBERED_SQL}, haul,
      CASE stratum WHEN 4 THEN '301-400 m' WHEN 5 THEN '401-600 m' WHEN 6 THEN '601-800 m' END
        AS stratum, species,
      CASE CASE WHEN species IN ('Sablefish', 'Giant Grenadier', 'Spiny Dogfish') THEN sex
           ELSE 'U' END WHEN 'M' THEN 'Male' WHEN 'F' THEN 'Female' WHEN 'U' THEN 'Unidentified'
        END AS sex, length, {LATE_SQL}
    FROM fish LEFT JOIN dates USING (station)
""")
def standard_lengths_late(t):
    return S.standard_lengths(
        V.fish(t), station_dates(t), 2023, V.LATE_CODES,
        gears={"HAL": "Hooks", "POT": "Traps"}, stations=NUMBERED,
    )


@register(QUERIES, f"""
    WITH {V.CATCH_SQL}, {DATES_SQL}
    SELECT CAST(2023 AS INTEGER) AS year, date,
      CASE gear WHEN 'HAL' THEN 'Hooks' ELSE 'Traps' END AS gear, {NUMBERED_SQL}, haul,
      skate AS skate_or_pot, interp_depth AS depth, species, catch, depredation, {LATE_SQL},
      escape_ring AS escape_ring_notes
    FROM tally LEFT JOIN depths USING (station, haul, skate) LEFT JOIN dates USING (station)
""")
def standard_catch_late(t):
    sized = S.label_pot_size(S.tally_events(V.catch(t), V.LATE_CODES), V.LATE_CODES)
    return S.standard_catch(
        sized, S.unit_depths(V.catch(t)), station_dates(t), 2023, V.LATE_CODES,
        gears={"HAL": "Hooks", "POT": "Traps"}, stations=NUMBERED,
    )


@register(QUERIES, """
    SELECT CASE l_linestatus WHEN 'F' THEN 'POT' ELSE 'HAL' END AS gear,
      CAST(l_quantity AS INTEGER) % 10 = 3 AS undecoded,
      CAST(count(*) AS BIGINT) AS events
    FROM lineitem
    WHERE NOT (l_linestatus = 'F' AND CAST(l_quantity AS INTEGER) IN (1, 2, 11, 19))
    GROUP BY ALL
""")
def undecoded_events(t):
    """Events whose code has no name stay in the tally and in the size table."""
    rows = V.catch(t, "species_code % 10 <> 3")
    sized = S.label_pot_size(S.tally_events(rows, V.CODES), V.CODES)
    # reused codes count zero on pots; the marker and the dropped code are left out
    counted = sized.filter("not (gear = 'POT' and coalesce(species, '') in "
                           "('Empty pot', 'Trap door open'))")
    return counted.groupBy("gear", F.col("species").isNull().alias("undecoded")).agg(
        F.sum("catch").alias("events"))


# -- several years ---------------------------------------------------------

YEARS_SQL = """
  years AS (SELECT CASE WHEN gear = 'HAL' THEN 'Hooks' ELSE 'Traps' END AS gear,
              CAST(CASE station WHEN 'A' THEN 201 WHEN 'N' THEN 202 ELSE 203 END AS INTEGER)
                AS station,
              sex, stratum, length, pot_size, haul, year
            FROM fish WHERE species = 'Sablefish')
"""


def years(t):
    """All years in one read; the first one's files had no pot sizes."""
    fish = V.fish(t).filter("species = 'Sablefish'")
    sized = F.when(F.col("year") != 1997, F.col("pot_size"))
    return Y.harmonise(
        fish.withColumn("pot_size", sized),
        {"HAL": "Hooks", "POT": "Traps"},
        {"A": 201, "N": 202, "R": 203},
    )


@register(QUERIES, f"""
    WITH {V.LENGTH_SQL}, {YEARS_SQL}
    SELECT gear, year, station, quantile_cont(length, 0.5) AS median FROM years GROUP BY ALL
""")
def multi_year_medians(t):
    return Y.medians_by(years(t), ["gear", "year", "station"])


FACETS = [
    ["gear"], ["gear", "year"], ["gear", "year", "station"], ["gear", "stratum"],
    ["gear", "year", "stratum"], ["gear", "stratum", "station"], ["gear", "station", "sex"],
]
FACET_KEYS = ["gear", "year", "station", "stratum", "sex"]


def facets_sql(select: str) -> str:
    """A SELECT per facet; ``select`` has {keys} for all columns, {by} for those of the facet."""
    return " UNION ALL ".join(
        "(" + select.format(
            keys=f"'{'_'.join(by)}' AS facet, " + ", ".join(
                k if k in by else f"NULL AS {k}" for k in FACET_KEYS),
            by=", ".join(by)) + ")"
        for by in FACETS)


@register(QUERIES, f"""
    WITH {V.LENGTH_SQL}, {YEARS_SQL},
      facets AS ({facets_sql(
          "SELECT {keys}, quantile_cont(length, 0.5) AS median FROM years GROUP BY {by}")})
    SELECT facet, gear, CAST(year AS INTEGER) AS year, CAST(station AS INTEGER) AS station,
      stratum, sex, median FROM facets
""")
def multi_year_facet_medians(t):
    """Seven groupings from the same two passes."""
    return Y.medians_by_facets(years(t), FACETS)


@register(QUERIES, f"""
    WITH {V.LENGTH_SQL}, {YEARS_SQL},
      facets AS ({facets_sql(
          "SELECT {keys}, sex AS of_sex, count(*) AS n, count(*) / sum(count(*)) "
          "OVER (PARTITION BY {by}) AS sex_ratio FROM years GROUP BY {by}, sex")})
    SELECT facet, gear, CAST(year AS INTEGER) AS year, CAST(station AS INTEGER) AS station,
      stratum, of_sex AS sex, n, round(sex_ratio, 8) AS sex_ratio
    FROM facets WHERE facet <> 'gear_station_sex'
""")
def multi_year_facet_sex_ratios(t):
    """Six groupings from one pass."""
    return Y.sex_ratio_by_facets(years(t), FACETS[:-1]).withColumn("sex_ratio", r("sex_ratio", 8))


@register(QUERIES, f"""
    WITH {V.LENGTH_SQL}, {YEARS_SQL}
    SELECT gear, station, count(*) AS n, true AS within FROM years GROUP BY ALL
""")
def multi_year_sketched_medians(t):
    """Medians over all years from sketches kept per year; within the stated rank error."""
    rows = years(t)
    kept = new_path(t.spark)
    Y.year_sketches(rows, ["year", "gear", "station"]).write.partitionBy("year").parquet(kept)
    found = Y.medians_from_sketches(t.spark.read.parquet(kept), ["gear", "station"])
    length = F.col("length").cast("double")
    ranks = attach(rows, found.drop("n"), ["gear", "station"]).groupBy("gear", "station").agg(
        F.count("*").alias("n"), F.count_if(length < F.col("median")).alias("below"),
        F.count_if(length <= F.col("median")).alias("upto"))
    half = F.col("n") / 2
    slack = RANK_ERROR * F.col("n") + 1
    return ranks.select("gear", "station", "n", (
        (F.col("below") <= half + slack) & (F.col("upto") >= half - slack)).alias("within"))


@register(QUERIES, f"""
    WITH {V.LENGTH_SQL}, {YEARS_SQL}
    SELECT gear, stratum, sex, quantile_cont(length, 0.5) AS median FROM years GROUP BY ALL
""")
def medians_by_stratum_and_sex(t):
    return Y.medians_by(years(t), ["gear", "stratum", "sex"])


@register(QUERIES, f"""
    WITH {V.LENGTH_SQL}, {YEARS_SQL},
      g AS (SELECT year, length, CASE WHEN year <> 1997 AND pot_size IS NOT NULL
              THEN pot_size || ' ' || gear ELSE gear END AS gear2 FROM years),
      q AS (SELECT year, gear2, quantile_cont(length, 0.25) AS q1,
              quantile_cont(length, 0.5) AS median, quantile_cont(length, 0.75) AS q3
            FROM g GROUP BY ALL),
      e AS (SELECT *, length BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
            FROM g JOIN q USING (year, gear2))
    SELECT year, gear2, q1, median, q3, min(length) FILTER (inside) AS lower,
      max(length) FILTER (inside) AS upper, count(*) FILTER (NOT inside) AS n_outliers,
      count(*) AS n
    FROM e GROUP BY year, gear2, q1, median, q3
""")
def multi_year_boxes(t):
    return Y.boxes_by(Y.detailed_gear(years(t)), ["year", "gear2"], "length")


@register(QUERIES, f"""
    WITH {V.LENGTH_SQL}, {YEARS_SQL}
    SELECT gear, sex, count(*) AS n,
      round(count(*) / sum(count(*)) OVER (PARTITION BY gear), 8) AS sex_ratio
    FROM years GROUP BY gear, sex
""")
def multi_year_sex_ratio(t):
    return Y.sex_ratio(years(t), ["gear"]).withColumn("sex_ratio", r("sex_ratio", 8))


@register(QUERIES, """
    WITH v AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'POT' ELSE 'HAL' END AS gear,
                 CAST(day(ts) // 7 AS INTEGER) AS year, user_id // 10 AS depth, value
               FROM events),
         s AS (SELECT gear, year, depth, sum(value) AS v FROM v GROUP BY ALL),
         z AS (SELECT *, (v - avg(v) OVER w) / stddev_samp(v) OVER w AS std FROM s
               WINDOW w AS (PARTITION BY gear, year))
    SELECT a.year, round(corr(a.std, b.std), 6) AS cor
    FROM z a JOIN z b ON a.year = b.year AND a.depth = b.depth
      AND a.gear = 'HAL' AND b.gear = 'POT' GROUP BY ALL
""")
def depth_correlation_by_year(t):
    rows = t.events.select(
        F.when(F.col("user_id") % 2 == 0, "POT").otherwise("HAL").alias("gear"),
        F.floor(F.dayofmonth("ts") / 7).cast("int").alias("year"),
        F.floor(F.col("user_id") / 10).alias("depth"),
        "value",
    )
    return Y.depth_correlation(rows, ("HAL", "POT"), ["year"], "value").withColumn(
        "cor", r("cor")
    )
