"""The shared tables seen as survey events, measured fish and landings.

Each view is stated twice: as a DataFrame and as the SQL prefix of the
equivalent queries.  All rows of the tables take part.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulframe.functions.nulls import recode
from haulframe.plans import survey as S
from haulframe.plans.codes import EARLY_RINGS, LATE_RINGS, EventRule, GearCodes

NAMES = {
    1: "Baited Hook",
    2: "Ineffective Hook",
    3: "Sablefish",
    4: "Sablefish",
    5: "Giant Grenadier",
    6: "Sablefish",
    8: "Rougheye/Shortraker Rockfish",
    9: "Spiny Dogfish",
    11: "Shark egg case",
    19: "Big Skate",
    22: "Brittle Starfish",
}
CODES = GearCodes(
    target="Sablefish",
    rules=(
        EventRule("Baited Hook", "Empty pot"),
        EventRule("Ineffective Hook", "Trap door open", omits_unit="door"),
        EventRule("Shark egg case", "Empty gangion", drops_row=True),
    ),
    large_marker="Big Skate",
    rings=EARLY_RINGS,
)
LATE_CODES = replace(CODES, large_marker=None, rings=LATE_RINGS)

NAME_SQL = (
    "CASE {c} "
    + " ".join(f"WHEN {k} THEN '{v}'" for k, v in NAMES.items())
    + " ELSE 'Species ' || {c} END"
)

CATCH_SQL = f"""
  codes AS (SELECT DISTINCT p_size AS species_code, {NAME_SQL.format(c="p_size")} AS species
            FROM part),
  raw AS (SELECT CASE l_linestatus WHEN 'F' THEN 'POT' ELSE 'HAL' END AS gear,
            l_returnflag AS station, l_linenumber AS haul, l_suppkey AS skate,
            CAST(l_quantity AS INTEGER) AS species_code,
            CASE WHEN l_discount >= 0.08 THEN 1 ELSE 0 END AS depredation,
            CASE WHEN l_tax < 0.06 THEN 0 ELSE 300 + l_partkey % 500 END AS depth,
            l_orderkey * 4194304 + l_suppkey AS row_seq
          FROM lineitem),
  caught AS (SELECT raw.*, species FROM raw LEFT JOIN codes USING (species_code)),
  counted AS (SELECT gear, station, haul, skate, species, depredation, count(*) AS n
              FROM caught GROUP BY ALL),
  named AS (SELECT gear, station, haul, skate,
              CASE WHEN gear = 'POT' AND species = 'Baited Hook' THEN 'Empty pot'
                   WHEN gear = 'POT' AND species = 'Ineffective Hook' THEN 'Trap door open'
                   WHEN gear = 'POT' AND species = 'Shark egg case' THEN 'Empty gangion'
                   ELSE species END AS species,
              CASE WHEN gear = 'POT' AND species IN
                     ('Baited Hook', 'Ineffective Hook', 'Shark egg case')
                   THEN 0 ELSE n END AS catch,
              CASE WHEN gear = 'POT' AND depredation = 1 THEN 'Stuck in escape ring' END
                AS escape_ring,
              CASE WHEN gear <> 'POT' THEN CAST(depredation AS INTEGER) END AS depredation
            FROM counted),
  tally AS (SELECT * FROM named WHERE species IS DISTINCT FROM 'Empty gangion'),
  large AS (SELECT DISTINCT station, haul, skate FROM tally
            WHERE gear = 'POT' AND species = 'Big Skate'),
  sized AS (SELECT tally.*, CASE WHEN gear = 'HAL' THEN 'Hooks'
                   WHEN large.skate IS NOT NULL THEN 'Large pots' ELSE 'Small pots' END AS pot_size
            FROM tally LEFT JOIN large USING (station, haul, skate)
            WHERE NOT coalesce(gear = 'POT' AND species = 'Big Skate', false)),
  rates AS (SELECT gear, station, haul, skate,
              count(*) FILTER (species = 'Sablefish') AS n_target,
              station || '_' || haul || '_' || skate AS skate_id,
              CASE WHEN gear = 'POT' THEN CASE WHEN bool_or(coalesce(species = 'Big Skate', false))
                   THEN 'Large' ELSE 'Small' END END AS pot_size
            FROM caught
            WHERE NOT (gear = 'POT' AND coalesce(species = 'Shark egg case', false))
            GROUP BY gear, station, haul, skate
            HAVING NOT (gear = 'POT' AND bool_or(coalesce(species = 'Ineffective Hook', false)))),
  units AS (SELECT station, haul, skate, min(row_seq) AS seq,
              max(CASE WHEN depth > 0 THEN depth END) AS recorded_depth
            FROM caught GROUP BY ALL),
  placed AS (SELECT *, row_number() OVER (PARTITION BY station, haul ORDER BY seq) AS pos FROM units),
  known AS (SELECT *, CASE WHEN recorded_depth IS NOT NULL THEN pos END AS kpos FROM placed),
  near AS (SELECT *,
             last_value(kpos IGNORE NULLS) OVER a AS p0,
             last_value(recorded_depth IGNORE NULLS) OVER a AS v0,
             first_value(kpos IGNORE NULLS) OVER b AS p1,
             first_value(recorded_depth IGNORE NULLS) OVER b AS v1,
             count(recorded_depth) OVER (PARTITION BY station, haul) AS n_known
           FROM known
           WINDOW a AS (PARTITION BY station, haul ORDER BY pos
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                  b AS (PARTITION BY station, haul ORDER BY pos
                        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  depths AS (SELECT station, haul, skate, CAST(recorded_depth AS DOUBLE) AS recorded_depth,
               CAST(CASE WHEN recorded_depth IS NOT NULL OR n_known < 2 THEN recorded_depth
                 WHEN p0 IS NOT NULL AND p1 IS NOT NULL
                   THEN v0 + (v1 - v0) / (p1 - p0) * (pos - p0)
                 ELSE coalesce(v0, v1) END AS DOUBLE) AS interp_depth
             FROM near),
  deep AS (SELECT rates.*, recorded_depth, interp_depth,
             CAST(floor(interp_depth / 25) * 25 AS BIGINT) AS depth
           FROM rates LEFT JOIN depths USING (station, haul, skate))
"""

LENGTH_SQL = """
  fish AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'POT' ELSE 'HAL' END AS gear,
             CASE o_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS station,
             CAST(o_orderkey % 7 + 1 AS INTEGER) AS haul,
             CAST(o_orderkey % 3 + 4 AS INTEGER) AS stratum,
             CASE o_custkey % 12 WHEN 0 THEN 'Rougheye Rockfish' WHEN 1 THEN 'Shortraker Rockfish'
               WHEN 2 THEN 'Giant Grenadier' WHEN 3 THEN 'Pacific cod' ELSE 'Sablefish' END
               AS species,
             CASE o_orderstatus WHEN 'F' THEN 'F' WHEN 'O' THEN 'M' END AS sex,
             CAST(30 + o_custkey * 7 % 61 AS DOUBLE) AS length,
             CASE WHEN o_orderkey % 2 = 0 THEN
               CASE WHEN o_totalprice > 250000 THEN 'Large' ELSE 'Small' END END AS pot_size,
             o_orderkey AS row_seq, CAST(year(o_orderdate) AS INTEGER) AS year
           FROM orders)
"""

LANDING_SQL = """
  extract AS (SELECT * FROM (
    SELECT l_orderkey AS catch_report_source_pk, l_partkey AS vessel_id,
      'V' || l_partkey AS ves_akr_name, CAST(30 + l_partkey % 70 AS INTEGER) AS ves_akr_length,
      CAST(year(l_shipdate) AS INTEGER) AS year, CAST(l_shipdate AS DATE) AS week_end_date,
      CASE l_returnflag WHEN 'A' THEN 'HAL' WHEN 'N' THEN 'POT'
        ELSE CASE WHEN l_tax < 0.02 THEN 'JIG' WHEN l_tax < 0.04 THEN 'TRW' ELSE 'POT' END END
        AS fmp_gear,
      CASE l_linenumber WHEN 1 THEN 'BS' WHEN 2 THEN 'AI' WHEN 3 THEN 'WG' WHEN 4 THEN 'CG'
        WHEN 5 THEN 'WY' WHEN 6 THEN 'SE' ELSE 'XX' END AS fmp_subarea,
      CASE WHEN l_discount < 0.03 THEN 'IFQ' WHEN l_discount < 0.08 THEN 'CDQ' ELSE 'OA' END
        AS management_program_code,
      l_quantity AS weight_posted,
      CASE WHEN l_quantity <= 40 THEN 'SABL' ELSE 'PCOD' END AS species_code,
      CASE o_orderstatus WHEN 'F' THEN 'Hard Pots' WHEN 'O' THEN 'Mesh Pots' END
        AS gear_modifier_description
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey)
    WHERE species_code = 'SABL' AND year BETWEEN 1996 AND 2000
      AND fmp_subarea <> 'XX' AND management_program_code <> 'OA'
      AND fmp_gear NOT IN ('JIG', 'TRW')),
  classed AS (SELECT *, CASE WHEN fmp_gear = 'HAL' THEN 'HAL'
      WHEN gear_modifier_description = 'Hard Pots' THEN 'POT_HARD'
      WHEN gear_modifier_description = 'Mesh Pots' THEN 'POT_MESH'
      ELSE 'POT_UNKN' END AS gear,
      CAST(list_position(['BS', 'AI', 'WG', 'CG', 'WY', 'SE'], fmp_subarea) AS INTEGER)
        AS area_rank
    FROM extract),
  seen AS (SELECT DISTINCT vessel_id, fmp_gear, gear AS obsgear FROM classed
           WHERE year IN (1998) AND gear_modifier_description IS NOT NULL),
  dups AS (SELECT vessel_id FROM seen GROUP BY vessel_id HAVING count(*) > 1),
  obs AS (SELECT DISTINCT vessel_id, fmp_gear,
            CASE WHEN vessel_id IN (SELECT vessel_id FROM dups) THEN 'POT_UNKN_MIXED'
                 ELSE obsgear END AS obsgear FROM seen),
  attributed AS (SELECT classed.*,
      CASE WHEN gear_modifier_description IS NULL THEN o.obsgear END AS obsgear,
      CASE WHEN classed.fmp_gear = 'HAL' THEN gear
           WHEN gear_modifier_description IS NULL AND o.obsgear IS NOT NULL THEN o.obsgear
           ELSE gear END AS newgear
    FROM classed LEFT JOIN obs o
      ON classed.vessel_id = o.vessel_id AND classed.fmp_gear = o.fmp_gear)
"""


def species_codes(t) -> DataFrame:
    code = F.col("p_size")
    name = F.coalesce(
        recode("p_size", NAMES), F.concat(F.lit("Species "), code.cast("string"))
    )
    return t.part.select(code.alias("species_code"), name.alias("species")).distinct()


def catch(t, listed: str = "true") -> DataFrame:
    """Events; codes that are not ``listed`` have no name."""
    rows = t.lineitem.select(
        F.when(F.col("l_linestatus") == "F", "POT").otherwise("HAL").alias("gear"),
        F.col("l_returnflag").alias("station"),
        F.col("l_linenumber").alias("haul"),
        F.col("l_suppkey").alias("skate"),
        F.col("l_quantity").cast("int").alias("species_code"),
        (F.col("l_discount") >= 0.08).cast("int").alias("depredation"),
        F.when(F.col("l_tax") < 0.06, 0).otherwise(300 + F.col("l_partkey") % 500).alias("depth"),
        (F.col("l_orderkey") * 4194304 + F.col("l_suppkey")).alias("row_seq"),
    )
    return S.decode(rows, species_codes(t).filter(listed), "species_code")


def tally(t) -> DataFrame:
    return S.tally_events(catch(t), CODES)


def sized(t) -> DataFrame:
    return S.label_pot_size(tally(t), CODES)


def rates(t) -> DataFrame:
    return S.catch_rates(catch(t), CODES)


def deep(t) -> DataFrame:
    return S.rates_with_depth(catch(t), CODES)


def fish(t) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    letter = recode("o_orderstatus", {"F": "F", "O": "M"}, keep_other=False)
    number = F.lpad((30 + cust * 7 % 61).cast("string"), 3, "0")
    species = recode(
        cust % 12,
        {0: "Rougheye Rockfish", 1: "Shortraker Rockfish", 2: "Giant Grenadier",
         3: "Pacific cod"},
    )
    pots = key % 2 == 0
    rows = t.orders.select(
        F.when(pots, "POT").otherwise("HAL").alias("gear"),
        recode(cust % 3, {0: "A", 1: "N", 2: "R"}).alias("station"),
        (key % 7 + 1).cast("int").alias("haul"),
        (key % 3 + 4).cast("int").alias("stratum"),
        F.coalesce(species, F.lit("Sablefish")).alias("species"),
        F.concat(F.coalesce(letter, F.lit("X")), number).alias("length"),
        F.when(
            pots, F.when(F.col("o_totalprice") > 250000, "Large").otherwise("Small")
        ).alias("pot_size"),
        key.alias("row_seq"),
        F.year("o_orderdate").alias("year"),
    )
    # an unreadable sex letter is missing
    return S.parse_lengths(rows).withColumn(
        "sex", F.when(F.col("sex") != "X", F.col("sex"))
    )


def landing_tables(t) -> tuple[DataFrame, DataFrame]:
    """Landings with upper-case names, as a database would return them."""
    other = (
        F.when(F.col("l_tax") < 0.02, "JIG").when(F.col("l_tax") < 0.04, "TRW").otherwise("POT")
    )
    areas = {1: "BS", 2: "AI", 3: "WG", 4: "CG", 5: "WY", 6: "SE"}
    landings = t.lineitem.select(
        F.col("l_orderkey").alias("CATCH_REPORT_SOURCE_PK"),
        F.col("l_partkey").alias("VESSEL_ID"),
        F.concat(F.lit("V"), F.col("l_partkey").cast("string")).alias("VES_AKR_NAME"),
        (30 + F.col("l_partkey") % 70).cast("int").alias("VES_AKR_LENGTH"),
        F.year("l_shipdate").alias("YEAR"),
        F.col("l_shipdate").alias("WEEK_END_DATE"),
        F.when(F.col("l_returnflag") == "A", "HAL")
        .when(F.col("l_returnflag") == "N", "POT")
        .otherwise(other)
        .alias("FMP_GEAR"),
        F.coalesce(recode("l_linenumber", areas), F.lit("XX")).alias("FMP_SUBAREA"),
        F.when(F.col("l_discount") < 0.03, "IFQ")
        .when(F.col("l_discount") < 0.08, "CDQ")
        .otherwise("OA")
        .alias("MANAGEMENT_PROGRAM_CODE"),
        F.col("l_quantity").alias("WEIGHT_POSTED"),
        F.when(F.col("l_quantity") <= 40, "SABL").otherwise("PCOD").alias("SPECIES_CODE"),
    )
    tickets = t.orders.select(
        F.col("o_orderkey").alias("CATCH_REPORT_SOURCE_PK"),
        recode("o_orderstatus", {"F": "Hard Pots", "O": "Mesh Pots"}).alias(
            "GEAR_MODIFIER_DESCRIPTION"
        ),
    )
    return landings, tickets


def extract(t) -> DataFrame:
    from haulframe.plans.landings import landings_extract

    return landings_extract(*landing_tables(t), years=(1996, 2000))


def attributed(t) -> DataFrame:
    from haulframe.plans.landings import attribute_gear

    return attribute_gear(extract(t), years=(1998,))


