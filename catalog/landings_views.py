"""The landings analyses on the shared tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from catalog import views as V
from catalog.tables import r, register
from haulframe.plans import landings as L

QUERIES: dict = {}

COLUMNS = (
    "catch_report_source_pk, vessel_id, ves_akr_name, ves_akr_length, year, week_end_date, "
    "fmp_gear, fmp_subarea, management_program_code, weight_posted, species_code, "
    "gear_modifier_description, gear, area_rank"
)


@register(QUERIES, f"WITH {V.LANDING_SQL} SELECT {COLUMNS} FROM classed")
def landings_extract(t):
    return V.extract(t)


@register(QUERIES, f"""
    WITH {V.LANDING_SQL}
    SELECT year, fmp_subarea, ves_akr_length, count(DISTINCT vessel_id) AS nvessel,
      count(DISTINCT catch_report_source_pk) AS ntrip, sum(weight_posted) AS catch
    FROM classed GROUP BY ALL
    HAVING count(DISTINCT vessel_id) <= 6 OR count(DISTINCT catch_report_source_pk) <= 6
""")
def confidentiality_screen(t):
    return L.confidentiality_screen(
        V.extract(t), ["year", "fmp_subarea", "ves_akr_length"]
    )


@register(QUERIES, f"""
    WITH {V.LANDING_SQL},
      s AS (SELECT year, fmp_subarea, gear, sum(weight_posted) AS catch
            FROM classed GROUP BY ALL)
    SELECT year, fmp_subarea, gear, catch,
      round(catch / sum(catch) OVER (PARTITION BY year, fmp_subarea), 8) AS prop
    FROM s
""")
def share_by_gear(t):
    return L.share_by_gear(V.extract(t)).withColumn("prop", r("prop", 8))


@register(QUERIES, f"WITH {V.LANDING_SQL} SELECT vessel_id, fmp_gear, obsgear FROM seen")
def known_vessel_gear(t):
    return L.known_vessel_gear(V.extract(t), years=(1998,))


@register(QUERIES, f"""
    WITH {V.LANDING_SQL} SELECT {COLUMNS}, obsgear, newgear FROM attributed
""")
def gear_attribution(t):
    return V.attributed(t)


@register(QUERIES, f"""
    WITH {V.LANDING_SQL}
    SELECT newgear, count(*) AS n FROM attributed GROUP BY ALL
""")
def attributed_totals(t):
    return V.attributed(t).groupBy("newgear").agg(F.count(F.lit(1)).alias("n"))


@register(QUERIES, f"""
    WITH {V.LANDING_SQL},
      s AS (SELECT year, fmp_subarea, newgear AS gear, sum(weight_posted) AS catch_mt,
              count(DISTINCT catch_report_source_pk) AS number_of_landings
            FROM attributed WHERE fmp_subarea NOT IN ('BS', 'AI') GROUP BY ALL)
    SELECT *, round(catch_mt / sum(catch_mt) OVER w, 8) AS proportion_catch,
      round(number_of_landings / sum(number_of_landings) OVER w, 8) AS proportion_landings
    FROM s WINDOW w AS (PARTITION BY year, fmp_subarea)
""")
def landings_summary(t):
    return L.landings_summary(V.attributed(t)).withColumns(
        {c: r(c, 8) for c in ("proportion_catch", "proportion_landings")}
    )


GEARS = ["HAL", "POT_HARD", "POT_MESH", "POT_UNKN"]


@register(QUERIES, f"""
    WITH {V.LANDING_SQL}
    SELECT vessel_id, ves_akr_name, ves_akr_length,
      {", ".join(f'''coalesce(sum(weight_posted) FILTER (gear = '{g}'), 0.0) AS "{g}"'''
                 for g in GEARS)}
    FROM classed WHERE vessel_id IN (SELECT vessel_id FROM dups)
      AND week_end_date >= DATE '1998-09-25'
    GROUP BY ALL
""")
def vessel_gear_matrix(t):
    rows = V.extract(t)
    vessels = L.several_gears(L.known_vessel_gear(rows, years=(1998,)))
    return L.vessel_gear_matrix(rows, vessels, date(1998, 9, 25), GEARS)


@register(QUERIES, f"""
    WITH {V.LANDING_SQL}
    SELECT week_end_date, gear_modifier_description, sum(weight_posted) AS catch
    FROM classed WHERE year = 1999 AND fmp_gear = 'POT' GROUP BY ALL
""")
def weekly_catch(t):
    return L.weekly_catch(V.extract(t), 1999)


@register(QUERIES, f"""
    WITH {V.LANDING_SQL}
    SELECT DISTINCT fmp_gear, ves_akr_name, ves_akr_length FROM attributed
    WHERE newgear = 'POT_UNKN'
""")
def unidentified_vessels(t):
    return L.unidentified_vessels(V.attributed(t))


@register(QUERIES, """
    SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_linenumber AS fmp_area,
      l_returnflag AS agency_gear_code, l_linestatus AS em_gear_name, count(*) AS n
    FROM lineitem WHERE year(l_shipdate) > 1997 GROUP BY ALL
""")
def monitoring_counts(t):
    rows = t.lineitem.select(
        F.year("l_shipdate").alias("year"),
        F.col("l_linenumber").alias("fmp_area"),
        F.col("l_returnflag").alias("agency_gear_code"),
        F.col("l_linestatus").alias("em_gear_name"),
    )
    return L.monitoring_counts(rows, 1997)
