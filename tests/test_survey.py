"""The analyses on a hand-made survey of two stations."""

from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from haulframe.plans import landings as L
from haulframe.plans import survey as S
from haulframe.plans import synthesis as Y
from haulframe.plans.codes import EARLY, LATE, NOT_FISH
from haulframe.plans.yearly import landings_report, survey_year, synthesis, write_all


def events():
    """(gear, station, haul, depth, skate, species, depredation)"""
    out = []

    def unit(gear, station, haul, skate, depth, *species, stuck=0):
        for i, s in enumerate(species):
            out.append((gear, station, haul, depth if i == 0 else 0.0, skate, s,
                        1 if i < stuck else 0))

    fish, mixed = "Sablefish", "Rougheye/Shortraker Rockfish"
    for st, haul in (("A", 1), ("B", 3)):
        unit("HAL", st, haul, 1, 400.0, fish, fish, fish, "Ineffective Hook", stuck=1)
        unit("HAL", st, haul, 2, 0.0, fish, fish, "Baited Hook", mixed)
        unit("HAL", st, haul, 3, 460.0, fish, "Giant Grenadier")
        unit("POT", st, haul + 1, 91, 400.0, "Big Skate", fish, fish, stuck=2)
        unit("POT", st, haul + 1, 92, 0.0, "Baited Hook")
        unit("POT", st, haul + 1, 93, 0.0, "Ineffective Hook", fish)
        unit("POT", st, haul + 1, 94, 490.0, fish, "Brittle Starfish")
    return out


@pytest.fixture(scope="module")
def catch(spark):
    rows = [(*e, i) for i, e in enumerate(events())]
    return spark.createDataFrame(
        rows, "gear string, station string, haul int, depth double, skate int, "
        "species string, depredation int, row_seq long").cache()


@pytest.fixture(scope="module")
def lengths(spark):
    rows, seq = [], 0
    for st, haul in (("A", 1), ("B", 3)):
        for gear, h, size, codes in (
            ("HAL", haul, None, ["F050", "M055", "F060", "M055", "F070"]),
            ("POT", haul + 1, "Large", ["F065", "F066", "bad"]),
            ("POT", haul + 1, "Small", ["M045", "F052"]),
        ):
            for c in codes:
                rows.append((gear, st, h, 5, "Sablefish", c, size, seq))
                seq += 1
        rows.append(("HAL", st, haul, 6, "Shortraker Rockfish", "040", None, seq))
        seq += 1
    return spark.createDataFrame(
        rows, "gear string, station string, haul int, stratum int, species string, "
        "length string, pot_size string, row_seq long").cache()


@pytest.fixture(scope="module")
def stations(spark):
    rows = [(s, g, date(2021, 7, 24 if s == "A" else 28), 500, 1457 if g == "POT" else 800)
            for s in "AB" for g in ("HAL", "POT")]
    return spark.createDataFrame(
        rows, "station string, gear string, date date, start_time int, end_time int")


def test_tally_recodes_pots_only(catch):
    t = S.tally_events(catch, EARLY).filter("station = 'A'")
    got = {(r["gear"], r["skate"], r["species"], r["depredation"]): r for r in t.collect()}
    assert got[("POT", 92, "Empty Pot", None)]["catch"] == 0
    assert got[("POT", 93, "Trap Door Open", None)]["catch"] == 0
    assert got[("HAL", 2, "Baited Hook", 0)]["catch"] == 1
    assert got[("HAL", 1, "Sablefish", 1)]["escape_ring"] is None
    stuck = [r for r in t.collect() if r["escape_ring"] is not None]
    assert {(r["gear"], r["skate"]) for r in stuck} == {("POT", 91)}


def test_late_codes(spark, catch):
    codes = ["Alaskan False Jingle", "Shark egg case", "Unsorted sharks", "Sablefish"]
    rows = [("POT", "A", 9, 0.0, 70 + i, s, 0, i) for i, s in enumerate(codes)]
    late = spark.createDataFrame(rows, catch.schema)
    t = S.tally_events(late, LATE)
    assert {r["species"]: r["catch"] for r in t.collect()} == {
        "Lost pot": 0, "Bait bag lost or damaged": 0, "Sablefish": 1}
    assert {r["reason"] for r in S.omitted_units(t, LATE).collect()} == {
        "Lost pot", "Bait bag lost or damaged"}
    # lost, damaged and intentionally empty units are no effort
    assert [r["skate"] for r in S.catch_rates(late, LATE).collect()] == [73]


def test_rates(catch):
    rates = S.catch_rates(catch, EARLY)
    got = {(r["station"], r["skate"]): (r["n_target"], r["detailed_gear"]) for r in rates.collect()}
    assert ("A", 93) not in got
    assert got[("A", 91)] == (2, "Large pots") and got[("A", 92)] == (0, "Small pots")
    assert got[("B", 1)] == (3, "Hook-and-line")
    summary = {(r["gear"], r["station"]): r["mean_catch_rate"] for r in S.rate_summary(rates).collect()}
    assert summary == {("HAL", "A"): 2.0, ("HAL", "B"): 2.0, ("HAL", "All_sets_combined"): 2.0,
                       ("POT", "A"): 1.0, ("POT", "B"): 1.0, ("POT", "All_sets_combined"): 1.0}
    fewer = S.catch_rates(catch, EARLY, rates.filter("skate = 92"))
    assert fewer.count() == rates.count() - 2


def test_depths(catch):
    d = {(r["station"], r["skate"]): r["interp_depth"] for r in S.unit_depths(catch).collect()}
    assert d[("A", 2)] == 430.0 and d[("A", 92)] == 430.0 and d[("A", 93)] == 460.0
    deep = S.rates_with_depth(catch, EARLY)
    assert {r["skate"]: r["depth"] for r in deep.filter("station = 'A'").collect()} == {
        1: 400, 2: 425, 3: 450, 91: 400, 92: 425, 94: 475}
    totals = {(r["gear"], r["station"], r["depth"]): r["n_target"]
              for r in S.depth_totals(deep, EARLY).collect()}
    assert totals[("POT", "A", 400)] == -2 and totals[("HAL", "B", 425)] == 2


def test_composition_and_sizes(catch, lengths):
    tally = S.label_pot_size(S.tally_events(catch, EARLY), EARLY)
    fish = S.parse_lengths(lengths)
    split = S.split_mixed(fish, tally)
    assert {r["reconciles"] for r in split.collect()} == {1}
    comp = S.species_composition(tally, S.split_rows(split), NOT_FISH)
    shares = comp.groupBy("gear", "station").agg(F.sum("prop").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in shares)
    hal = {r["species"]: r["n"] for r in comp.filter("gear = 'HAL' and station = 'A'").collect()}
    assert hal == {"Sablefish": 6, "Giant Grenadier": 1, "Shortraker Rockfish": 1,
                   "Rougheye Rockfish": 0}
    assert comp.filter("species_rank = 1").select("species").distinct().first()[0] == "Sablefish"
    sizes = {(r["gear"], r["pot_size"]): (r["n_lengths"], r["n_catch"])
             for r in S.totals_by_size(fish, tally, "Sablefish").collect()}
    assert sizes == {("HAL", None): (10, 12), ("POT", "Large"): (6, 4), ("POT", "Small"): (4, 4)}
    assert {(r["station"], r["Large pots"], r["Small pots"])
            for r in S.pot_counts(tally, EARLY).collect()} == {("A", 1, 3), ("B", 1, 3)}


def test_mixed_catch_of_unmeasured_hauls_stays(spark):
    mixed, parts = "Rougheye/Shortraker Rockfish", ("Rougheye Rockfish", "Shortraker Rockfish")
    tally = spark.createDataFrame(
        [("HAL", "A", 1, mixed, 10), ("HAL", "A", 2, mixed, 50), ("HAL", "A", 2, "Sablefish", 40),
         ("HAL", "A", 3, None, 7)],
        "gear string, station string, haul int, species string, catch long")
    fish = spark.createDataFrame(
        [("HAL", "A", 1, parts[0])] * 2 + [("HAL", "A", 1, parts[1]), ("HAL", "A", 4, parts[1])],
        "gear string, station string, haul int, species string")
    split = S.split_mixed(fish, tally)
    got = {r["haul"]: tuple(r)[3:] for r in split.collect()}
    assert got == {1: (6, 3, 10, 0, 1), 2: (0, 0, 50, 0, 50), 4: (0, 1, None, 0, 0)}
    comp = S.species_composition(tally, S.split_rows(split), [mixed], ["gear"])
    n = {r["species"]: r["n"] for r in comp.collect()}
    assert n == {parts[0]: 6, parts[1]: 4, mixed: 51, "Sablefish": 40, None: 7}
    assert sum(n.values()) == 10 + 50 + 40 + 7 + 1  # haul 4 has measured fish only


def test_events_without_a_name_stay(spark, catch):
    rows = catch.withColumn("species", F.when(F.col("species") != "Giant Grenadier", F.col("species")))
    sized = S.label_pot_size(S.tally_events(rows, EARLY), EARLY)
    assert sized.filter("species is null and gear = 'HAL'").count() == 2
    pots = rows.withColumn("gear", F.lit("POT"))
    kept = S.label_pot_size(S.tally_events(pots, EARLY), EARLY)
    assert kept.filter("species is null").count() == 2
    lossy = replace(EARLY, drops_undecoded=True)
    assert S.label_pot_size(S.tally_events(pots, lossy), lossy).filter("species is null").count() == 0


def test_a_late_year(spark, catch, lengths, stations):
    tables = survey_year(catch, lengths, stations, 2023, LATE, gear_names={"HAL": "Hooks", "POT": "Traps"},
                         station_names={"A": 201, "B": 202})
    for name in ("clean_catch", "clean_lengths"):
        rows = tables[name]().collect()
        assert {(r["gear"], r["pot_size"], r["escape_ring"]) for r in rows} == {
            ("Hooks", None, None), ("Traps", "Small", "None")}
        assert {r["station"] for r in rows} == {201, 202}
        dates = [(r["date"], r["station"], r["haul"]) for r in rows]
        assert dates == sorted(dates)
    assert "pot_counts" not in tables and tables["ineffective_units"]().count() == 0


def test_lengths(lengths):
    fish = S.parse_lengths(lengths)
    bad = fish.filter("length is null").select("sex").collect()
    assert len(bad) == 4  # two unreadable codes, two without a sex letter
    table = {(r["station"], r["gear"]): r for r in
             S.sex_length_table(fish.filter("species = 'Sablefish'")).collect()}
    assert table[("A", "HAL")]["proportion_female"] == "0.60"
    assert table[("A", "HAL")]["mean_se_length_cm"] == "58.0 (3.39)"
    ratio = S.sex_ratio(fish.filter("species = 'Sablefish'"), ["gear"])
    assert ratio.agg(F.sum("sex_ratio")).first()[0] == pytest.approx(2)
    modes = {r["gear"]: r["mode"] for r in
             S.length_rows_with_stats(fish.filter("length is not null"), ["gear"]).collect()}
    assert modes["HAL"] == 55.0 and modes["POT"] == 65.0


def test_station_table(catch, stations):
    got = {(r["station"], r["gear"]): r for r in S.station_table(stations, catch).collect()}
    assert got[("A", "POT")]["soak_hours"] == 10.0  # 9 h 57 min
    assert got[("A", "POT")]["units_fished"] == 4
    assert (got[("A", "HAL")]["min_depth"], got[("A", "HAL")]["max_depth"]) == (400.0, 460.0)
    written = {(r["station"], r["gear"]): r["soak_hours"]
               for r in S.station_table(stations, catch, as_written=True).collect()}
    assert written[("A", "POT")] == 9.6


def test_equivalence(catch):
    r = S.equivalence_spacing(S.catch_rates(catch, EARLY), "HAL", "POT").filter(
        "station = 'Average'").first()
    assert (r["rate_ratio"], r["equivalent_pots"], r["spacing_m"]) == (2.0, 180.0, 50.0)
    assert r["spacing_fm"] == pytest.approx(50 / 1.8288)


def test_pot_dimensions(spark):
    got = {r["pot_size"]: r["volume_m3"] for r in S.pot_dimensions(spark).collect()}
    assert got["Large"] == pytest.approx(0.7709, abs=1e-3)
    assert got["Small"] < got["Large"]


def test_a_whole_year(spark, catch, lengths, stations, tmp_path):
    tables = survey_year(catch, lengths, stations, 2021, EARLY)
    assert {"clean_catch", "clean_lengths", "pot_counts", "equivalence"} <= set(tables)
    lengths_out, catch_out = tables["clean_lengths"](), tables["clean_catch"]()
    clean = lengths_out.filter("species = 'Sablefish' and gear = 'POT'")
    assert {(r["pot_size"], r["escape_ring"][:4]) for r in clean.collect()} == {
        ("Large", "Four"), ("Small", "Four")}
    assert lengths_out.filter("sex is null").count() == 2
    assert catch_out.filter("depth is null").count() == 0
    write_all({k: tables[k] for k in ("rate_summary", "length_welch", "sample_sizes")},
              str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == [
        "length_welch", "rate_summary", "sample_sizes"]


def test_years_together(catch, lengths, stations):
    year = survey_year(catch, lengths, stations, 2021, EARLY)
    rates, clean = year["rates_by_depth"](), year["clean_lengths"]().drop("year")
    out = synthesis(
        {2021: rates, 2022: rates.drop("pot_size")}, {2021: clean, 2022: clean},
        {"HAL": "Hooks", "POT": "Traps"}, {"A": 201, "B": 202}, "Sablefish",
        ("Hooks", "Traps"),
    )
    medians = {r["gear"]: r["median"] for r in out["median_length_gear"]().collect()}
    assert medians == {"Hooks": 55.0, "Traps": 58.5}
    both = out["depth_correlation_year_station"]().collect()
    assert {(r["year"], r["station"]) for r in both} == {(y, s) for y in (2021, 2022) for s in (201, 202)}
    labels = Y.detailed_gear(clean.limit(50)).select("gear2").distinct().collect()
    assert {"Large POT", "HAL"} <= {r[0] for r in labels}


def landing(year, vessel, gear, area, modifier, pk, weight, species="SABL", program="IFQ"):
    return (year, vessel, f"N{vessel}", 40.0, gear, area, date(year, 10, 2), weight, program,
            pk, species, modifier)


@pytest.fixture(scope="module")
def landing_tables(spark):
    rows = [
        landing(2021, "v1", "POT", "CG", "Hard Pots", "p1", 1.0),
        landing(2019, "v1", "POT", "CG", None, "p2", 2.0),
        landing(2022, "v2", "POT", "CG", "Hard Pots", "p3", 4.0),
        landing(2022, "v2", "POT", "WG", "Mesh Pots", "p4", 8.0),
        landing(2018, "v2", "POT", "WG", None, "p5", 16.0),
        landing(2018, "v3", "POT", "WG", None, "p6", 32.0),
        landing(2018, "v4", "HAL", "BS", None, "p7", 64.0),
        landing(2018, "v5", "JIG", "BS", None, "p8", 128.0),
        landing(2018, "v5", "HAL", "XX", None, "p9", 256.0),
        landing(2018, "v5", "HAL", "CG", None, "p10", 512.0, species="PCOD"),
        landing(2018, "v5", "HAL", "CG", None, "p11", 512.0, program="OA"),
        landing(2010, "v5", "HAL", "CG", None, "p12", 512.0),
    ]
    names = ["YEAR", "VESSEL_ID", "VES_AKR_NAME", "VES_AKR_LENGTH", "FMP_GEAR", "FMP_SUBAREA",
             "WEEK_END_DATE", "WEIGHT_POSTED", "MANAGEMENT_PROGRAM_CODE",
             "CATCH_REPORT_SOURCE_PK", "SPECIES_CODE", "modifier"]
    df = spark.createDataFrame(
        rows, "y int, v string, n string, l double, g string, a string, w date, x double, "
        "m string, pk string, s string, modifier string").toDF(*names)
    tickets = df.select("CATCH_REPORT_SOURCE_PK",
                        F.col("modifier").alias("GEAR_MODIFIER_DESCRIPTION"))
    return df.drop("modifier"), tickets


def test_landings(landing_tables):
    extract = L.landings_extract(*landing_tables)
    assert {r["catch_report_source_pk"]: r["gear"] for r in extract.collect()} == {
        "p1": "POT_HARD", "p2": "POT_UNKN", "p3": "POT_HARD", "p4": "POT_MESH",
        "p5": "POT_UNKN", "p6": "POT_UNKN", "p7": "HAL"}
    only_hard = L.landings_extract(*landing_tables, kinds=["Hard Pots"])
    assert only_hard.filter("gear is null").count() == 1
    done = {r["catch_report_source_pk"]: r["newgear"] for r in L.attribute_gear(extract).collect()}
    assert done == {"p1": "POT_HARD", "p2": "POT_HARD", "p3": "POT_HARD", "p4": "POT_MESH",
                    "p5": "POT_UNKN_MIXED", "p6": "POT_UNKN", "p7": "HAL"}
    report = landings_report(*landing_tables, gears=("HAL", "POT_HARD", "POT_MESH", "POT_UNKN"))
    summary = report["summary"]()
    assert summary.filter("fmp_subarea = 'BS'").count() == 0
    shares = summary.groupBy("year", "fmp_subarea").agg(F.sum("proportion_catch").alias("s"))
    assert all(r["s"] == pytest.approx(1) for r in shares.collect())
    assert report["unresolved"]().count() == 0
    assert report["too_few"]().count() == extract.select("year", "fmp_subarea").distinct().count()
    matrix = report["ambiguous_vessels"]().collect()
    assert [(r["vessel_id"], r["POT_HARD"], r["POT_MESH"], r["HAL"]) for r in matrix] == [
        ("v2", 4.0, 8.0, 0.0)]
    assert [r["ves_akr_name"] for r in report["unidentified_vessels"]().collect()] == ["Nv3"]
