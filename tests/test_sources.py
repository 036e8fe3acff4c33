import gzip

import pytest
from pyspark.sql import functions as F

from haulframe.operators.rows import matching_columns, preview, rename_all
from haulframe.sources.database import connection_options, scan_options
from haulframe.sources.files import UnknownHeader, literal_table, read_csv, read_tagged
from haulframe.sources.sinks import write_csv, write_one_csv, write_report, write_table
from haulframe.sources.scratch import drop_scratch, materialize, materialize_measured, scratch_dir

SCHEMA = "gear string, skate int, length string, pot_size string"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "part 2.csv").write_text(
        "skate,gear,length,pot_size\n3,POT,F050,Large\nx,POT,M060,NA\n"
    )
    (tmp_path / "part 1.csv").write_text("gear,skate,length\nHAL,1,F048\nHAL,2,\n")
    (tmp_path / "notes.txt").write_text("not a table\n")
    return str(tmp_path)


def test_columns_are_matched_by_name(spark, folder):
    rows = read_csv(spark, folder, SCHEMA, "part *.csv").orderBy("row_seq").collect()
    assert [tuple(r)[:4] for r in rows] == [
        ("HAL", 1, "F048", None), ("HAL", 2, None, None),
        ("POT", 3, "F050", "Large"), ("POT", None, "M060", None),
    ]


def test_aliases_and_missing_folder(spark, folder):
    renamed = read_csv(spark, folder, "gear string, unit int", "part *.csv",
                       aliases={"skate": "unit"})
    assert sorted(r["unit"] or 0 for r in renamed.collect()) == [0, 1, 2, 3]
    with pytest.raises(FileNotFoundError):
        read_csv(spark, folder, SCHEMA, "absent*.csv")


def test_line_order_over_split_files(spark, tmp_path):
    """Files cut into many blocks keep the order of their lines."""
    for name, start in (("b", 50_000), ("a", 0)):
        lines = "\n".join(f"{start + i},{'x' * (i % 40)}" for i in range(50_000))
        (tmp_path / f"{name}.csv").write_text("n,pad\n" + lines + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        df = read_csv(spark, str(tmp_path), "n long, pad string")
        assert df.rdd.getNumPartitions() > 10
        for same in (False, True):
            rows = read_csv(spark, str(tmp_path), "n long, pad string", same_header=same)
            got = [r["n"] for r in rows.orderBy("row_seq").select("n").collect()]
            assert got == list(range(100_000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_no_file_is_lost(spark, tmp_path):
    (tmp_path / "a.csv").write_text("gear,skate\nPOT,1\nskate,2\n")
    (tmp_path / "b.csv").write_text("Gear, Skate \nHAL,3\n")
    (tmp_path / "c.csv").write_text('"gear, type",skate,"Gear"\n"x, y",4,HAL\n')
    (tmp_path / "d.csv").write_text("")
    rows = read_csv(spark, str(tmp_path), "gear string, skate int").orderBy("row_seq").collect()
    assert [(r["gear"], r["skate"]) for r in rows] == [
        ("POT", 1), ("skate", 2), ("HAL", 3), ("HAL", 4)]
    (tmp_path / "e.csv").write_text("other,names\n1,2\n")
    with pytest.raises(UnknownHeader, match="e.csv"):
        read_csv(spark, str(tmp_path), "gear string, skate int")
    (tmp_path / "e.csv").write_text("gear,skate,GEAR\n1,2,3\n")
    with pytest.raises(UnknownHeader, match="e.csv"):
        read_csv(spark, str(tmp_path), "gear string, skate int")


def test_many_tiny_files_of_two_headers(spark, tmp_path):
    for i in range(10_000):
        header = "skate,gear" if i == 7_000 else "gear,skate"
        row = f"{i},POT" if i == 7_000 else f"POT,{i}"
        (tmp_path / f"{i:05}.csv").write_text(f"{header}\n{row}\n")
    rows = read_csv(spark, str(tmp_path), "gear string, skate int")
    seen = rows.orderBy("row_seq").select("gear", "skate").collect()
    assert seen == [("POT", i) for i in range(10_000)]
    (tmp_path / "07001.csv").write_text("other\n1\n")
    with pytest.raises(UnknownHeader, match="07001.csv"):
        read_csv(spark, str(tmp_path), "gear string, skate int")


def test_files_are_opened_by_tasks(spark, folder, tmp_path, monkeypatch):
    import haulframe.sources.files as files

    def never(*_):
        raise AssertionError("the driver opened a file")

    monkeypatch.setattr(files, "first_line", never)
    assert read_csv(spark, folder, SCHEMA, "part *.csv").count() == 4
    with gzip.open(tmp_path / "part 3.csv.gz", "wt") as packed:
        packed.write("length,gear\nF099,HAL\n")
    assert read_csv(spark, folder, SCHEMA, "part *").filter("length = 'F099'").count() == 1
    # in a store that Python does not reach, the driver opens them
    monkeypatch.setattr(files, "_reachable", lambda _: False)
    with pytest.raises(AssertionError, match="driver opened"):
        read_csv(spark, folder, SCHEMA, "part *.csv")
    monkeypatch.undo()
    monkeypatch.setattr(files, "_reachable", lambda _: False)
    assert read_csv(spark, folder, SCHEMA, "part *.csv").count() == 4


def test_years_from_folder_names_are_pruned(spark, tmp_path):
    for year in (2021, 2022, 2023):
        (tmp_path / f"year={year}").mkdir()
        names = "gear,skate" if year < 2023 else "skate,gear"
        row = f"POT,{year}" if year < 2023 else f"{year},POT"
        (tmp_path / f"year={year}" / "a.csv").write_text(f"{names}\n{row}\n")
    rows = read_csv(spark, str(tmp_path), "gear string, skate int", tag="year")
    assert rows.columns == ["gear", "skate", "year", "row_seq"]
    assert sorted((r.gear, r.skate, r.year) for r in rows.collect()) == [
        ("POT", y, y) for y in (2021, 2022, 2023)]
    one = rows.filter("year = 2022")
    assert [r.skate for r in one.collect()] == [2022]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "(year#" in plan.split("PartitionFilters: [", 1)[1]


def test_tagged_folders_are_one_read(spark, tmp_path):
    for name, text in (("a b", "gear,skate\nPOT,1\n"), ("ab", "skate\n2\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.csv").write_text(text)
    both = read_tagged(spark, {2021: str(tmp_path / "a b"), 2022: str(tmp_path / "ab")},
                       "gear string, skate int")
    assert sorted((r.year, r.skate, r.gear) for r in both.collect()) == [
        (2021, 1, "POT"), (2022, 2, None)]


def test_same_header_is_checked(spark, tmp_path):
    (tmp_path / "a.csv").write_text("gear,skate\nPOT,1\n")
    (tmp_path / "b.csv").write_text("skate,gear\n2,HAL\n")
    with pytest.raises(Exception, match="header"):
        read_csv(spark, str(tmp_path), "gear string, skate int", same_header=True).collect()


def test_tagged_years(spark, folder):
    both = read_tagged(spark, {2021: folder, 2022: folder}, SCHEMA, pattern="part *.csv")
    assert {r["year"]: r["count"] for r in both.groupBy("year").count().collect()} == {
        2021: 4, 2022: 4}


def test_sinks(spark, tmp_path):
    df = literal_table(spark, [(1, "a"), (2, None)], "id int, s string")
    write_csv(df, str(tmp_path / "c"))
    back = read_csv(spark, str(tmp_path / "c"), "id int, s string", "*.csv")
    assert {(r["id"], r["s"]) for r in back.collect()} == {(1, "a"), (2, None)}
    text = "".join(p.read_text() for p in (tmp_path / "c").glob("*.csv"))
    assert "2,NA" in text
    write_table(df, str(tmp_path / "t"), by=["id"])
    assert spark.read.parquet(str(tmp_path / "t")).filter("id = 2").count() == 1
    write_report(df.limit(1), str(tmp_path / "r"))
    assert list((tmp_path / "r").glob("*.csv"))


def test_one_file_with_one_header(spark, tmp_path):
    rows = spark.range(5_000).selectExpr("id % 7 AS k", "id", "if(id = 3, NULL, 'a, b') AS `s.t`")
    path = tmp_path / "out" / "one.csv"
    path.parent.mkdir()
    path.write_text("before\n")
    write_one_csv(rows.repartition(6), str(path), [F.desc("k"), F.col("id")])
    lines = path.read_text().splitlines()
    assert lines[0] == "k,id,s.t" and len(lines) == 5_001
    want = sorted(((i % 7, i) for i in range(5_000)), key=lambda r: (-r[0], r[1]))
    assert [tuple(map(int, x.split(",")[:2])) for x in lines[1:]] == want
    assert '3,3,NA' in lines and lines[1].endswith('"a, b"')
    assert sorted(p.name for p in path.parent.iterdir() if not p.name.startswith(".")) == ["one.csv"]
    write_one_csv(rows.limit(0), str(path))
    assert path.read_text().splitlines() == ["k,id,s.t"]


def test_nothing_is_left_of_a_failed_file(spark, tmp_path):
    path = tmp_path / "one.csv"
    path.write_text("before\n")
    broken = spark.range(100).selectExpr("if(id = 77, raise_error('no'), id) AS x")
    with pytest.raises(Exception, match="no"):
        write_one_csv(broken, str(path))
    assert path.read_text() == "before\n"
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["one.csv"]


def test_database_options(spark):
    spark.conf.set("haulframe.jdbc.catch.url", "jdbc:x://host/db")
    spark.conf.set("haulframe.jdbc.catch.user", "reader")
    options = scan_options(spark, "catch", "shared.landings", ("year", "2015", "2022", 8))
    assert options["url"] == "jdbc:x://host/db" and options["user"] == "reader"
    assert options["dbtable"] == "shared.landings"
    assert (options["partitionColumn"], options["numPartitions"]) == ("year", "8")
    assert "password" not in options
    with pytest.raises(KeyError):
        connection_options(spark, "unknown")


def test_names_and_preview(spark):
    df = rename_all(spark.createDataFrame([(2, 3), (1, 4)], "REPORT_ID int, Year int"))
    assert df.columns == ["report_id", "year"]
    assert matching_columns(df, "report_id|ticket") == ["report_id"]
    assert [r["report_id"] for r in preview(df, [df.report_id], 1).collect()] == [1]


def test_scratch_follows_the_session(spark, tmp_path):
    """The folder the cluster names wins over a local one."""
    named = str(tmp_path / "shared")

    class Conf:
        def get(self, key, default=None):
            return named if key == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

        class sparkContext:
            master = "local[2]"

    assert scratch_dir(Session()) == named
    assert scratch_dir(spark) == scratch_dir(spark) != named


def test_no_local_folder_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError):
        scratch_dir(Session())


def test_a_local_folder_off_a_local_master_is_proven(spark, tmp_path):
    import haulframe.sources.scratch as scratch

    scratch._prove_shared(spark, f"file://{tmp_path}/x")  # one machine: both sides see it
    assert len(list((tmp_path / "x").rglob("part-*"))) == 2
    before = set((tmp_path / "x").rglob("*"))
    scratch._prove_shared(spark, f"file://{tmp_path}/x")
    assert set((tmp_path / "x").rglob("*")) == before


def test_size_is_observed_while_writing(spark):
    table, size = materialize_measured(spark.range(10).selectExpr("id", "'abc' AS s"))
    assert table.count() == 10 and size == 10 * (16 + 32 + 3)


def test_scratch_tables_can_be_dropped(spark, tmp_path, monkeypatch):
    import haulframe.sources.scratch as scratch

    monkeypatch.setattr(scratch, "scratch_dir", lambda _: str(tmp_path))
    (tmp_path / "haulframe" / "another").mkdir(parents=True)
    assert materialize(spark.range(3)).count() == 3
    assert len(list((tmp_path / "haulframe").iterdir())) == 2
    assert drop_scratch(spark)
    assert [p.name for p in (tmp_path / "haulframe").iterdir()] == ["another"]


def test_field_files_beside_a_folder_that_may_not_be_listed(monkeypatch):
    from tests import test_golden

    def refused(_):
        raise PermissionError

    monkeypatch.delenv("HAULFRAME_GOLDEN", raising=False)
    monkeypatch.setattr(test_golden.Path, "iterdir", refused)
    assert test_golden.field_files() == {}
