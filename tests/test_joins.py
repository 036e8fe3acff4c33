import pytest
from pyspark.sql import functions as F

from haulframe.operators import joins as J
from haulframe.operators.ordered import interpolate, row_positions
from haulframe.operators.window import (
    attach_group_stats,
    group_max_rows,
    group_share,
    zscore,
)


@pytest.fixture
def nothing_is_small(spark):
    """Force the path for tables too large to broadcast."""
    spark.conf.set("haulframe.broadcast.bytes", "0")
    yield
    spark.conf.unset("haulframe.broadcast.bytes")


@pytest.fixture(scope="module")
def uneven(spark):
    """One key holds a third of the rows, one key is missing."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        F.concat(F.lit("k"), (F.col("id") % 900).cast("string"))
    )
    return spark.range(3000).select(
        "id",
        F.when(F.col("id") % 50 == 1, F.lit(None)).otherwise(key).alias("key"),
        (F.col("id") % 7).cast("double").alias("x"),
    ).cache()


def table_of(rows):
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"))


def sorted_rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_attach_both_ways_agree(spark, uneven, nothing_is_small):
    far = J.attach(uneven, table_of(uneven), ["key"])
    assert far.count() == 3000
    far_rows = sorted_rows(far)
    spark.conf.unset("haulframe.broadcast.bytes")
    near_rows = sorted_rows(J.attach(uneven, table_of(uneven), ["key"]))
    assert far_rows == near_rows
    assert far.filter("key is null and n is null").count() == 0


def final_plan(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.index("Final Plan"):plan.index("Initial Plan")]


def test_small_tables_leave_the_rows_where_they_are(spark, tmp_path):
    spark.range(3000).selectExpr("id", "id % 7 AS key").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    table = rows.groupBy("key").agg(F.sum("id").alias("total"))
    near = final_plan(J.attach(rows, table, ["key"]))
    assert "BroadcastHashJoin" in near and "SortMergeJoin" not in near
    # one shuffle of partial sums, of which the other readings take their share
    assert near.count("Scan parquet") == 2
    spark.conf.set("haulframe.broadcast.bytes", "0")
    far = final_plan(J.attach(rows, table, ["key"]))
    spark.conf.unset("haulframe.broadcast.bytes")
    assert "SortMergeJoin" in far


def test_a_hot_key_of_a_large_table_is_split(spark, tmp_path, nothing_is_small):
    spark.range(200_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"),
    ).repartition(16).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    table = spark.range(200_000).select(F.col("id").alias("k"), F.col("id").alias("v"))
    small = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        joined = J.attach(rows, table, ["k"])
        assert joined.filter("v = k").count() == 200_000
        assert "skew=true" in final_plan(joined)
    finally:
        for k in small:
            spark.conf.unset(k)


def test_a_hot_partition_of_a_file_join_is_split(spark, tmp_path):
    """Adaptive execution splits the hot key of an unhinted join."""
    rows = spark.range(200_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"),
    )
    rows.repartition(16).write.parquet(str(tmp_path / "rows"))
    spark.range(200_000).select(F.col("id").alias("k"), F.col("id").alias("v")).write.parquet(
        str(tmp_path / "table"))
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        joined = J.lookup(
            spark.read.parquet(str(tmp_path / "rows")),
            spark.read.parquet(str(tmp_path / "table")), ["k"])
        assert len(joined.collect()) == 200_000
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("how", ["left_semi", "left_anti", "inner"])
def test_attach_other_kinds(spark, uneven, nothing_is_small, how):
    chosen = uneven.filter("x = 3 and id < 400").select("key").distinct()
    far = sorted_rows(J.attach(uneven, chosen, ["key"], how))
    spark.conf.unset("haulframe.broadcast.bytes")
    assert far == sorted_rows(J.attach(uneven, chosen, ["key"], how))


def test_unique_check(spark):
    left = spark.createDataFrame([(1, "a")], "k int, a string")
    right = spark.createDataFrame([(1, "x"), (1, "y")], "k int, b string")
    assert J.lookup(left, right, ["k"]).count() == 2
    checked = J.lookup(left, right, ["k"], expect_unique=True)
    with pytest.raises(Exception, match=r'repeated key \{"k":1\}'):
        checked.collect()
    once = J.lookup(left, right.limit(1), ["k"], expect_unique=True).first()
    assert (once.k, once.a, once.b in "xy") == (1, "a", True)
    with pytest.raises(Exception, match="repeated key"):
        J.attach(left, right, ["k"], unique=True).collect()


def test_names_with_dots_and_tables_of_keys_only(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], ["k.x", "v.y"])
    right = spark.createDataFrame([(1, 5), (None, 6)], ["k.x", "w.z"])
    got = J.attach(left, right, ["k.x"])
    assert got.columns == ["k.x", "v.y", "w.z"]
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "a", 5), (3, "c", None), (None, "b", 6)]
    kept = J.attach(left, right.select("`k.x`"), ["k.x"], "left_semi")
    assert sorted(r[1] for r in kept.collect()) == ["a", "b"]
    assert J.attach(left, right.limit(0), ["k.x"], "inner").collect() == []


def jobs_of(spark, build):
    spark.sparkContext.setJobGroup("built", "")
    frame = build()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("built"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return frame, jobs


def test_no_job_before_the_first_action(spark, uneven):
    for build in (
        lambda: J.attach(uneven, table_of(uneven), ["key"], unique=True),
        lambda: group_share(uneven, ["key"], "x"), lambda: zscore(uneven, ["key"], "x"),
        lambda: group_max_rows(uneven, ["key"], "x"),
        lambda: J.lookup(uneven, table_of(uneven), ["key"], expect_unique=True),
        lambda: interpolate(uneven, ["key"], ["id"], "x", "y"),
        lambda: row_positions(uneven, ["key"], ["id"]),
    ):
        frame, jobs = jobs_of(spark, build)
        frame.explain()
        assert jobs == 0


def test_missing_keys_match(spark):
    left = spark.createDataFrame([(None, "a"), (2, "b")], "k int, a string")
    right = spark.createDataFrame([(None, "x"), (3, "y")], "k int, b string")
    got = {tuple(r) for r in J.lookup(left, right, ["k"], null_safe=True).select("k", "a", "b").collect()}
    assert got == {(None, "a", "x"), (2, "b", None)}
    full = {tuple(r) for r in J.full_outer(left, right, ["k"]).select("k", "a", "b").collect()}
    assert full == {(None, "a", "x"), (2, "b", None), (3, None, "y")}


def test_unions_and_enrichment(spark):
    a = spark.createDataFrame([(1, "p")], "id int, only_a string")
    b = spark.createDataFrame([(2,)], "id int")
    got = {tuple(r) for r in J.tagged_union({2021: a, 2022: b}, "year").select("id", "only_a", "year").collect()}
    assert got == {(1, "p", 2021), (2, None, 2022)}
    rows = spark.createDataFrame([(1, None), (2, "own"), (3, None)], "id int, v string")
    known = spark.createDataFrame([(1, "found"), (2, "other")], "id int, w string")
    filled = {tuple(r) for r in J.enrich_missing(rows, known, ["id"], "v", "w").select("id", "v").collect()}
    assert filled == {(1, "found"), (2, "own"), (3, None)}


def test_group_results_on_rows(spark, uneven, nothing_is_small):
    shares = group_share(uneven, ["key"], "x").groupBy("key").agg(F.sum("prop").alias("s"))
    assert all(r["s"] is None or abs(r["s"] - 1) < 1e-9 for r in shares.collect())
    z = zscore(uneven, ["key"], "x").filter("key = 'hot'").agg(
        F.avg("std").alias("m"), F.stddev_samp("std").alias("s")
    ).first()
    assert z["m"] == pytest.approx(0, abs=1e-9) and z["s"] == pytest.approx(1)
    single = zscore(spark.createDataFrame([("a", 1.0)], "k string, x double"), ["k"], "x")
    assert single.first()["std"] is None
    top = group_max_rows(uneven, ["key"], "x")
    want = uneven.join(
        uneven.groupBy("key").agg(F.max("x").alias("x")).withColumnRenamed("key", "k2"), "x"
    ).filter("key <=> k2").count()
    assert top.count() == want


def test_stats_on_rows(spark):
    rows = spark.createDataFrame(
        [("a", 1, 5.0), ("a", 2, 7.0), ("a", 3, 7.0), ("a", 4, 5.0), ("b", 5, None)],
        "k string, seq int, x double",
    )
    got = {r["seq"]: r for r in attach_group_stats(rows, ["k"], "x", "seq").collect()}
    assert (got[2]["n"], got[2]["mean"], got[2]["median"], got[2]["mode"]) == (4, 6.0, 6.0, 5.0)
    assert got[5]["mean"] is None and got[5]["n"] == 1 and got[5]["median"] is None
