import random

import pytest
from pyspark.sql import functions as F

from haulframe.functions import nulls as N
from haulframe.functions import text as X


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [(1, "a", 2.0), (2, None, 4.0), (3, "b", None), (4, "NA", 8.0), (5, "", 10.0)],
        "id int, s string, x double",
    )


def values(df, column="v"):
    return [r[column] for r in df.orderBy("id").collect()]


def test_condition_spreads_null(rows):
    got = rows.withColumn("v", N.if_else_na(F.col("s") == "a", F.lit("yes"), F.lit("no")))
    assert values(got) == ["yes", None, "no", "no", "no"]


def test_membership(rows):
    kept = rows.filter(N.not_member("s", ["a"]))
    assert [r["id"] for r in kept.orderBy("id").collect()] == [2, 3, 4, 5]
    assert [r["id"] for r in rows.filter(N.is_member("s", ["a"])).collect()] == [1]


def test_case_without_default_and_recode(rows):
    got = rows.withColumn("v", N.case_na((F.col("s") == "a", F.lit(1)), (F.col("s") == "b", F.lit(2))))
    assert values(got) == [1, None, 2, None, None]
    got = rows.withColumn("v", N.recode("s", {"a": "z"}, keep_other=True))
    assert values(got) == ["z", None, "b", "NA", ""]


def test_strict_aggregates(rows):
    r = rows.agg(
        N.strict(F.sum("x"), "x").alias("strict"), F.sum("x").alias("skipping"),
        N.strict(F.sum("id"), "id").alias("whole"),
        N.distinct_with_null("s").alias("d"),
    ).first()
    assert (r["strict"], r["skipping"], r["whole"], r["d"]) == (None, 24.0, 15, 5)


def test_ratio_and_correlation_never_raise(spark):
    df = spark.createDataFrame(
        [("c", 1.0, 2.0), ("c", 1.0, 3.0), ("one", 1.0, 1.0), ("v", 1.0, 2.0),
         ("v", 2.0, 4.0), ("v", None, 9.0)],
        "k string, x double, y double",
    )
    got = {r["k"]: r["c"] for r in df.groupBy("k").agg(N.safe_corr("x", "y").alias("c")).collect()}
    assert got["c"] is None and got["one"] is None
    assert got["v"] == pytest.approx(1.0)
    assert df.select(N.safe_ratio("x", F.lit(0)).alias("r")).first()["r"] is None


def test_text(rows):
    assert values(rows.withColumn("v", X.blank_to_null("s"))) == ["a", None, "b", None, None]
    got = rows.withColumn("v", X.join_text("_", "id", "s", show_na=True))
    assert values(got)[1] == "2_NA"
    got = rows.withColumn("v", X.join_text("_", "id", "s"))
    assert values(got)[1] == "2"
    r = rows.select(
        X.big_int(F.lit(1267)).alias("n"), X.fixed(F.lit(0.125), 2).alias("f"),
        X.to_number(F.lit("x")).alias("bad"), X.to_number(F.lit("063")).alias("ok"),
        X.parse_date(F.lit("2021/07/24")).cast("string").alias("d"),
        X.parse_date(F.lit("July")).alias("nodate"),
        X.floor_to(F.lit(433.0), 25).alias("b"),
        X.leading_letters(F.lit("F048")).alias("sex"),
        X.trailing_number(F.lit("F048")).alias("len"),
        X.leading_letters(F.lit("048")).alias("nosex"),
        X.clock_hours(F.lit(1457)).alias("h"),
        X.fixed(F.lit(None).cast("double"), 1).alias("nofix"),
    ).first()
    assert (r["n"], r["f"], r["bad"], r["ok"]) == ("1,267", "0.13", None, 63.0)
    assert (r["d"], r["nodate"], r["b"]) == ("2021-07-24", None, 425)
    assert (r["sex"], r["len"], r["nosex"], r["nofix"]) == ("F", 48.0, None, None)
    assert r["h"] == pytest.approx(14.95)


def test_rounding_of_the_stored_value(spark):
    rng = random.Random(1)
    xs = [0.125, 0.375, 0.15, 0.25, 0.35, 2.675, 1.005, 0.5, 1.5, 2.5, -0.125, -0.375, -2.5, -0.15,
          0.0, 1e15 + 0.5, 4503599627370496.0, -1e300, 5e-324, 0.045, 1e22]
    xs += [rng.uniform(-1000, 1000) for _ in range(2_000)]
    xs += [rng.randrange(-5_000, 5_000) / 16 for _ in range(500)]
    xs += [rng.randrange(-5_000, 5_000) / 1000 for _ in range(2_000)]
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    for digits in (0, 1, 2, 3):
        got = df.select("x", X.round_stored("x", digits).alias("r"),
                        X.fixed_stored("x", digits).alias("t")).collect()
        for r in got:
            # Python formats the stored value exactly, ties to the even digit
            want = f"{r.x:.{digits}f}"
            assert r.r == float(want), (r.x, digits)
            if abs(r.x) < 1e12:
                assert float(r.t) == float(want) and len(r.t.split(".")[-1]) in (digits, len(r.t))
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "x double")
    got = [r[0] for r in odd.select(X.round_stored("x", 2)).collect()]
    assert got[0] is None and got[1] != got[1] and got[2] == float("inf")
