import random

import pytest
from pyspark.sql import functions as F

from haulframe.operators import sketches as K
from haulframe.plans import synthesis as Y


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(4)
    rows = [(2020 + i % 3, "hot" if i % 2 else f"g{i % 8}", rng.lognormvariate(3, 1), i % 700)
            for i in range(30_000)]
    return spark.createDataFrame(rows, "year int, g string, x double, v int").cache(), rows


def test_merged_sketches_are_within_their_error(values):
    df, rows = values
    kept = K.sketches(df, ["year", "g"], {"qs": "x"}, {"ds": "v"})
    merged = K.merge_sketches(kept, ["g"], ["qs"], ["ds"])
    probs = (0.0, 0.1, 0.5, 0.99, 1.0)
    found = merged.select("g", "n", K.distinct_of("ds").alias("d"), F.array(
        *[K.quantile_of("qs", p) for p in probs]).alias("qs")).collect()
    assert len(found) == 5
    for r in found:
        own = sorted(x for _, g, x, _ in rows if g == r.g)
        assert r.n == len(own)
        for p, q in zip(probs, r.qs):
            below, upto = sum(x < q for x in own), sum(x <= q for x in own)
            assert below - K.RANK_ERROR * r.n <= p * r.n <= upto + K.RANK_ERROR * r.n
        true = len({v for _, g, _, v in rows if g == r.g})
        assert abs(r.d - true) <= K.COUNT_ERROR * true


def test_few_values_are_exact_and_none_are_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 9.0), ("b", None)], "g string, x double")
    kept = K.sketches(df, ["g"], {"q": "x"}, {"d": "x"})
    got = {r.g: r for r in kept.select(
        "g", "n", K.quantile_of("q", 0.5).alias("m"), K.distinct_of("d").alias("d")).collect()}
    assert (got["a"].m, got["a"].d, got["a"].n) == (2.0, 3, 3)
    assert got["b"].m is None and got["b"].d == 0 and got["b"].n == 1
    merged = K.merge_sketches(kept, [], ["q"], ["d"]).select(K.quantile_of("q", 1.0).alias("m"))
    assert merged.first().m == 9.0
    assert K.sketches(df.limit(0), ["g"], {"q": "x"}, {}).collect() == []


def test_facets_come_from_two_passes(spark, tmp_path):
    rows = [(y, g, s, float(y % 7 + i)) for y in (1, 2, 3) for g in "ab" for i, s in enumerate("MFU")]
    spark.createDataFrame(rows, "year int, gear string, sex string, length double").write.parquet(
        str(tmp_path / "fish"))
    fish = spark.read.parquet(str(tmp_path / "fish"))
    facets = [["gear"], ["gear", "year"], ["sex"], []]
    got = {tuple(r)[:4]: r.median for r in Y.medians_by_facets(fish, facets).collect()}
    for by in facets:
        keys = [F.col(k) for k in by]
        want = fish.groupBy(*keys).agg(F.median("length").alias("m")).collect()
        for r in want:
            at = ("_".join(by), *(r[k] if k in by else None for k in ("gear", "year", "sex")))
            assert got[at] == r.m
    assert len(got) == 2 + 6 + 3 + 1
    rows, keys = Y.facet_rows(fish, facets[:3], ["length"])
    plan = rows.groupBy(*keys).count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1


def test_kept_sketches_of_years(spark):
    fish = spark.createDataFrame(
        [(y, "g", float(i)) for y in (1, 2) for i in range(101)], "year int, gear string, length double")
    kept = Y.year_sketches(fish, ["year", "gear"])
    got = Y.medians_from_sketches(kept, ["gear"]).first()
    assert got.n == 202 and abs(got.median - 50) <= 2
