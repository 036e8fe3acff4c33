import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from haulframe.functions.smirnov import exact_p
from haulframe.functions.student_t import quantile, two_sided_p
from haulframe.operators import ordered as O
from haulframe.operators import stats as ST
from haulframe.operators.aggregate import first_seen_mode, with_subtotals
from haulframe.operators.ranking import fixed_rank, rank_by_median
from haulframe.operators.reshape import pivot_longer, pivot_wider


@pytest.fixture(scope="module", autouse=True)
def many_pieces(spark):
    """Small groups still span several pieces."""
    spark.conf.set(O.PIECE_ROWS_KEY, "10")
    yield
    spark.conf.unset(O.PIECE_ROWS_KEY)


@pytest.fixture(scope="module")
def sample(spark):
    rng = random.Random(7)
    rows = [
        ("hot" if i % 3 else f"g{i % 40}", i, round(rng.gauss(60, 9), 1)) for i in range(2400)
    ]
    return spark.createDataFrame(rows, "g string, seq long, x double").cache(), rows


def by_group(rows):
    out = {}
    for g, seq, x in rows:
        out.setdefault(g, []).append((seq, x))
    return out


def test_the_hot_group_spans_pieces(sample):
    df, _ = sample
    pieces = O.in_pieces(df, ["g"], ["seq"])
    assert pieces.filter("g = 'hot'").select(O.PIECE).distinct().count() > 1
    sizes = [r["count"] for r in pieces.groupBy(O.PIECE).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1200


def test_pieces_depend_on_the_row_alone(sample):
    df, _ = sample
    again = df.repartition(7, "x").sortWithinPartitions(F.desc("seq"))
    keyed = [{(r.g, r.seq): r[O.PIECE] for r in O.in_pieces(d, ["g"], ["seq"]).collect()}
             for d in (df, again)]
    assert keyed[0] == keyed[1]
    # pieces follow each other along the order
    last = None
    for _, piece in sorted(keyed[0].items()):
        assert last is None or piece >= last
        last = piece


def test_a_small_table_is_one_piece(spark, sample):
    df, _ = sample
    spark.conf.unset(O.PIECE_ROWS_KEY)
    try:
        assert {r[0] for r in O.in_pieces(df, ["g"], ["seq"]).select(O.PIECE).collect()} == {0}
    finally:
        spark.conf.set(O.PIECE_ROWS_KEY, "10")


def test_running_totals(sample):
    df, rows = sample
    got = O.running_totals(df, ["g"], ["seq"], {"s": F.col("seq")}, {"s": "all"}).collect()
    want = {}
    for g, items in by_group(rows).items():
        upto = 0
        for seq, _ in sorted(items):
            upto += seq
            want[seq] = (upto, sum(i for i, _ in items))
    assert {r["seq"]: (r["s"], r["all"]) for r in got} == want


def test_quantiles_and_ecdf(spark, sample):
    df, rows = sample
    got = {r["g"]: r for r in O.quantiles(df, ["g"], "x", {"m": 0.5, "q": 0.25}).collect()}
    for g, items in by_group(rows).items():
        xs = sorted(x for _, x in items)
        at = (len(xs) - 1) * 0.25
        lo = math.floor(at)
        assert got[g]["m"] == pytest.approx(statistics.median(xs))
        assert got[g]["q"] == pytest.approx(xs[lo] + (xs[math.ceil(at)] - xs[lo]) * (at - lo))
    e = O.ecdf(df, ["g"], "x").filter("g = 'hot'").collect()
    xs = [x for _, x in by_group(rows)["hot"]]
    for r in e:
        assert r["ecdf"] == pytest.approx(sum(x <= r["x"] for x in xs) / len(xs))
    approx = O.quantiles(df, ["g"], "x", {"m": 0.5}, approx=True).filter("g = 'hot'").first()
    assert approx["m"] == pytest.approx(got["hot"]["m"], abs=0.5)


def test_located_quantiles_survive_far_outliers_and_constants(spark):
    xs = [1.0, 1.25, 1.5, 2.0, 1e12]
    df = spark.createDataFrame(
        [("far", x) for x in xs] + [("flat", 3.0)] * 4 + [("gap", None)], "g string, x double")
    got = {r["g"]: r for r in O.quantiles(df, ["g"], "x", {"m": 0.5, "q": 0.1, "top": 1.0}).collect()}
    assert (got["far"]["m"], got["far"]["q"], got["far"]["top"]) == (1.5, 1.1, 1e12)
    assert got["flat"]["m"] == 3.0 and "gap" not in got


def test_quantiles_of_few_values(spark):
    """Every group size from one up, at every rank, also ranks between brackets."""
    rows = [(n, float(i * i)) for n in range(1, 14) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, x double")
    probs = {f"p{i}": i / 20 for i in range(21)}
    for r in O.quantiles(df, ["g"], "x", probs).collect():
        for name, p in probs.items():
            at = (r["g"] - 1) * p
            lo, hi = float(math.floor(at) ** 2), float(math.ceil(at) ** 2)
            assert r[name] == pytest.approx(lo + (hi - lo) * (at - math.floor(at)))


def test_quantiles_of_a_heavy_tail_shuffle_few_values(spark):
    df = spark.range(200_000).selectExpr("1 AS g", "exp(40 * pow(id / 200000, 8)) AS x")
    got = O.quantiles(df, ["g"], "x", {"m": 0.5, "q": 0.999}).first()
    want = df.selectExpr("percentile(x, 0.5)", "percentile(x, 0.999)").first()
    assert (got["m"], got["q"]) == (pytest.approx(want[0]), pytest.approx(want[1]))
    counts = O.bracketed_counts(df, ["g"], "x", {"m": 0.5})
    assert counts.count() < 500


def interpolated(values, hold=True):
    known = [(i, v) for i, v in enumerate(values) if v is not None]
    if len(known) < 2:
        return values
    out = []
    for i, v in enumerate(values):
        before = [k for k in known if k[0] <= i]
        after = [k for k in known if k[0] >= i]
        if v is not None:
            out.append(v)
        elif before and after:
            (a, x), (b, y) = before[-1], after[0]
            out.append(x + (y - x) * (i - a) / (b - a))
        else:
            out.append((before[-1] if before else after[0])[1] if hold else None)
    return out


@pytest.mark.parametrize("hold", [True, False])
def test_interpolation_across_pieces(spark, hold):
    rng = random.Random(3)
    rows = []
    for g, share in (("hot", 0.01), ("b", 0.3), ("none", 0.0), ("c", 0.9)):
        for i in range(900 if g == "hot" else 40):
            rows.append((g, i * 3, float(rng.randint(1, 99)) if rng.random() < share else None))
    rows += [("single", 0, None), ("single", 1, 5.0), ("single", 2, None)]
    df = spark.createDataFrame(rows, "g string, seq int, v double")
    got = {}
    for r in O.interpolate(df, ["g"], ["seq"], "v", "f", hold).orderBy("g", "seq").collect():
        got.setdefault(r["g"], []).append(r["f"])
    want = {}
    for g, seq, v in sorted(rows, key=lambda r: (r[0], r[1])):
        want.setdefault(g, []).append(v)
    for g, values in want.items():
        assert got[g] == pytest.approx(interpolated(values, hold)), g


def test_first_seen_mode(spark):
    df = spark.createDataFrame(
        [("a", 1, 9.0), ("a", 2, 3.0), ("a", 3, 3.0), ("a", 4, 9.0), ("b", 5, 1.0)],
        "g string, seq int, x double",
    )
    assert {tuple(r) for r in first_seen_mode(df, ["g"], "x", "seq").collect()} == {
        ("a", 9.0), ("b", 1.0)}


def test_subtotals(spark):
    df = spark.createDataFrame([("p", "s1", 1.0), ("p", None, 3.0), ("q", "s1", 5.0)],
                               "g string, s string, x double")
    got = {(r["g"], r["s"], r["m"]) for r in
           with_subtotals(df, ["g"], "s", "All", {"m": F.avg("x")}).collect()}
    assert got == {("p", "s1", 1.0), ("p", None, 3.0), ("p", "All", 2.0),
                   ("q", "s1", 5.0), ("q", "All", 5.0)}


@pytest.mark.parametrize("limit", ["0", "1000000"])
def test_ranks(spark, limit):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 9.0), ("c", 2.0), ("d", None)],
                               "g string, x double")
    spark.conf.set("haulframe.broadcast.bytes", limit)
    got = {r["g"]: r["rank"] for r in rank_by_median(df, "g", "x").collect()}
    spark.conf.unset("haulframe.broadcast.bytes")
    assert got == {"b": 1, "a": 2, "c": 2}
    ranks = [r[0] for r in df.orderBy("g").select(fixed_rank("g", ["b", "a"])).collect()]
    assert ranks == [2, 2, 1, None, None]


def test_pivots(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (2, "a", 7)], "id int, k string, v int")
    wide = pivot_wider(df, ["id"], "k", "v", ["a", "b"], fill=0)
    assert {tuple(r) for r in wide.collect()} == {(1, 5, 6), (2, 7, 0)}
    assert pivot_wider(df, ["id"], "k", "v").columns == ["id", "a", "b"]
    long = pivot_longer(wide, ["a", "b"], "k", "v")
    assert long.count() == 4 and set(long.columns) == {"id", "k", "v"}
    with pytest.raises(Exception, match="more than one value"):
        pivot_wider(df.union(df), ["id"], "k", "v", ["a", "b"]).collect()
    with pytest.raises(Exception, match="outside the levels"):
        pivot_wider(df, ["id"], "k", "v", ["a"]).collect()


def test_student_t():
    # textbook values
    assert quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-6)
    assert quantile(0.975, 1) == pytest.approx(12.706205, abs=1e-5)
    assert two_sided_p(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert two_sided_p(0.0, 5) == pytest.approx(1.0)


def test_welch_small_samples(spark):
    df = spark.createDataFrame([("x", v) for v in (1.0, 2.0, 3.0, 4.0)]
                               + [("y", v) for v in (2.0, 4.0, 6.0, 8.0, 10.0)],
                               "g string, v double")
    r = ST.welch_test(df, "g", "v", "x", "y").first()
    vx, vy = statistics.variance([1, 2, 3, 4]) / 4, statistics.variance([2, 4, 6, 8, 10]) / 5
    assert r["t"] == pytest.approx((2.5 - 6) / math.sqrt(vx + vy))
    assert r["df"] == pytest.approx((vx + vy) ** 2 / (vx**2 / 3 + vy**2 / 4))
    assert r["ci_lo"] < -3.5 < r["ci_hi"]
    empty = ST.welch_test(df, "g", "v", "x", "nobody").first()
    assert empty["t"] is None and empty["p_value"] is None


def test_ks(spark):
    xs, ys = [1.0, 2.0, 3.5, 7.0], [2.5, 6.0, 8.0, 9.0, 10.0]
    df = spark.createDataFrame([("x", v) for v in xs] + [("y", v) for v in ys], "g string, v double")
    gap = max(abs(sum(a <= p for a in xs) / 4 - sum(b <= p for b in ys) / 5) for p in xs + ys)
    r = ST.ks_test(df, "g", "v", "x", "y", exact=True).first()
    back = ST.ks_test(df, "g", "v", "y", "x", exact=True).first()
    assert r["D"] == pytest.approx(gap) == back["D"]
    assert r["p_value"] == pytest.approx(back["p_value"])
    # every ordering of the pooled sample, counted one by one
    from itertools import combinations

    n = hits = 0
    for chosen in combinations(range(9), 4):
        i = j = 0
        worst = 0.0
        for k in range(9):
            i, j = (i + 1, j) if k in chosen else (i, j + 1)
            worst = max(worst, abs(i / 4 - j / 5))
        n, hits = n + 1, hits + (worst >= gap - 1e-9)
    assert r["p_value"] == pytest.approx(hits / n)
    assert exact_p(0.0, 3, 3) == 1.0
    assert ST.ks_test(df, "g", "v", "x", "none").first()["D"] is None


def test_exact_ks_with_ties_equals_enumeration(spark):
    from itertools import combinations

    rng = random.Random(3)
    for n, m, levels in ((4, 5, 3), (5, 5, 4), (3, 7, 6), (6, 4, 2)):
        xs = [float(rng.randrange(levels)) for _ in range(n)]
        ys = [float(rng.randrange(levels)) for _ in range(m)]
        pooled = sorted(xs + ys)

        def gap(a, b):
            return max(abs(sum(v <= p for v in a) / n - sum(v <= p for v in b) / m)
                       for p in pooled)

        seen = [gap([pooled[i] for i in c], [pooled[i] for i in range(n + m) if i not in c])
                for c in combinations(range(n + m), n)]
        want = sum(g >= gap(xs, ys) - 1e-9 for g in seen) / len(seen)
        df = spark.createDataFrame([("x", v) for v in xs] + [("y", v) for v in ys],
                                   "g string, v double")
        r = ST.ks_test(df, "g", "v", "x", "y", exact=True).first()
        assert r["D"] == pytest.approx(gap(xs, ys)) and r["p_value"] == pytest.approx(want)


def test_exact_ks_of_large_samples_nears_the_limit():
    n, m, d = 3_000, 2_000, 0.05
    scaled = d * math.sqrt(n * m / (n + m))
    limit = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * scaled * scaled) for k in range(1, 50))
    assert exact_p(d, n, m) == pytest.approx(limit, rel=0.05)
    # small tails keep their digits
    assert 0 < exact_p(0.9, 200, 300) < 1e-60


def test_density_matches_the_direct_sum(sample):
    df, rows = sample
    got = ST.kernel_density(df.filter("g = 'hot'"), ["g"], "x", 1.2).orderBy("point").collect()
    xs = sorted(x for _, x in by_group(rows)["hot"])

    def q(p):
        at = (len(xs) - 1) * p
        lo = math.floor(at)
        return xs[lo] + (xs[math.ceil(at)] - xs[lo]) * (at - lo)

    bw = 0.9 * min(statistics.stdev(xs), (q(0.75) - q(0.25)) / 1.34) * len(xs) ** -0.2 * 1.2
    assert len(got) == 512
    for r in got[::37]:
        direct = sum(math.exp(-0.5 * ((r["x"] - x) / bw) ** 2) for x in xs) / (
            len(xs) * bw * math.sqrt(2 * math.pi))
        assert r["density"] == pytest.approx(direct, abs=2e-4 * max(g["density"] for g in got))
    step = got[1]["x"] - got[0]["x"]
    assert sum(r["density"] for r in got) * step == pytest.approx(1.0, abs=0.02)


def test_histogram(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(30)] + [("b", 3.0)], "g string, x double")
    got = ST.histogram(df, ["g"], "x", 30, mirrored=F.col("g") == "b").collect()
    assert sum(r["n"] for r in got if r["g"] == "a") == 30
    total = sum(r["density"] * r["width"] for r in got if r["g"] == "a")
    assert total == pytest.approx(1.0)
    assert sorted(r["density"] < 0 for r in got if r["g"] == "b") == [False] * 29 + [True]
    flat = ST.histogram(df.filter("g = 'b'"), ["g"], "x").collect()
    assert sorted(r["n"] for r in flat) == [0] * 29 + [1]
    assert sorted(r["bin"] for r in flat) == list(range(1, 31))


def test_density_of_a_single_value_has_rows(spark):
    df = spark.createDataFrame([("one", 3.0), ("two", 1.0), ("two", 2.0)], "g string, x double")
    got = ST.kernel_density(df, ["g"], "x", points=16).collect()
    assert sum(r["g"] == "one" for r in got) == 16
    assert all((r["density"] is None) == (r["g"] == "one") for r in got)


def test_boxplot(spark):
    xs = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 30.0]
    df = spark.createDataFrame([("a", v) for v in xs], "g string, x double")
    r = ST.boxplot(df, ["g"], "x").first()
    assert (r["q1"], r["median"], r["q3"]) == (2.75, 4.5, 6.25)
    assert (r["lower"], r["upper"], r["n_outliers"], r["n"]) == (1.0, 7.0, 1, 8)
    assert [tuple(o) for o in ST.outliers(df, ["g"], "x").collect()] == [("a", 30.0, 1)]


def test_profile_correlation(spark):
    rows = [(g, d, float(v)) for g, vs in (("H", [1, 4, 2, 8]), ("P", [2, 8, 4, 16]))
            for d, v in enumerate(vs)] + [("H", 9, 100.0)]
    df = spark.createDataFrame(rows, "gear string, d int, n double")
    assert ST.profile_correlation(df, "gear", ("H", "P"), ["d"], [], "n").first()["cor"] == pytest.approx(1.0)
    flat = df.filter("gear = 'H'").unionAll(
        spark.createDataFrame([("P", d, 1.0) for d in range(4)], df.schema))
    assert ST.profile_correlation(flat, "gear", ("H", "P"), ["d"], [], "n").first()["cor"] is None
