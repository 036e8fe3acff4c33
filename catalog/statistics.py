"""Ordered computations, tests, density, histogram and box statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.tables import r, register
from haulframe.operators.ordered import ecdf, interpolate, quantiles, row_positions
from haulframe.operators.ranking import rank_by_median
from haulframe.operators.stats import (
    boxplot,
    histogram,
    kernel_density,
    ks_test,
    outliers,
    profile_correlation,
    standardized_profile,
    welch_statistic,
    welch_test,
)

QUERIES: dict = {}


@register(QUERIES, """
    SELECT o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS year,
      round(quantile_cont(o_totalprice, 0.5), 4) AS median,
      round(quantile_cont(o_totalprice, 0.9), 4) AS p90
    FROM orders GROUP BY ALL
""")
def median_by_group(t):
    rows = t.orders.select("o_orderpriority", F.year("o_orderdate").alias("year"), "o_totalprice")
    return quantiles(
        rows, ["o_orderpriority", "year"], "o_totalprice", {"median": 0.5, "p90": 0.9}
    ).withColumns({"median": r("median", 4), "p90": r("p90", 4)})


@register(QUERIES, """
    SELECT round(quantile_cont(l_extendedprice, 0.25), 4) AS q1,
      round(quantile_cont(l_extendedprice, 0.5), 4) AS median,
      round(quantile_cont(l_extendedprice, 0.75), 4) AS q3 FROM lineitem
""")
def median_overall(t):
    q = quantiles(
        t.lineitem.select("l_extendedprice"), [], "l_extendedprice",
        {"q1": 0.25, "median": 0.5, "q3": 0.75},
    )
    return q.select(*[r(c, 4).alias(c) for c in q.columns])


@register(QUERIES, """
    SELECT DISTINCT l_returnflag, l_quantity, round(cume_dist() OVER
      (PARTITION BY l_returnflag ORDER BY l_quantity), 8) AS ecdf
    FROM lineitem
""")
def ecdf_by_group(t):
    rows = t.lineitem.select("l_returnflag", "l_quantity")
    return ecdf(rows, ["l_returnflag"], "l_quantity").withColumn("ecdf", r("ecdf", 8))


@register(QUERIES, """
    SELECT DISTINCT o_totalprice, round(cume_dist() OVER (ORDER BY o_totalprice), 8) AS ecdf
    FROM orders
""")
def ecdf_overall(t):
    return ecdf(t.orders.select("o_totalprice"), [], "o_totalprice").withColumn(
        "ecdf", r("ecdf", 8)
    )


@register(QUERIES, """
    SELECT event_id, event_type,
      row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS position
    FROM events
""")
def positions_in_group(t):
    return row_positions(t.events.select("event_id", "event_type"), ["event_type"], ["event_id"])


GAPS_SQL = """
    WITH e AS (SELECT event_id, {key} AS key, CASE WHEN {known} THEN value END AS v,
                 row_number() OVER (PARTITION BY {key} ORDER BY event_id) AS pos
               FROM events),
         k AS (SELECT *,
                 last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS p0,
                 last_value(v IGNORE NULLS) OVER a AS v0,
                 first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS p1,
                 first_value(v IGNORE NULLS) OVER b AS v1,
                 count(v) OVER (PARTITION BY key) AS n_known
               FROM e
               WINDOW a AS (PARTITION BY key ORDER BY pos
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                      b AS (PARTITION BY key ORDER BY pos
                            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, key, v, CASE
        WHEN v IS NOT NULL OR n_known < 2 THEN v
        WHEN p0 IS NOT NULL AND p1 IS NOT NULL THEN v0 + (v1 - v0) / (p1 - p0) * (pos - p0)
        ELSE coalesce(v0, v1) END AS filled
    FROM k
"""


def _gaps(t, key, known):
    rows = t.events.select(
        "event_id", F.expr(key).alias("key"), F.expr(f"CASE WHEN {known} THEN value END").alias("v")
    )
    return interpolate(rows, ["key"], ["event_id"], "v", "filled")


@register(QUERIES, GAPS_SQL.format(
    key="user_id", known="event_type NOT IN ('click', 'view', 'error')"))
def interpolate_gaps(t):
    return _gaps(t, "user_id", "event_type NOT IN ('click', 'view', 'error')")


@register(QUERIES, GAPS_SQL.format(key="event_type", known="value > 150"))
def interpolate_long_gaps(t):
    return _gaps(t, "event_type", "value > 150")


@register(QUERIES, """
    WITH m AS (SELECT p_brand, quantile_cont(p_retailprice, 0.5) AS median
               FROM part GROUP BY ALL)
    SELECT p_brand, round(median, 6) AS median, dense_rank() OVER (ORDER BY median DESC) AS rank
    FROM m
""")
def category_rank(t):
    return rank_by_median(t.part, "p_brand", "p_retailprice").withColumn("median", r("median"))


@register(QUERIES, """
    WITH m AS (SELECT avg(l_quantity) FILTER (l_linestatus = 'O') AS mx,
                 avg(l_quantity) FILTER (l_linestatus = 'F') AS my,
                 var_samp(l_quantity) FILTER (l_linestatus = 'O') AS vx,
                 var_samp(l_quantity) FILTER (l_linestatus = 'F') AS vy,
                 count(*) FILTER (l_linestatus = 'O') AS nx,
                 count(*) FILTER (l_linestatus = 'F') AS ny FROM lineitem)
    SELECT round((mx - my) / sqrt(vx / nx + vy / ny), 6) AS t,
      round(pow(vx / nx + vy / ny, 2)
            / (pow(vx / nx, 2) / (nx - 1) + pow(vy / ny, 2) / (ny - 1)), 3) AS df,
      round(sqrt(vx / nx + vy / ny), 8) AS stderr,
      round(mx, 6) AS mean_x, round(my, 6) AS mean_y, nx AS n_x, ny AS n_y
    FROM m
""")
def welch_t(t):
    s = welch_statistic(t.lineitem, "l_linestatus", "l_quantity", "O", "F")
    return s.withColumns(
        {"t": r("t"), "df": r("df", 3), "stderr": r("stderr", 8),
         "mean_x": r("mean_x"), "mean_y": r("mean_y")}
    )


@register(QUERIES, """
    WITH m AS (SELECT avg(value) FILTER (event_type = 'click') AS mx,
                 avg(value) FILTER (event_type = 'purchase') AS my,
                 var_samp(value) FILTER (event_type = 'click') AS vx,
                 var_samp(value) FILTER (event_type = 'purchase') AS vy,
                 count(*) FILTER (event_type = 'click') AS nx,
                 count(*) FILTER (event_type = 'purchase') AS ny FROM events),
         s AS (SELECT *, mx - my AS gap, sqrt(vx / nx + vy / ny) AS se,
                 pow(vx / nx + vy / ny, 2)
                   / (pow(vx / nx, 2) / (nx - 1) + pow(vy / ny, 2) / (ny - 1)) AS df FROM m),
         -- the tail is an integral of cos^(df-1); Simpson's rule over its width
         a AS (SELECT *, atan(abs(gap / se) / sqrt(df)) AS a0,
                 least(pi() / 2, atan(abs(gap / se) / sqrt(df)) + 40 / sqrt(df)) AS a1,
                 exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()) AS c FROM s),
         p AS (SELECT any_value(gap) AS gap, any_value(se) AS se, any_value(df) AS df,
                 any_value(nx) AS nx, any_value(ny) AS ny,
                 any_value(mx) AS mx, any_value(my) AS my,
                 2 * any_value(c) * any_value(a1 - a0) / 20000 / 3
                   * sum(CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
                         * pow(cos(a0 + (a1 - a0) * i / 20000), df - 1)) AS p
               FROM a, range(20001) r(i)),
         -- expansion of the t quantile around the normal one
         q AS (SELECT *, z + (z * z * z + z) / (4 * df)
                 + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96 * df * df)
                 + (3 * pow(z, 7) + 19 * pow(z, 5) + 17 * pow(z, 3) - 15 * z)
                   / (384 * pow(df, 3)) AS q
               FROM p, (SELECT CAST(1.959963984540054 AS DOUBLE) AS z))
    SELECT round(gap / se, 6) AS t, round(df, 3) AS df, round(p, 7) AS p_value,
      round(gap - q * se, 6) AS ci_lo, round(gap + q * se, 6) AS ci_hi,
      round(mx, 6) AS mean_x, round(my, 6) AS mean_y, nx AS n_x, ny AS n_y
    FROM q
""")
def welch_p_and_interval(t):
    test = welch_test(t.events, "event_type", "value", "click", "purchase")
    digits = {"df": 3, "p_value": 7}
    return test.withColumns(
        {c: r(c, digits.get(c, 6)) for c in test.columns if not c.startswith("n_")}
    )


KS_SQL = """
    WITH c AS (SELECT {value} AS v, count(*) FILTER ({x}) AS a, count(*) FILTER ({y}) AS b
               FROM {table} WHERE ({x}) OR ({y}) GROUP BY 1),
         u AS (SELECT v, sum(a) OVER w AS ua, sum(b) OVER w AS ub,
                 sum(a) OVER () AS na, sum(b) OVER () AS nb FROM c
               WINDOW w AS (ORDER BY v)),
         d AS (SELECT max(abs(ua / na - ub / nb)) AS D, max(na)::DOUBLE AS na,
                 max(nb)::DOUBLE AS nb FROM u),
         s AS (SELECT *, D * sqrt(na * nb / (na + nb)) AS z FROM d),
         p AS (SELECT *, list_transform(range(1, 101), lambda k: CAST(k AS DOUBLE)) AS ks FROM s)
    SELECT round(D, 8) AS "D", round(least(1.0, greatest(0.0, CASE
        WHEN z < 1e-3 THEN 1.0
        WHEN z < 1 THEN 1 - sqrt(2 * pi()) / z * list_sum(list_transform(ks,
          lambda k: exp(-pow(2 * k - 1, 2) * pi() * pi() / (8 * z * z))))
        ELSE list_sum(list_transform(ks,
          lambda k: CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2 * k * k * z * z)))
        END)), 8) AS p_value,
      CAST(na AS BIGINT) AS n_x, CAST(nb AS BIGINT) AS n_y
    FROM p
"""


def _ks(df, group, value, x, y):
    return ks_test(df, group, value, x, y).withColumns(
        {"D": r("D", 8), "p_value": r("p_value", 8)}
    )


@register(QUERIES, KS_SQL.format(
    table="lineitem", value="l_quantity", x="l_linestatus = 'O'", y="l_linestatus = 'F'"))
def ks_two_sample(t):
    return _ks(t.lineitem, "l_linestatus", "l_quantity", "O", "F")


@register(QUERIES, KS_SQL.format(
    table="events", value="value", x="event_type = 'click'", y="event_type = 'purchase'"))
def ks_continuous(t):
    return _ks(t.events, "event_type", "value", "click", "purchase")


@register(QUERIES, """
    WITH c AS (SELECT event_type AS k, value AS v, count(*) AS n FROM events GROUP BY ALL),
         m AS (SELECT event_type AS k, count(*) AS nn, stddev_samp(value) AS sd,
                 quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr
               FROM events GROUP BY ALL),
         lim AS (SELECT min(value) AS x0, max(value) AS x1 FROM events),
         s AS (SELECT k, nn, x0, x1, 0.9 * 1.2 * least(sd, iqr / 1.34) * pow(nn, -0.2) AS bw
               FROM m, lim),
         g AS (SELECT *, x0 - 4 * bw AS lo, (x1 - x0 + 8 * bw) / 511 AS step FROM s),
         a AS (SELECT c.k, n / nn AS w, (v - lo) / step AS pos FROM c JOIN g USING (k)),
         b AS (SELECT k, floor(pos) AS node, sum(w * (1 - (pos - floor(pos)))) AS w FROM a GROUP BY ALL
               UNION ALL
               SELECT k, floor(pos) + 1, sum(w * (pos - floor(pos))) FROM a GROUP BY ALL),
         bb AS (SELECT k, node, sum(w) AS w FROM b GROUP BY ALL),
         pts AS (SELECT g.*, CAST(point AS INTEGER) AS point,
                   x0 + (x1 - x0) * point / 511 AS x FROM g, range(512) t(point))
    SELECT pts.k AS event_type, point, round(x, 8) AS x,
      round(sum(w * exp(-0.5 * pow((x - (lo + node * step)) / bw, 2)))
            / (any_value(bw) * sqrt(2 * pi())), 8) AS density
    FROM pts JOIN bb ON pts.k = bb.k GROUP BY pts.k, point, x
""")
def density_curves(t):
    rows = t.events.select("event_type", "value")
    return kernel_density(rows, ["event_type"], "value", adjust=1.2).withColumns(
        {"x": r("x", 8), "density": r("density", 8)}
    )


@register(QUERIES, """
    WITH lim AS (SELECT l_linenumber AS panel, min(l_quantity) AS x0,
                   (max(l_quantity) - min(l_quantity)) / 29 AS w FROM lineitem GROUP BY ALL),
         n AS (SELECT l_linenumber AS panel, l_linestatus AS g, count(*) AS n FROM lineitem GROUP BY ALL),
         b AS (SELECT l_linenumber AS panel, l_linestatus AS g, x0, w,
                 greatest(ceil((l_quantity - (x0 - w / 2)) / w - 1e-8), 1) AS bin
               FROM lineitem JOIN lim ON l_linenumber = panel),
         c AS (SELECT panel, g, bin, count(*) AS k FROM b GROUP BY ALL),
         every AS (SELECT panel, g, x0, w, n, bin
                   FROM n JOIN lim USING (panel), range(1, 31) t(bin))
    SELECT panel AS l_linenumber, g AS l_linestatus, CAST(bin AS INTEGER) AS bin,
      round(x0 + (bin - 1) * w, 8) AS center, round(w, 8) AS width, coalesce(k, 0) AS n,
      round(CASE WHEN g = 'F' THEN 0.0 - coalesce(k, 0) / (n * w)
                 ELSE coalesce(k, 0) / (n * w) END, 8) AS density
    FROM every LEFT JOIN c USING (panel, g, bin)
""")
def histogram_mirrored(t):
    rows = t.lineitem.select("l_linenumber", "l_linestatus", "l_quantity")
    return histogram(
        rows, ["l_linenumber", "l_linestatus"], "l_quantity", 30, ["l_linenumber"],
        F.col("l_linestatus") == "F",
    ).withColumns({c: r(c, 8) for c in ("center", "width", "density")})


BOX_SQL = """
    WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1,
                 quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
               FROM events GROUP BY ALL),
         e AS (SELECT *, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
               FROM events JOIN q USING (event_type))
"""


@register(QUERIES, BOX_SQL + """
    SELECT event_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
      min(value) FILTER (inside) AS lower, max(value) FILTER (inside) AS upper,
      count(*) FILTER (NOT inside) AS n_outliers, count(*) AS n
    FROM e GROUP BY event_type, q1, median, q3
""")
def boxplot_stats(t):
    box = boxplot(t.events.select("event_type", "value"), ["event_type"], "value")
    return box.withColumns({c: r(c) for c in ("q1", "median", "q3")})


@register(QUERIES, BOX_SQL + """
    SELECT event_type, value, count(*) AS n FROM e WHERE NOT inside GROUP BY ALL
""")
def boxplot_outliers(t):
    return outliers(t.events.select("event_type", "value"), ["event_type"], "value")


PROFILE_SQL = """
    WITH s AS (SELECT l_linestatus AS g, l_returnflag AS f,
                 CASE WHEN l_linestatus = 'O' AND l_quantity > 45 THEN l_quantity + 100
                      ELSE l_quantity END AS x,
                 sum(l_extendedprice) AS v FROM lineitem GROUP BY ALL),
         z AS (SELECT *, (v - avg(v) OVER w) / stddev_samp(v) OVER w AS std FROM s
               WINDOW w AS (PARTITION BY g, f))
"""


def _profile_rows(t):
    """All lines; some quantities are moved, so that the profiles have gaps."""
    moved = F.when(
        (F.col("l_linestatus") == "O") & (F.col("l_quantity") > 45), F.col("l_quantity") + 100
    ).otherwise(F.col("l_quantity"))
    return t.lineitem.select(
        "l_linestatus", "l_returnflag", moved.alias("l_quantity"), "l_extendedprice"
    )


@register(QUERIES, PROFILE_SQL + """
    SELECT a.f AS l_returnflag, round(corr(a.std, b.std), 6) AS cor
    FROM z a JOIN z b ON a.f = b.f AND a.x = b.x AND a.g = 'O' AND b.g = 'F' GROUP BY ALL
""")
def profile_correlations(t):
    return profile_correlation(
        _profile_rows(t), "l_linestatus", ("O", "F"), ["l_quantity"], ["l_returnflag"],
        "l_extendedprice",
    ).withColumn("cor", r("cor"))


@register(QUERIES, PROFILE_SQL + """
    SELECT g AS l_linestatus, f AS l_returnflag, x AS l_quantity,
      round(v, 2) AS l_extendedprice, round(std, 6) AS std FROM z
""")
def standardized_profiles(t):
    return standardized_profile(
        _profile_rows(t), "l_linestatus", ["l_quantity"], ["l_returnflag"], "l_extendedprice"
    ).withColumns({"l_extendedprice": r("l_extendedprice", 2), "std": r("std")})
