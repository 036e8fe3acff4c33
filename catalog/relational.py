"""Projection, filters, joins, aggregates, reshape and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.tables import r, register
from haulframe.functions.nulls import (
    case_na,
    distinct_with_null,
    if_else_na,
    is_member,
    not_member,
    recode,
    safe_ratio,
    strict,
)
from haulframe.functions.text import (
    big_int,
    fixed,
    fixed_stored,
    floor_to,
    join_text,
    parse_date,
)
from haulframe.operators.aggregate import (
    correlation,
    count_where,
    cv,
    first_seen_mode,
    group_counts,
    screen,
    share_check,
    std_error,
    with_subtotals,
)
from haulframe.operators.joins import (
    attach,
    bind_by_key,
    enrich_missing,
    exclude,
    flag_members,
    full_outer,
    lookup,
    restrict,
    tagged_union,
)
from haulframe.operators.ranking import arrange, fixed_rank
from haulframe.operators.reshape import pivot_longer, pivot_wider
from haulframe.operators.rows import add_steps, drop_missing, fill_missing, pick
from haulframe.operators.stats import bar_totals
from haulframe.operators.window import (
    attach_group_stats,
    group_max_rows,
    group_share,
    zscore,
)

QUERIES: dict = {}


@register(QUERIES, """
    SELECT o_orderkey AS order_id, o_totalprice AS price, o_orderstatus AS status
    FROM orders
    WHERE o_totalprice BETWEEN 100000 AND 300000 AND o_orderstatus <> 'P'
      AND NOT (o_orderstatus = 'F' AND o_totalprice > 200000)
""")
def scan_project_filter(t):
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    kept = t.orders.filter(
        price.between(100000, 300000)
        & (status != "P")
        & ~((status == "F") & (price > 200000))
    )
    return pick(kept, order_id="o_orderkey", price="o_totalprice", status="o_orderstatus")


@register(QUERIES, """
    WITH masked AS (
      SELECT event_id, user_id,
             CASE WHEN event_type <> 'signup' THEN event_type END AS kind
      FROM events)
    SELECT event_id, user_id, kind FROM masked
    WHERE (kind NOT IN ('click', 'view') OR kind IS NULL)
    UNION ALL
    SELECT event_id, user_id, kind FROM masked WHERE kind IN ('view')
""")
def membership_filters(t):
    masked = t.events.select(
        "event_id", "user_id",
        F.when(F.col("event_type") != "signup", F.col("event_type")).alias("kind"),
    )
    return masked.filter(not_member("kind", ["click", "view"])).union(
        masked.filter(is_member("kind", ["view"])))


@register(QUERIES, """
    SELECT p_partkey, p_name, p_brand FROM part
    WHERE regexp_matches(p_name, 'widget|gear')
""")
def regex_predicate(t):
    return t.part.filter(F.col("p_name").rlike("widget|gear")).select(
        "p_partkey", "p_name", "p_brand"
    )


@register(QUERIES, """
    SELECT event_id, CAST(2024 AS INTEGER) AS year,
      CASE event_type WHEN 'click' THEN 'Seen' WHEN 'view' THEN 'Seen'
                      WHEN 'purchase' THEN 'Kept' END AS label,
      CASE WHEN event_type = 'error' THEN 0.0
           WHEN event_type <> 'error' THEN value END AS counted,
      CASE event_type WHEN 'error' THEN 'Door open' ELSE event_type END AS relabelled
    FROM events
""")
def recode_cases(t):
    kind = F.col("event_type")
    return add_steps(
        t.events.select("event_id", "event_type", "value"),
        ("year", F.lit(2024)),
        ("label", case_na((kind.isin("click", "view"), F.lit("Seen")),
                          (kind == "purchase", F.lit("Kept")))),
        ("counted", if_else_na(kind == "error", F.lit(0.0), F.col("value"))),
        ("relabelled", recode("event_type", {"error": "Door open"}, keep_other=True)),
    ).drop("event_type", "value")


@register(QUERIES, """
    SELECT event_id, user_id, event_type, kind,
           coalesce(kind, 'none') AS filled
    FROM (SELECT event_id, user_id, event_type,
                 CASE WHEN event_type IN ('click', 'view', 'error') THEN event_type END AS kind,
                 CASE WHEN user_id % 7 <> 0 THEN value END AS known
          FROM events)
    WHERE known IS NOT NULL
""")
def missing_values(t):
    kind = F.col("event_type")
    rows = t.events.select(
        "event_id", "user_id", "event_type",
        F.when(kind.isin("click", "view", "error"), kind).alias("kind"),
        F.when(F.col("user_id") % 7 != 0, F.col("value")).alias("known"),
    )
    kept = drop_missing(rows, ["known"]).withColumn("filled", F.col("kind"))
    return fill_missing(kept, {"filled": "none"}).drop("known")


@register(QUERIES, """
    SELECT c_custkey, c_name, n_name, r_name
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN region ON n_regionkey = r_regionkey
""")
def lookup_join(t):
    nations = t.nation.withColumnRenamed("n_nationkey", "c_nationkey")
    regions = t.region.withColumnRenamed("r_regionkey", "n_regionkey")
    named = lookup(t.customer, nations, ["c_nationkey"], expect_unique=True)
    return lookup(named, regions, ["n_regionkey"], expect_unique=True).select(
        "c_custkey", "c_name", "n_name", "r_name"
    )


@register(QUERIES, """
    WITH pairs AS (SELECT l_partkey, l_suppkey, count(*) AS pair_lines
                   FROM lineitem GROUP BY ALL)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
           o_orderstatus, o_custkey, pair_lines
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
    LEFT JOIN pairs USING (l_partkey, l_suppkey)
""")
def keyed_left_join(t):
    orders = t.orders.select(
        F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_custkey"
    )
    keys = ["l_partkey", "l_suppkey"]
    rows = t.lineitem.select("l_orderkey", "l_linenumber", *keys, "l_extendedprice")
    pairs = group_counts(rows, keys, "pair_lines")
    return attach(lookup(rows, orders, ["l_orderkey"]), pairs, keys)


@register(QUERIES, """
    SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
""")
def anti_exclusion(t):
    omitted = t.orders.filter("o_orderstatus = 'P'").select(
        F.col("o_orderkey").alias("l_orderkey")
    )
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return exclude(rows, omitted, ["l_orderkey"])


@register(QUERIES, """
    SELECT c_custkey, c_name, c_mktsegment FROM customer
    WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey
                        HAVING count(DISTINCT o_orderpriority) > 3)
""")
def semi_selection(t):
    chosen = screen(
        t.orders, ["o_custkey"],
        {"n": F.count_distinct("o_orderpriority")}, F.col("n") > 3,
    ).select(F.col("o_custkey").alias("c_custkey"))
    return restrict(
        t.customer.select("c_custkey", "c_name", "c_mktsegment"), chosen, ["c_custkey"]
    )


@register(QUERIES, """
    WITH c AS (SELECT CASE WHEN c_nationkey <> 3 THEN c_nationkey END AS nation,
                      count(*) AS customers FROM customer GROUP BY 1),
         s AS (SELECT CASE WHEN s_nationkey <> 3 THEN s_nationkey + 1 END AS nation,
                      count(*) AS suppliers FROM supplier GROUP BY 1)
    SELECT coalesce(c.nation, s.nation) AS nation,
           coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers
    FROM c FULL JOIN s ON c.nation IS NOT DISTINCT FROM s.nation
""")
def full_outer_counts(t):
    def counts(table, nation, moved, name):
        masked = F.when(F.col(nation) != 3, F.col(nation) + moved).alias("nation")
        return group_counts(table.select(masked), ["nation"], name)

    both = full_outer(
        counts(t.customer, "c_nationkey", 0, "customers"),
        counts(t.supplier, "s_nationkey", 1, "suppliers"),
        ["nation"],
    )
    return fill_missing(both, {"customers": 0, "suppliers": 0})


@register(QUERIES, """
    WITH big AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity = 50)
    SELECT o_orderkey, o_totalprice,
      CASE WHEN o_orderkey IN (SELECT l_orderkey FROM big) THEN 'Large' ELSE 'Small' END
        AS size
    FROM orders
""")
def self_flag(t):
    large = t.lineitem.filter("l_quantity = 50").select(
        F.col("l_orderkey").alias("o_orderkey")
    )
    flagged = flag_members(
        t.orders.select("o_orderkey", "o_totalprice"), large, ["o_orderkey"], "is_large"
    )
    size = F.when(F.col("is_large"), F.lit("Large")).otherwise(F.lit("Small"))
    return flagged.withColumn("size", size).drop("is_large")


@register(QUERIES, """
    WITH c AS (SELECT c_nationkey AS nation, count(*) AS customers,
                      round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1),
         s AS (SELECT s_nationkey AS nation, min(s_acctbal) AS least, max(s_acctbal) AS most
               FROM supplier GROUP BY 1)
    SELECT nation, customers, balance, least, most FROM c FULL JOIN s USING (nation)
""")
def keyed_bind(t):
    left = t.customer.groupBy(F.col("c_nationkey").alias("nation")).agg(
        F.count(F.lit(1)).alias("customers"), r(F.sum("c_acctbal"), 2).alias("balance")
    )
    right = t.supplier.groupBy(F.col("s_nationkey").alias("nation")).agg(
        F.min("s_acctbal").alias("least"), F.max("s_acctbal").alias("most")
    )
    return bind_by_key(left, right, ["nation"])


@register(QUERIES, """
    SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, 'customer' AS kind
    FROM customer
    UNION ALL SELECT s_suppkey, s_name, NULL, 'supplier' FROM supplier
""")
def union_missing_columns(t):
    return tagged_union(
        {
            "customer": pick(t.customer, id="c_custkey", name="c_name", segment="c_mktsegment"),
            "supplier": pick(t.supplier, id="s_suppkey", name="s_name"),
        },
        "kind",
    )


@register(QUERIES, """
    SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END,
                                c_mktsegment) AS class
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey
""")
def enrich_from_lookup(t):
    rows = t.orders.select(
        "o_orderkey", "o_custkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("class"),
    )
    known = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return enrich_missing(rows, known, ["o_custkey"], "class", "c_mktsegment").drop(
        "o_custkey"
    )


@register(QUERIES, """
    SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL
""")
def daily_counts(t):
    return group_counts(
        t.events.select("event_type", F.to_date("ts").alias("day")), ["event_type", "day"]
    )


@register(QUERIES, """
    SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem
""")
def distinct_rows(t):
    return t.lineitem.select("l_suppkey", "l_returnflag", "l_linestatus").distinct()


@register(QUERIES, """
    SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers,
      count(DISTINCT CASE WHEN l_partkey % 5 <> 0 THEN l_partkey END)
        + max(CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END) AS parts
    FROM lineitem GROUP BY ALL
""")
def distinct_counts(t):
    part = F.when(F.col("l_partkey") % 5 != 0, F.col("l_partkey"))
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count_distinct("l_suppkey").alias("suppliers"),
        distinct_with_null(part).alias("parts"),
    )


@register(QUERIES, """
    SELECT user_id, count(*) FILTER (event_type = 'error' AND value > 100) AS n_error
    FROM events GROUP BY ALL
""")
def conditional_count_zero(t):
    return t.events.groupBy("user_id").agg(
        count_where((F.col("event_type") == "error") & (F.col("value") > 100)).alias("n_error")
    )


@register(QUERIES, """
    SELECT event_type, count(*) AS n, round(sum(value), 4) AS total,
      round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd,
      round(stddev_samp(value) / avg(value), 1) AS cv,
      round(stddev_samp(value) / sqrt(count(value)), 6) AS se,
      min(value) AS least, max(value) AS most,
      CASE WHEN count(value) = count(*) THEN round(avg(value), 6) END AS mean_strict,
      CASE WHEN count(*) = count(*) FILTER (user_id % 50 <> 0)
        THEN round(avg(value), 6) END AS mean_with_gaps
    FROM events GROUP BY ALL
""")
def moments_by_group(t):
    gappy = F.when(F.col("user_id") % 50 != 0, F.col("value"))
    return t.events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        r(F.sum("value"), 4).alias("total"),
        r(F.avg("value")).alias("mean"),
        r(F.stddev_samp("value")).alias("sd"),
        cv("value", 1).alias("cv"),
        r(std_error("value")).alias("se"),
        F.min("value").alias("least"),
        F.max("value").alias("most"),
        strict(r(F.avg("value")), "value").alias("mean_strict"),
        strict(r(F.avg(gappy)), gappy).alias("mean_with_gaps"),
    )


@register(QUERIES, """
    SELECT CAST(sum(l_quantity) AS BIGINT) AS quantity, count(*) AS n,
           round(corr(l_quantity, l_extendedprice), 6) AS cor
    FROM lineitem
""")
def global_totals(t):
    from haulframe.functions.nulls import safe_corr

    return t.lineitem.agg(
        F.sum("l_quantity").cast("long").alias("quantity"),
        F.count(F.lit(1)).alias("n"),
        r(safe_corr("l_quantity", "l_extendedprice")).alias("cor"),
    )


@register(QUERIES, """
    WITH n AS (SELECT l_suppkey, l_quantity, count(*) AS c,
                 min(l_orderkey * 2097152 + l_partkey) AS f
               FROM lineitem GROUP BY ALL)
    SELECT l_suppkey, arg_min(l_quantity, struct_pack(a := -c, b := f)) AS mode
    FROM n GROUP BY ALL
""")
def first_seen_modes(t):
    seq = F.col("l_orderkey") * 2097152 + F.col("l_partkey")
    return first_seen_mode(t.lineitem, ["l_suppkey"], "l_quantity", seq)


@register(QUERIES, """
    SELECT l_returnflag, l_linenumber,
      round(corr(l_quantity, l_extendedprice), 6) AS cor
    FROM lineitem GROUP BY ALL
""")
def pearson_by_group(t):
    return correlation(
        t.lineitem, ["l_returnflag", "l_linenumber"], "l_quantity", "l_extendedprice"
    ).withColumn("cor", r("cor"))


@register(QUERIES, """
    SELECT l_linestatus, coalesce(l_returnflag, 'All') AS l_returnflag,
      round(avg(l_quantity), 6) AS mean, count(*) AS n
    FROM lineitem GROUP BY GROUPING SETS ((l_linestatus, l_returnflag), (l_linestatus))
""")
def subtotal_rows(t):
    return with_subtotals(
        t.lineitem, ["l_linestatus"], "l_returnflag", "All",
        {"mean": r(F.avg("l_quantity")), "n": F.count(F.lit(1))},
    )


BRAND_TOTALS = """
    SELECT p_type, p_brand, sum(l_extendedprice * (1 - l_discount)) AS revenue
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
"""


def brand_totals(t):
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand")
    lines = t.lineitem.select("l_partkey", "l_extendedprice", "l_discount")
    return (
        lookup(lines, parts, ["l_partkey"], "inner")
        .groupBy("p_type", "p_brand")
        .agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    )


@register(QUERIES, f"""
    WITH b AS ({BRAND_TOTALS})
    SELECT p_type, p_brand, round(revenue, 4) AS revenue,
           round(revenue / sum(revenue) OVER (PARTITION BY p_type), 8) AS prop
    FROM b
""")
def brand_share(t):
    shares = group_share(brand_totals(t), ["p_type"], "revenue")
    return shares.withColumns({"revenue": r("revenue", 4), "prop": r("prop", 8)})


@register(QUERIES, f"""
    WITH b AS ({BRAND_TOTALS}),
         s AS (SELECT *, revenue / sum(revenue) OVER (PARTITION BY p_type) AS prop FROM b)
    SELECT p_type, round(sum(prop), 9) AS total, abs(sum(prop) - 1) <= 1e-9 AS ok
    FROM s GROUP BY ALL
""")
def share_quality(t):
    shares = group_share(brand_totals(t), ["p_type"], "revenue")
    return share_check(shares, ["p_type"], "prop").withColumn("total", r("total", 9))


@register(QUERIES, """
    SELECT event_id, event_type,
      round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 6) AS std
    FROM events WINDOW w AS (PARTITION BY event_type)
""")
def zscore_rows(t):
    rows = t.events.select("event_id", "event_type", "value")
    return zscore(rows, ["event_type"], "value").select(
        "event_id", "event_type", r("std").alias("std")
    )


@register(QUERIES, """
    WITH c AS (SELECT event_type, floor(value / 10) * 10 AS v, count(*) AS c,
                      min(event_id) AS f FROM events GROUP BY ALL),
         m AS (SELECT event_type, arg_min(v, struct_pack(a := -c, b := f)) AS mode
               FROM c GROUP BY ALL)
    SELECT event_id, event_type, floor(value / 10) * 10 AS v,
      count(*) OVER w AS n, round(avg(floor(value / 10) * 10) OVER w, 6) AS mean,
      round(stddev_samp(floor(value / 10) * 10) OVER w, 6) AS sd,
      quantile_cont(floor(value / 10) * 10, 0.5) OVER w AS median, mode
    FROM events JOIN m USING (event_type) WINDOW w AS (PARTITION BY event_type)
""")
def rows_with_group_stats(t):
    rows = t.events.select(
        "event_id", "event_type", floor_to("value", 10).cast("double").alias("v")
    )
    return attach_group_stats(rows, ["event_type"], "v", "event_id").withColumns(
        {"mean": r("mean"), "sd": r("sd")}
    )


@register(QUERIES, """
    SELECT o_custkey, o_orderkey, o_orderpriority FROM orders
    QUALIFY o_orderpriority = max(o_orderpriority) OVER (PARTITION BY o_custkey)
""")
def group_max_with_ties(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderpriority")
    return group_max_rows(rows, ["o_custkey"], "o_orderpriority")


@register(QUERIES, """
    SELECT o_orderkey, o_orderdate, o_totalprice FROM orders
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 25
""")
def top_rows(t):
    rows = t.orders.select("o_orderkey", "o_orderdate", "o_totalprice")
    return arrange(rows, ["-o_totalprice"], tie=["o_orderkey"]).limit(25)


@register(QUERIES, """
    SELECT o_orderkey, o_orderpriority, CAST(CASE o_orderpriority
      WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '1-URGENT' THEN 3 END AS INTEGER)
        AS level
    FROM orders ORDER BY level NULLS LAST, o_orderkey
""")
def fixed_category_order(t):
    levels = ["5-LOW", "3-MEDIUM", "1-URGENT"]
    rows = t.orders.select(
        "o_orderkey", "o_orderpriority", fixed_rank("o_orderpriority", levels).alias("level")
    )
    return arrange(rows, ["level"], tie=["o_orderkey"])


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register(QUERIES, """
    SELECT o_custkey, {} FROM orders GROUP BY ALL
""".format(", ".join(
    f"count(*) FILTER (o_orderpriority = '{p}') AS \"{p}\"" for p in PRIORITIES
)))
def pivot_counts(t):
    counts = group_counts(t.orders, ["o_custkey", "o_orderpriority"])
    return pivot_wider(counts, ["o_custkey"], "o_orderpriority", "n", PRIORITIES, fill=0)


@register(QUERIES, """
    SELECT l_orderkey, l_linenumber, l_partkey, 'l_discount' AS rate, l_discount AS value
    FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'l_tax', l_tax FROM lineitem
""")
def unpivot_rates(t):
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_tax"
    )
    return pivot_longer(rows, ["l_discount", "l_tax"], "rate", "value")


@register(QUERIES, r"""
    SELECT c_custkey, regexp_extract(c_name, '^([A-Za-z]+)#([0-9]+)$', 1) AS prefix,
      CAST(regexp_extract(c_name, '^([A-Za-z]+)#([0-9]+)$', 2) AS DOUBLE) AS number,
      TRY_CAST(c_mktsegment AS DOUBLE) AS unreadable
    FROM customer
""")
def split_code(t):
    pattern = r"^([A-Za-z]+)#([0-9]+)$"
    return t.customer.select(
        "c_custkey",
        F.regexp_extract("c_name", pattern, 1).alias("prefix"),
        F.regexp_extract("c_name", pattern, 2).try_cast("double").alias("number"),
        F.col("c_mktsegment").try_cast("double").alias("unreadable"),
    )


@register(QUERIES, """
    SELECT l_returnflag,
      format('{:,}', count(DISTINCT l_partkey)) || ' / ' || format('{:,}', count(*)) AS label,
      printf('%.1f', round(avg(l_quantity), 1)) || ' ('
        || printf('%.3f', round(stddev_samp(l_quantity) / sqrt(count(*)), 3)) || ')' AS mean_se,
      concat_ws('_', l_returnflag, CAST(NULL AS VARCHAR), 'x') AS skipped,
      concat_ws('_', l_returnflag, 'NA', 'x') AS shown
    FROM lineitem GROUP BY ALL
""")
def format_labels(t):
    gap = F.lit(None).cast("string")
    return t.lineitem.groupBy("l_returnflag").agg(
        F.concat(
            big_int(F.count_distinct("l_partkey")), F.lit(" / "), big_int(F.count(F.lit(1)))
        ).alias("label"),
        F.concat(
            fixed(F.avg("l_quantity"), 1), F.lit(" ("),
            fixed(std_error("l_quantity"), 3), F.lit(")"),
        ).alias("mean_se"),
    ).select(
        "*",
        join_text("_", "l_returnflag", gap, F.lit("x")).alias("skipped"),
        join_text("_", "l_returnflag", gap, F.lit("x"), show_na=True).alias("shown"),
    )


@register(QUERIES, """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
      printf('%.2f', l_quantity / 16) AS eighths, printf('%.1f', l_discount * 5 + 0.05) AS tenths,
      printf('%.3f', l_extendedprice / 7) AS thousandths
    FROM lineitem
""")
def stored_values_as_text(t):
    """Decimals of the stored binary values, ties to the even digit."""
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        fixed_stored(F.col("l_quantity") / 16, 2).alias("eighths"),
        fixed_stored(F.col("l_discount") * 5 + 0.05, 1).alias("tenths"),
        fixed_stored(F.col("l_extendedprice") / 7, 3).alias("thousandths"),
    )


@register(QUERIES, """
    SELECT o_orderstatus, CAST(floor(o_totalprice / 25) * 25 AS BIGINT) AS bin,
      CASE WHEN o_orderstatus = 'F' THEN -count(*) ELSE count(*) END AS y
    FROM orders GROUP BY o_orderstatus, floor(o_totalprice / 25) * 25
""")
def mirrored_bins(t):
    rows = t.orders.select(
        "o_orderstatus", floor_to("o_totalprice", 25).alias("bin"), F.lit(1).alias("one")
    )
    return bar_totals(rows, ["o_orderstatus", "bin"], "one", F.col("o_orderstatus") == "F")


@register(QUERIES, """
    SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day,
      strptime(strftime(o_orderdate, '%Y/%m/%d'), '%Y/%m/%d')::DATE AS parsed,
      CAST(NULL AS DATE) AS unreadable
    FROM orders
""")
def date_parse(t):
    return t.orders.select(
        "o_orderkey",
        F.to_date("o_orderdate").alias("day"),
        parse_date(F.date_format("o_orderdate", "yyyy/MM/dd")).alias("parsed"),
        parse_date("o_orderpriority").alias("unreadable"),
    )


@register(QUERIES, """
    SELECT p_partkey, sqrt(p_size) AS root, round(pi() * pow(p_size / 2.0, 2) * p_retailprice, 3)
      AS volume, round(p_retailprice / nullif(p_size % 5, 0), 6) AS ratio
    FROM part
""")
def scalar_arithmetic(t):
    from haulframe.functions.text import cylinder_volume

    return t.part.select(
        "p_partkey",
        F.sqrt("p_size").alias("root"),
        r(cylinder_volume("p_size", "p_retailprice"), 3).alias("volume"),
        r(safe_ratio("p_retailprice", F.col("p_size") % 5)).alias("ratio"),
    )
