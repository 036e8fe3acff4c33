"""Writing the shared tables out in other layouts and reading them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.tables import register
from haulframe.operators.ordered import row_positions
from haulframe.operators.rows import matching_columns, pick, preview, rename_all
from haulframe.sources.files import read_csv, read_tagged
from haulframe.sources.scratch import new_path
from haulframe.sources.sinks import write_csv, write_one_csv, write_report, write_table

QUERIES: dict = {}


@register(QUERIES, """
    SELECT o_orderkey AS id, o_totalprice AS price,
      CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status,
      CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS priority
    FROM orders
""")
def csv_files_by_name(t):
    """Files that order, name and omit columns differently, with NA cells."""
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    folder = new_path(t.spark)
    write_csv(
        pick(t.orders.filter("o_orderstatus <> 'F'"), price="o_totalprice", id="o_orderkey",
             status=status, priority="o_orderpriority"),
        f"{folder}/full",
    )
    write_csv(
        pick(t.orders.filter("o_orderstatus = 'F'"), status=status, order_id="o_orderkey",
             price="o_totalprice"),
        f"{folder}/short",
    )
    return read_csv(
        t.spark, [f"{folder}/full", f"{folder}/short"],
        "id long, price double, status string, priority string",
        aliases={"order_id": "id"},
    ).drop("row_seq")


@register(QUERIES, """
    SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_orderkey, l_linenumber, l_extendedprice
    FROM lineitem
""")
def csv_folder_per_year(t):
    """One folder per year, the year taken from the folder, all years in one read."""
    folder = new_path(t.spark)
    columns = ["l_orderkey", "l_linenumber", "l_extendedprice"]
    rows = t.lineitem.select(*columns, F.year("l_shipdate").alias("year"))
    rows.write.partitionBy("year").option("header", True).csv(folder)
    schema = "l_orderkey long, l_linenumber int, l_extendedprice double"
    return read_csv(t.spark, folder, schema, tag="year").drop("row_seq")


@register(QUERIES, """
    SELECT CASE l_returnflag WHEN 'A' THEN 2021 ELSE 2022 END AS year, l_orderkey AS id,
      CASE WHEN l_returnflag <> 'A' THEN l_quantity END AS quantity
    FROM lineitem
""")
def csv_tagged_folders(t):
    """Folders of any name, each with its key; one of them lacks a column."""
    folder, early = new_path(t.spark), F.col("l_returnflag") == "A"
    write_csv(t.lineitem.filter(early).select(F.col("l_orderkey").alias("ID")), f"{folder}/first")
    write_csv(t.lineitem.filter(~early).select(
        F.col("l_quantity").alias("quantity"), F.col("l_orderkey").alias("id")), f"{folder}/second")
    return read_tagged(
        t.spark, {2021: f"{folder}/first", 2022: f"{folder}/second"}, "id long, quantity double"
    ).drop("row_seq")


@register(QUERIES, """
    SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total,
      row_number() OVER (ORDER BY sum(o_totalprice) DESC, o_custkey) AS place
    FROM orders GROUP BY o_custkey
""")
def one_sorted_file(t):
    """A table in one file with one header; its lines are in the order asked for."""
    totals = t.orders.groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.sum("o_totalprice").alias("exact"))
    totals = totals.withColumn("total", F.round("exact", 2))
    path = f"{new_path(t.spark)}/totals.csv"
    write_one_csv(totals.select("o_custkey", "n", "total", "exact"), path,
                  [F.desc("exact"), F.col("o_custkey")])
    rows = read_csv(t.spark, path, "o_custkey long, n long, total double")
    return row_positions(rows, [], ["row_seq"], "place").drop("row_seq")


@register(QUERIES, """
    SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'
""")
def partitioned_table(t):
    """A table split into folders; the filter prunes folders."""
    path = new_path(t.spark)
    columns = ["o_orderkey", "o_totalprice", "o_orderstatus"]
    write_table(t.orders.select(*columns), path, by=["o_orderstatus"])
    return t.spark.read.parquet(path).filter("o_orderstatus = 'F'").select(*columns)


@register(QUERIES, """
    SELECT o_orderkey, o_custkey FROM orders
""")
def columns_by_pattern(t):
    """Names in another case, then the columns whose names match a pattern."""
    shouted = rename_all(t.orders, str.upper)
    lowered = rename_all(shouted)
    return lowered.select(*matching_columns(lowered, "orderkey|custkey"))


@register(QUERIES, """
    SELECT o_orderkey AS id, o_totalprice AS price, o_orderpriority AS priority FROM orders
""")
def csv_three_headers(t):
    """Three files' headers: quoted names with commas, another case, another order."""
    folder = new_path(t.spark)
    part = F.pmod("o_orderkey", F.lit(3))
    names = [
        {"o_orderkey": "id", "o_totalprice": "price, total", "o_orderpriority": "priority"},
        {"o_orderpriority": "PRIORITY", "o_orderkey": "Id", "o_totalprice": "Price"},
        {"o_totalprice": "price", "o_orderpriority": "Priority", "o_orderkey": "ID"},
    ]
    for i, named in enumerate(names):
        rows = t.orders.filter(part == i).select(
            *[F.col(c).alias(n) for c, n in named.items()])
        write_csv(rows, f"{folder}/{i}")
    return read_csv(
        t.spark, [f"{folder}/{i}" for i in range(3)],
        "id long, price double, priority string", aliases={"price, total": "price"},
    ).drop("row_seq")


@register(QUERIES, """
    SELECT count(*) FILTER (l_returnflag = 'R') AS n_r, count(*) FILTER (l_returnflag = 'A') AS n_a,
      round(avg(l_quantity) FILTER (l_returnflag = 'R'), 6) AS mean_r,
      round(avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS mean_a
    FROM lineitem
""")
def report_read_back(t):
    """A one-row report written as a file and read again."""
    folder = new_path(t.spark)
    group = {f: F.when(F.col("l_returnflag") == f, F.col("l_quantity")) for f in "RA"}
    report = t.lineitem.agg(
        *[F.count(c).alias(f"n_{f.lower()}") for f, c in group.items()],
        *[F.round(F.avg(c), 6).alias(f"mean_{f.lower()}") for f, c in group.items()],
    )
    write_report(report, folder)
    schema = "n_r long, n_a long, mean_r double, mean_a double"
    return read_csv(t.spark, folder, schema).drop("row_seq")


@register(QUERIES, """
    SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 6
""")
def previewed_rows(t):
    """The first rows in a stated order."""
    return preview(
        t.orders.select("o_orderkey", "o_totalprice"),
        [F.desc("o_totalprice"), F.col("o_orderkey")],
    )
