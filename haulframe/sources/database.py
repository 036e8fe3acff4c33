"""Database tables over JDBC.

The reader stays lazy: column lists and single-table filters reach the
database, and a partition column splits the scan over the executors.
Connection facts come from the session configuration, under
``haulframe.jdbc.<name>.url`` (and ``.user``, ``.password``, ``.driver``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from haulframe.operators.rows import rename_all


def connection_options(spark: SparkSession, name: str) -> dict[str, str]:
    """JDBC connection options stored in the session under ``name``."""
    prefix = f"haulframe.jdbc.{name}."
    url = spark.conf.get(prefix + "url", None)
    if not url:
        raise KeyError(f"{prefix}url is not set")
    found = {"url": url}
    for key in ("user", "password", "driver"):
        value = spark.conf.get(prefix + key, None)
        if value:
            found[key] = value
    return found


def scan_options(
    spark: SparkSession,
    name: str,
    table: str,
    split: tuple[str, str, str, int] | None = None,
    fetch_rows: int = 10_000,
) -> dict[str, str]:
    """All reader options; ``split`` is (column, lower, upper, partitions)."""
    options = connection_options(spark, name)
    options["dbtable"] = table
    options["fetchsize"] = str(fetch_rows)
    if split:
        column, lower, upper, parts = split
        options.update(
            partitionColumn=column,
            lowerBound=str(lower),
            upperBound=str(upper),
            numPartitions=str(parts),
        )
    return options


def read_table(
    spark: SparkSession,
    name: str,
    table: str,
    split: tuple[str, str, str, int] | None = None,
) -> DataFrame:
    """Lazy scan of a database table with lower-case column names."""
    options = scan_options(spark, name, table, split)
    return rename_all(spark.read.format("jdbc").options(**options).load())
