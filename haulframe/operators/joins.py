"""Joins, and attaching group results to rows without gathering a group.

Nothing here runs a job: sizes are measured and keys are checked inside the plan that
uses the result.  File-to-file joins carry no hint: Spark compares the scanned size with
``spark.sql.autoBroadcastJoinThreshold`` and otherwise merges by key, where
adaptive execution splits a hot partition.  Results computed from the rows
themselves have no known size at planning time; ``attach`` measures them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulframe.functions.nulls import same_keys
from haulframe.sources.scratch import broadcast_limit, row_bytes


def named(columns: Sequence[str]) -> list[Column]:
    """Columns of these names, which may hold dots."""
    return [F.col(f"`{c}`") for c in columns]


def require_unique(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``table``, whose plan ends in an error that names the key if one occurs twice."""
    rest = [c for c in table.columns if c not in keys]
    packed = F.struct(*named(rest)) if rest else F.struct(F.lit(1).alias("one"))
    once = table.groupBy(*named(keys)).agg(
        F.any_value(packed).alias("__row"), F.count(F.lit(1)).alias("__n"))
    message = F.concat(F.lit("repeated key "), F.to_json(F.struct(*named(keys))))
    checked = F.when(F.col("__n") > 1, F.raise_error(message).cast("boolean")).otherwise(True)
    return once.filter(checked).select(
        *[F.col(f"`{c}`") if c in keys else F.col("__row").getField(c).alias(c)
          for c in table.columns])


def lookup(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    expect_unique: bool = False,
    null_safe: bool = False,
) -> DataFrame:
    """Equi-join on named keys; right columns follow the left ones.

    A right side that may repeat fans out; ``expect_unique`` makes that an error.
    """
    if expect_unique:
        right = require_unique(right, on)
    if not null_safe:
        return left.join(right, list(on), how)
    cond = same_keys(left, right, on)
    joined = left.join(right, cond, how)
    return joined if how in ("left_semi", "left_anti") else _drop_right(joined, right, on)


def _drop_right(joined: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    for k in on:
        joined = joined.drop(right[k])
    return joined


def _prefixed(table: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Rename the key columns so both join sides stay addressable."""
    names = [f"__k{i}" for i in range(len(keys))]
    return table.withColumnsRenamed(dict(zip(keys, names))), names


def null_safe_join(
    rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join in which missing keys match; without keys ``table`` is one row."""
    if not keys:
        # an ungrouped aggregate: exactly one row
        return rows.join(F.broadcast(table), how=how)
    renamed, names = _prefixed(table, keys)
    cond = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)],
    )
    joined = rows.join(renamed, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*names)


def attach(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    unique: bool = False,
) -> DataFrame:
    """Join ``table`` (one row per key) to rows whose keys may be very uneven.

    The table is measured while the plan runs.  Small: every executor gets a copy and
    the rows do not move.  Large: rows and table are merged by a shuffle, in which
    adaptive execution splits a hot key.  Both joins are in the plan, each with the table
    behind the measure; adaptive execution takes out the one whose side is empty before
    the rows are touched.  Missing keys match each other.  ``unique`` raises an error in
    the job when the table repeats a key.  ``rows`` stands once in the plan, ``table`` three
    times, its shuffle being shared; write a table first whose plan is large.
    """
    if not keys:
        return null_safe_join(rows, table, keys, how)
    if unique:
        table = require_unique(table, keys)
    rest = [c for c in table.columns if c not in keys]
    packed = F.struct(*named(rest)) if rest else F.struct(F.lit(1).alias("one"))
    # 0 in every row: ties the rows to their measure, and has it read all that is measured
    zero = F.pmod(F.xxhash64(*named(table.columns)), F.lit(1))
    size = table.agg(F.sum(row_bytes(table.schema) + zero).alias("__bytes")).select(
        F.coalesce("__bytes", F.lit(0)).alias("__bytes"))
    limit = F.lit(broadcast_limit(rows.sparkSession))
    gate = F.pmod("__bytes", F.lit(1)).alias("__gate")
    sides = []
    for side, fits in (("a", F.col("__bytes") <= limit), ("b", F.col("__bytes") > limit)):
        names = [f"__{side}{i}" for i in range(len(keys))]
        held = table.select(*[c.alias(n) for c, n in zip(named(keys), names)],
                            packed.alias(f"__{side}"), zero.alias("__zero"))
        # the measure is one row
        held = held.join(F.broadcast(size.filter(fits).select(gate)), F.col("__zero") == F.col("__gate"))
        sides.append((held.drop("__zero", "__gate"), names))
    joined = rows
    for (side, names), hint in zip(sides, ("broadcast", "merge")):
        cond = reduce(lambda a, b: a & b, [
            k.eqNullSafe(F.col(n)) for k, n in zip(named(keys), names)])
        joined = joined.join(side.hint(hint), cond, "left")
    found = F.coalesce("__a", "__b")
    kept = named(rows.columns)
    if how == "left_anti":
        return joined.filter(found.isNull()).select(*kept)
    if how in ("inner", "left_semi"):
        joined = joined.filter(found.isNotNull())
    if how == "left_semi":
        return joined.select(*kept)
    if how not in ("inner", "left"):
        raise ValueError(f"no join {how!r}")
    return joined.select(*kept, *[found.getField(c).alias(c) for c in rest])


def flag_members(
    rows: DataFrame, members: DataFrame, on: Sequence[str], flag: str
) -> DataFrame:
    """TRUE where the key occurs among ``members``; all rows are kept."""
    marked = members.select(*on).distinct().withColumn(flag, F.lit(True))
    return attach(rows, marked, on).withColumn(
        flag, F.coalesce(F.col(flag), F.lit(False))
    )


def exclude(rows: DataFrame, omitted: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is not listed."""
    return attach(rows, omitted.select(*on).distinct(), on, "left_anti")


def restrict(rows: DataFrame, chosen: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is listed."""
    return attach(rows, chosen.select(*on).distinct(), on, "left_semi")


def full_outer(
    left: DataFrame, right: DataFrame, on: Sequence[str]
) -> DataFrame:
    """Full outer join in which missing keys match and keys are merged."""
    renamed, names = _prefixed(right, on)
    cond = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(on, names)],
    )
    joined = left.join(renamed, cond, "full")
    for k, n in zip(on, names):
        joined = joined.withColumn(k, F.coalesce(F.col(k), F.col(n)))
    return joined.drop(*names)


def bind_by_key(
    left: DataFrame, right: DataFrame, on: Sequence[str]
) -> DataFrame:
    """Put the columns of two tables with one row per key side by side."""
    return full_outer(require_unique(left, on), require_unique(right, on), on)


def union_all(*tables: DataFrame) -> DataFrame:
    """Stack by column name; a column absent from one table is NULL there."""
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), tables
    )


def tagged_union(tables: dict, tag: str) -> DataFrame:
    """Stack tables, writing each one's dictionary key into ``tag``."""
    return union_all(*[t.withColumn(tag, F.lit(k)) for k, t in tables.items()])


def enrich_missing(
    rows: DataFrame,
    known: DataFrame,
    on: Sequence[str],
    column: str,
    from_column: str,
) -> DataFrame:
    """Fill ``column`` where it is NULL from a table with one row per key, in one pass."""
    side = known.select(*on, F.col(from_column).alias("__fill"))
    filled = attach(rows, side, on, unique=True)
    return filled.withColumn(
        column, F.coalesce(F.col(column), F.col("__fill"))
    ).drop("__fill")


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
