"""Ordered computations over groups of any size.

A window ordered inside one group needs the whole group in one task.  Here
rows are cut into pieces along (group, order): splitters drawn from a sample chosen by
hash tell the piece of a row, so it depends on the row alone and is the same whenever and
wherever the row is read again.  Each group is worked on piece by piece.  Only a group
that lies in several pieces needs anything carried over; a piece shares at
most its first group with earlier pieces and its last one with later pieces,
so the carried table never has more than two rows per piece.

Nothing is written and no job is run; the rows are read for their number, for the
sample, for what is carried, and for the result.  Rows that are costly to compute, or
would not come out the same each time, should be written first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulframe.operators.joins import any_of, attach, named, null_safe_join
from haulframe.sources.scratch import materialize

PIECE = "__piece"
# Accuracy of the sketches that bracket quantiles: the reciprocal of the rank error.
SKETCH_ACCURACY = 10_000
# Rows of a piece; a table of fewer is one piece, one of many has as many pieces as the
# session has shuffle partitions.
PIECE_ROWS_KEY = "haulframe.piece.rows"
PIECE_ROWS = 50_000
# Rows of the sample for each piece.
SAMPLED = 16


def splitters(df: DataFrame, place: Column, pieces: int, rows: int) -> DataFrame:
    """One row with ``__cuts``, the places at which a piece ends, in order.

    The sample is every row whose hash is a multiple of a step that the number of rows
    gives, so the same rows give the same splitters.
    """
    hashed = F.xxhash64(*named(df.columns))
    # the number and the sample read the same columns, so that they share a shuffle
    many = df.agg(F.sum(F.pmod(hashed, F.lit(1)) + 1).alias("__rows")).select(
        F.coalesce("__rows", F.lit(0)).alias("__rows"))
    step = F.greatest(F.lit(1), F.col("__rows") / F.lit(SAMPLED * pieces)).cast("long")
    # one row of a count
    drawn = df.select(place.alias("__place"), hashed.alias("__hash")).join(F.broadcast(many)).filter(
        (F.col("__rows") > rows) & (F.pmod("__hash", step) == 0))
    found = drawn.agg(
        F.array_sort(F.collect_set("__place")).alias("__sample"), F.max("__rows").alias("__rows"))
    cuts = F.least(F.lit(pieces), F.ceil(F.col("__rows") / F.lit(rows)),
                   F.size("__sample")).cast("int") - 1
    at = F.transform(F.sequence(F.lit(1), cuts), lambda i: F.element_at(
        "__sample", (i * F.size("__sample") / (cuts + 1)).cast("int") + 1))
    return found.select(F.when(cuts > 0, at).alias("__cuts"))


def in_pieces(
    df: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Add the piece of each row; pieces follow each other along (keys, order)."""
    conf = df.sparkSession.conf
    pieces = int(conf.get("spark.sql.shuffle.partitions"))
    rows = int(conf.get(PIECE_ROWS_KEY, str(PIECE_ROWS)))
    place = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(named([*keys, *order]))])
    cuts = splitters(df, place, pieces, rows)
    # one row of at most as many splitters as there are pieces
    held = df.join(F.broadcast(cuts))
    steps = [2**i for i in reversed(range(max(pieces, 2).bit_length()))]

    def farther(at: Column, step: Column) -> Column:
        # halving: how many splitters are at or before the place
        beyond = (at + step <= F.size("__cuts")) & (F.get("__cuts", at + step - 1) <= place)
        return at + F.when(beyond, step).otherwise(0)

    found = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), farther)
    return held.withColumn(
        PIECE, F.when(F.col("__cuts").isNull(), 0).otherwise(found)).drop("__cuts")


def _carry_join(
    rows: DataFrame, carry: DataFrame, keys: Sequence[str]
) -> DataFrame:
    # bounded: at most two rows per piece, see the module text
    return null_safe_join(rows, F.broadcast(carry), [PIECE, *keys], "left")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    totals: dict[str, Column],
    group_totals: dict[str, str] | None = None,
) -> DataFrame:
    """Add inclusive running totals per group in the given order.

    ``order`` must be unique inside a group, else ties are summed in an
    arbitrary order.  ``group_totals`` names, per running total, a column for
    the total of the whole group.
    """
    group_totals = group_totals or {}
    pieces = in_pieces(df, keys, order)
    sums = pieces.groupBy(PIECE, *keys).agg(
        *[F.sum(c).alias(f"__c_{n}") for n, c in totals.items()]
    )
    group = Window.partitionBy(*[F.col(k) for k in keys]).orderBy(PIECE)
    before = group.rowsBetween(Window.unboundedPreceding, -1)
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carry = (
        sums.select(
            PIECE,
            *keys,
            F.count(F.lit(1)).over(whole).alias("__pieces"),
            *[F.sum(f"__c_{n}").over(before).alias(f"__o_{n}") for n in totals],
            *[F.sum(f"__c_{n}").over(whole).alias(f"__g_{n}") for n in group_totals],
        )
        .filter("__pieces > 1")
        .drop("__pieces")
    )
    part = Window.partitionBy(PIECE, *keys)
    inside = part.orderBy(*[F.col(c) for c in order]).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = pieces.withColumns(
        {
            **{n: F.sum(c).over(inside) for n, c in totals.items()},
            **{g: F.sum(totals[n]).over(part) for n, g in group_totals.items()},
        }
    )
    joined = _carry_join(local, carry, keys)
    return joined.withColumns(
        {
            **{
                n: F.col(n) + F.coalesce(F.col(f"__o_{n}"), F.lit(0))
                for n in totals
            },
            **{
                g: F.coalesce(F.col(f"__g_{n}"), F.col(g))
                for n, g in group_totals.items()
            },
        }
    ).drop(
        PIECE,
        *[f"__o_{n}" for n in totals],
        *[f"__g_{n}" for n in group_totals],
    )


def row_positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position"
) -> DataFrame:
    """One-based position of each row inside its group."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("long")})


def value_counts(
    df: DataFrame, keys: Sequence[str], value: str, n: str = "n"
) -> DataFrame:
    """Rows per distinct value, the input of every rank-based statistic."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias(n))
    )


def ranked_counts(
    df: DataFrame, keys: Sequence[str], value: str
) -> DataFrame:
    """Distinct values with ``n``, rows up to and including them, group size."""
    return running_totals(
        value_counts(df, keys, value),
        keys,
        [value],
        {"n_upto": F.col("n")},
        {"n_upto": "n_group"},
    )


def ecdf(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Empirical distribution function at each distinct value."""
    return ranked_counts(df, keys, value).select(
        *keys, value, (F.col("n_upto") / F.col("n_group")).alias("ecdf")
    )


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    approx: bool = False,
) -> DataFrame:
    """Quantiles per group, exact by default (linear between order statistics).

    A mergeable sketch of each group first gives two of its values between which a
    wanted rank must lie.  A second pass counts the values between them one by one and
    all others in lumps, and ranks those counts, so that few values are shuffled
    however the group is distributed.  ``approx`` stops after the first pass: values of
    the group near the wanted ranks, not interpolated.  Groups without a value have no
    row.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, value)
    if approx:
        return rows.groupBy(*keys).agg(
            *[F.percentile_approx(value, p).alias(n) for n, p in probs.items()]
        )
    return quantiles_of_ranked(bracketed_counts(rows, keys, value, probs), keys, value, probs)


def bracketed_counts(
    rows: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Ranked counts of the values around the wanted ranks, and of lumps of the others.

    A lump bears its largest value, and its smallest as ``least``; of one value it is none.
    """
    slack = 2.0 / SKETCH_ACCURACY
    wanted = sorted(set(probs.values()))
    ends = [F.lit(max(0.0, p - slack)) for p in wanted]
    ends += [F.lit(min(1.0, p + slack)) for p in wanted]
    v = F.col(value).cast("double")
    sketch = F.percentile_approx(v, F.array(*ends), SKETCH_ACCURACY)
    brackets = rows.groupBy(*keys).agg(sketch.alias("__ends"))
    placed = attach(rows, brackets, keys).withColumn("__v", v)
    low = [F.col("__ends")[i] for i in range(len(wanted))]
    high = [F.col("__ends")[i + len(wanted)] for i in range(len(wanted))]
    near = any_of([F.col("__v").between(a, b) for a, b in zip(low, high)])
    # how many brackets lie below: tells the lumps apart
    above = sum((F.col("__v") > b).cast("int") for b in high)
    counts = placed.groupBy(
        *keys, above.alias("__above"), F.when(near, F.col("__v")).alias("__near")
    ).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("least"), F.max("__v").alias(value))
    # few rows, of a long plan that is read several times from here
    counts = materialize(counts.drop("__above"))
    ranked = running_totals(
        counts, keys, [value], {"n_upto": F.col("n")}, {"n_upto": "n_group"}
    )
    return ranked.drop("__near")


def quantiles_of_ranked(
    ranked: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Quantiles from ranked counts; a wanted rank deep inside a lump is an error."""
    v = F.col(value).cast("double")
    upto, before = F.col("n_upto"), F.col("n_upto") - F.col("n")

    def at_rank(rank: Column) -> Column:
        here = v
        if "least" in ranked.columns:
            least = F.col("least")
            here = (
                F.when((least == v) | (rank == upto - 1), v)
                .when(rank == before, least)
                .otherwise(F.raise_error(F.lit("rank outside its bracket")).cast("double"))
            )
        return F.max(F.when((before <= rank) & (rank < upto), here))

    aggs = []
    for name, p in probs.items():
        at = (F.col("n_group") - 1) * F.lit(float(p))
        lo, hi = at_rank(F.floor(at)), at_rank(F.ceil(at))
        part = F.max(at - F.floor(at))
        aggs.append((lo + (hi - lo) * part).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)


def interpolate(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str,
    hold_edges: bool = True,
) -> DataFrame:
    """Fill missing values linearly by row position inside each group.

    Before the first and after the last known value the nearest one is held
    (or NULL without ``hold_edges``).  A group with fewer than two known
    values is left as it is.
    """
    pieces = in_pieces(df, keys, order)
    part = Window.partitionBy(PIECE, *keys)
    by_order = part.orderBy(*[F.col(c) for c in order])
    known = F.col(value).isNotNull()
    local = pieces.withColumn("__at", F.row_number().over(by_order).cast("long"))

    def point(at, v):
        return F.when(known, F.struct(at.alias("at"), v.cast("double").alias("v")))

    here = point(F.col("__at"), F.col(value))
    summary = local.groupBy(PIECE, *keys).agg(
        F.count(F.lit(1)).alias("__rows"),
        F.count(value).alias("__known"),
        F.min(here).alias("__first"),
        F.max(here).alias("__last"),
    )
    group = Window.partitionBy(*[F.col(k) for k in keys]).orderBy(PIECE)
    before = group.rowsBetween(Window.unboundedPreceding, -1)
    # looking ahead is looking back in the reverse order, which stays linear
    after = (
        Window.partitionBy(*[F.col(k) for k in keys])
        .orderBy(F.desc(PIECE))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def shifted(p):
        return F.when(
            F.col(p).isNotNull(),
            F.struct(
                (F.col(f"{p}.at") + F.col("__shift")).alias("at"),
                F.col(f"{p}.v").alias("v"),
            ),
        )

    placed = summary.withColumn(
        "__shift", F.coalesce(F.sum("__rows").over(before), F.lit(0))
    ).withColumns({"__first": shifted("__first"), "__last": shifted("__last")})
    carry = (
        placed.withColumns(
            {
                "__pieces": F.count(F.lit(1)).over(whole),
                "__known_all": F.sum("__known").over(whole),
                "__before": F.last("__last", ignorenulls=True).over(before),
                "__after": F.last("__first", ignorenulls=True).over(after),
            }
        )
        .filter("__pieces > 1")
        .select(PIECE, *keys, "__shift", "__known_all", "__before", "__after")
    )
    joined = _carry_join(local, carry, keys)
    at = F.col("__at") + F.coalesce(F.col("__shift"), F.lit(0))
    joined = joined.withColumn("__pos", at)
    here = point(F.col("__pos"), F.col(value))
    prev = F.last(here, ignorenulls=True).over(
        by_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    nxt = F.last(here, ignorenulls=True).over(
        part.orderBy(F.desc("__pos")).rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
    )
    n_known = F.count(value).over(part)
    joined = joined.withColumns(
        {
            "__p": F.coalesce(prev, F.col("__before")),
            "__q": F.coalesce(nxt, F.col("__after")),
            "__n": F.coalesce(F.col("__known_all"), n_known),
        }
    )
    slope = F.try_divide(
        F.col("__q.v") - F.col("__p.v"),
        (F.col("__q.at") - F.col("__p.at")).cast("double"),
    )
    between = F.col("__p.v") + slope * (F.col("__pos") - F.col("__p.at"))
    edge = F.coalesce(F.col("__p.v"), F.col("__q.v"))
    inside = F.col("__p").isNotNull() & F.col("__q").isNotNull()
    filled = F.when(known | (F.col("__n") < 2), F.col(value).cast("double"))
    filled = filled.when(inside, between)
    if hold_edges:
        filled = filled.otherwise(edge)
    return joined.withColumn(name, filled).drop(
        PIECE, "__at", "__shift", "__known_all", "__before", "__after",
        "__pos", "__p", "__q", "__n",
    )
