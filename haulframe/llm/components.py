"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from haulframe.sources.scratch import broadcast_limit, materialize

#: Bytes of a row of two longs in a copied table, at most.
ROW_BYTES = 64


def _with_least(rows: DataFrame, pairs: DataFrame, few: bool) -> DataFrame:
    """Rows (a, b) with m, the smallest partner of ``a`` among the pairs.

    The smallest partners are combined before the shuffle.  If there are few they come back
    to the rows by a copy; beyond that adaptive execution splits a hub.
    """
    least = pairs.groupBy("a").agg(F.min("b").alias("m"))
    return rows.join(F.broadcast(least) if few else least, "a")


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both.where("b > a"), both, few).select(
        F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    # a partner other than the smallest is tied to it, and so is the node itself
    moved = F.when(F.col("b") != F.col("m"), F.col("b")).otherwise(F.col("a"))
    return _with_least(edges, edges, few).select(moved.alias("a"), F.col("m").alias("b"))


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges written, with their number and a sum of hashes."""
    seen = Observation()
    sums = [F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")]
    table = materialize(edges.observe(seen, *sums))
    return table, (seen.get["n"], seen.get["h"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link; the component is its smallest node.

    ``links`` has the columns a and b.  Each round writes its edges, one for each before,
    so that they never grow; the rounds grow with the logarithm of the longest chain.
    """
    limit = broadcast_limit(links.sparkSession)
    edges, now = _written(links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while now != before and now[0]:
        # either end of an edge may have a smallest partner
        few = 2 * now[0] * ROW_BYTES <= limit
        before = now
        edges, now = _written(_small_star(_large_star(edges, few), few))
    own = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(
        F.col("a").alias("node"), F.col("b").alias("component")).union(own).distinct()
