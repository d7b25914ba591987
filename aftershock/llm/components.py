"""Connected components by alternating large and small stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def _is_star_forest(edges: DataFrame) -> bool:
    """Every upper end has one edge, and no lower end is an upper one."""
    ends = edges.select(F.col("hi").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("lo", F.lit(0), F.lit(1)))
    met = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return met.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and comp, the least node it reaches, for each node that is not its own.

    A node that is the least of its component (or has no edge) has no row.
    Each step pulls all larger neighbours of a node to its least neighbour,
    then all smaller ones; written edges cut the lineage.  A node with many
    edges takes part in plain joins and partial aggregates only.
    """
    now = materialize(edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct(), "edges")
    while not _is_star_forest(now):
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(now.select("hi", "lo"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        below = large.groupBy("hi").agg(F.min("lo").alias("m"))
        met = large.join(below, "hi")
        small = met.where(F.col("lo") != F.col("m")).select(F.col("m").alias("lo"), F.col("lo").alias("hi")).union(below.select(F.col("m").alias("lo"), "hi"))
        now = materialize(small.distinct(), "edges")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("comp"))
