"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskpanel.session import materialize


def _toward_minimum(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. ``edges`` has ``u``, ``v``. Large star: every neighbour above u is linked to the least of u and its neighbours;
    small star: u and every neighbour below u is linked to the least of those neighbours. Minima are partial aggregates, and the join back
    on u has nothing above it that needs the rows of one u together, so a hub is dealt out over tasks."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if large:
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    down = both.where("v < u")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.unionAll(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    # Sums of hashes in decimals, which cannot overflow: equal states mean equal edge sets.
    h = [F.sum(F.xxhash64("u", "v", F.lit(s)).cast("decimal(38,0)")) for s in (1, 2)]
    return tuple(edges.agg(F.count("*"), *h).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node``, ``component``: the least id that each node of an edge can reach. Edges are ``u``, ``v`` (long), in any direction,
    repeated or not. Runs jobs when called: every round is written to the shared folder. Loops and NULLs are ignored; no edges give no rows."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, name)
    before = _state(edges)
    while before[0]:
        edges = materialize(_toward_minimum(_toward_minimum(edges, True).distinct(), False).distinct(), name)
        now = _state(edges)
        if now == before:
            break
        before = now
    # All edges are now stars towards the least node.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
