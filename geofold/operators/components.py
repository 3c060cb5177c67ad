"""Connected components by alternating stars over a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geofold.operators.shared import stash, unstash


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to its smallest one (or itself)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them. Edges have u < v."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = edges.join(least, "v").where("u != m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return moved.unionByName(least.select(F.col("m").alias("u"), "v")).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is either a centre or hangs on one centre only."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("centre"), F.lit(0).alias("hangs")), F.struct(F.col("v").alias("node"), F.lit(0).alias("centre"), F.lit(1).alias("hangs"))))
    seen = edges.select(ends.alias("e")).groupBy("e.node").agg(F.max("e.centre").alias("centre"), F.sum("e.hangs").alias("hangs"))
    return seen.where("hangs > 1 OR (centre = 1 AND hangs > 0)").isEmpty()


def connected_components(edges: DataFrame, stars: bool = False) -> DataFrame:
    """(node, root) of every node that has an edge; root: the component's smallest node.

    With ``stars``, rounds end as soon as the edges are stars, which takes a grouping for each round but saves the last one.

    Minima are taken by partially aggregated groupings and joined back, so a node
    with very many neighbours is never gathered in one task. Each round's edges are
    written to the shared folder.
    """
    a, b = edges.columns[:2]
    now = stash(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct(), "edges")
    seen = None
    while True:
        state = _are_stars(now) if stars else now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (state if stars else seen == state or not state[0]):
            return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
        seen = state
        large = _large_star(now).where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        after = stash(_small_star(large), "edges")
        unstash(now)
        now = after
