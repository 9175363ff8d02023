"""Connected components of a distributed edge list, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut, scoped


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest of itself and its neighbours."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    # cut, so that the join isn't bound to the aggregate's partitions and a hub's edges can be split
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours and itself to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = cut(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least, "u").where("v != m").select("v", "m")
    return least.union(moved).toDF("a", "b")


@scoped
def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b: of one type that has an order); root is the smallest node of its component.

    Null ends and loops are ignored, repeated edges count once, no edges give no rows. Each round is cut to the shared
    folder, so a lost executor costs one round at most; nodes and edges never reach the driver, which sees two sums a round.
    """
    now = cut(edges.toDF("a", "b").where("a != b").distinct())
    mark = None
    while True:  # each round brings nodes nearer to their roots, about the logarithm of the longest chain in all
        now = cut(_small_star(_large_star(now)).where("a != b").distinct())
        found = now.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))")).first()
        if found == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        mark = found
