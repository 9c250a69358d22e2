"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import materialise

_MAX_ROUNDS = 60


def apart(aggregate: DataFrame) -> DataFrame:
    """An aggregate by key, taken out of the partitioning by that key.

    A join of detail rows with their aggregate would otherwise stand on the aggregate's own partitions, which Spark cannot
    split; with a shuffle on either side it splits the detail rows of a hot key over several tasks.
    """
    return aggregate.hint("rebalance")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the least of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(apart(least), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lesser neighbours go to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(apart(least), "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge (a, b), root the least node of its component; a root is its own root.

    Alternates large and small stars until the edges are stars, a few rounds for
    short paths and about log squared of the nodes at worst. Each node's least
    neighbour is an aggregate that is combined before it is shuffled, so a hub
    of any degree is no hot task. Null ends and loops are ignored; repeated
    edges count once; no edges give an empty result.
    """
    edges = materialise(edges.where("a <> b").select("a", "b").distinct(), "edges")
    seen = None
    for _ in range(_MAX_ROUNDS):
        now = Observation()
        edges = materialise(_small_star(_large_star(edges)).observe(
            now, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("hash")), "edges")
        if now.get == seen:
            break
        seen = now.get
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
