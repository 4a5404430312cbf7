"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: every ``u`` has one edge and none of them is a ``v``."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """``(node, component)`` for each node of ``edges``; the component is its smallest node.

    Large-star and small-star steps alternate until the edges form stars, which takes a
    logarithmic number of rounds. Each round is a few aggregations with map-side combining,
    and its edges are checkpointed; no links reach the driver. Loops and repeated edges are
    allowed, edges with a null end are no edges; no edges: an empty result.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    links = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(u, v).where("u <> v").distinct()
    links = durable(links)
    rounds = 0
    while not _settled(links):
        if rounds == most_rounds:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        rounds += 1
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        )
        links = durable(small.where("u <> v").distinct())
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
