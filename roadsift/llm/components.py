"""Connected components over a table of links, by alternating large and small stars.

Each half round is one aggregation (a minimum for every node, combined before the shuffle) and one join back. Rounds
end when only stars are left; their links are written to the shared folder, so lineage stays short and a lost executor
costs its own tasks only. Links never reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from roadsift.llm.common import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: a > b. Large: neighbours above a node move to its smallest one; small: the node and those below it do."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    joined = both.join(least, "a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b"))
    else:
        moved = joined.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return moved.where("a <> b")


def _stars_only(links: DataFrame) -> bool:
    """Whether every node has one link upward at most, and none if others point to it."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node): of every node that has a link. links: columns a, b in any order, repeated or not."""
    current = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _stars_only(current):
        current = materialize(_star(_star(current, True), False).distinct(), "links")
    roots = current.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
