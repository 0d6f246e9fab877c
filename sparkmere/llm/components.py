"""Connected components of links by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmere.llm.common import saved


def _least(neighbours: DataFrame) -> DataFrame:
    """u, m: the least of u and its neighbours. Saved, so that a node with very many links can be split among tasks in the join with it."""
    return saved(neighbours.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))


def large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above u is linked to the least neighbour of u instead."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(links: DataFrame) -> DataFrame:
    """u and its neighbours below u are linked to the least of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def _tidy(links: DataFrame) -> DataFrame:
    return saved(links.where("u != v").distinct())


def components(links: DataFrame) -> DataFrame:
    """node, root of every node with a link; root is the least node of its component. links: u, v of type long.

    Links of a node to itself and repeated links change nothing; nulls must not occur; no links give no rows.
    """
    now = _tidy(links.select("u", "v"))
    mark = None
    while True:
        now = _tidy(small_star(_tidy(large_star(now))))
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if tuple(seen) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = tuple(seen)
