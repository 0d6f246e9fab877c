"""Joins of intervals by bins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 16


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    """left_id, right_id of the pairs with equal keys whose intervals (id, first, last; whole numbers, both ends inside) share a point.

    Intervals are dealt into bins of width numbers and meet by equi-joins on keys and bin; a pair counts in the first bin that both reach. Rows with a null
    end or key meet nothing.
    """

    def dealt(df: DataFrame, side: str) -> DataFrame:
        low, high = F.least("first", "last"), F.greatest("first", "last")  # given in either order
        own = df.where("first IS NOT NULL AND last IS NOT NULL").select(*keys, F.col("id").alias(f"{side}_id"), low.alias(f"{side}_first"), high.alias(f"{side}_last"))
        return own.withColumn("bin", F.explode(F.sequence(F.floor(F.col(f"{side}_first") / width), F.floor(F.col(f"{side}_last") / width))))

    met = dealt(left, "left").join(dealt(right, "right"), [*keys, "bin"])
    first = F.greatest("left_first", "right_first")
    conditions = [F.col("left_first") <= F.col("right_last"), F.col("right_first") <= F.col("left_last"), F.floor(first / width) == F.col("bin")]
    return met.where(reduce(lambda a, b: a & b, conditions)).select("left_id", "right_id", *keys)
