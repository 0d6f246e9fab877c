"""Set-similarity joins by prefix filters: pairs of sets that share enough, without trying every pair or joining on a frequent token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmere.plans.saving import saved

SMALL = 1e-9


def _ranked(sets: DataFrame, often: DataFrame) -> DataFrame:
    """id, tokens in order of how few sets hold them, n."""
    each = sets.select("id", F.explode(F.array_distinct("tokens")).alias("token")).join(often, "token")
    ranked = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("all"))
    return ranked.select("id", F.transform("all", lambda x: x["token"]).alias("tokens"), F.size("all").alias("n"))


def _prefix(n: Column, least: Column) -> Column:
    """How many of n tokens must be looked up, if least of them are shared."""
    return F.greatest(F.lit(1), n - F.greatest(F.lit(1), F.ceil(least - SMALL).cast("int")) + 1)


def similar_sets(left: DataFrame, right: DataFrame, least: float, containment: bool = False) -> DataFrame:
    """left, right, shared, share: the pairs of sets (id, tokens array) with a share of at least least.

    share is shared / all tokens of both (Jaccard), or with containment shared / tokens of the left set. Two sets that share that much share one of the
    rarest tokens of each: of a left set of n tokens the n - ceil(least * n) + 1 rarest are looked up, among as many of each right set (with
    containment among all of them). What meets is verified on the whole sets. Empty sets meet nothing; ids are unique on each side.
    """
    both = left.select(F.explode(F.array_distinct("tokens")).alias("token")).unionByName(right.select(F.explode(F.array_distinct("tokens")).alias("token")))
    often = saved(both.groupBy("token").agg(F.count(F.lit(1)).alias("often")))
    a, b = saved(_ranked(left, often)), saved(_ranked(right, often))
    head = F.slice("tokens", F.lit(1), _prefix(F.col("n"), least * F.col("n")))
    asked = a.select(F.col("id").alias("left"), F.col("n").alias("n_left"), F.explode(head).alias("token"))
    held = b.select(F.col("id").alias("right"), F.col("n").alias("n_right"), F.explode(F.col("tokens") if containment else head).alias("token"))
    fits = F.lit(True) if containment else (F.col("n_right") >= least * F.col("n_left") - SMALL) & (F.col("n_left") >= least * F.col("n_right") - SMALL)
    met = asked.join(held, "token").where(fits).select("left", "right").distinct()
    whole = met.join(a.select(F.col("id").alias("left"), F.col("tokens").alias("of_left")), "left").join(b.select(F.col("id").alias("right"), F.col("tokens").alias("of_right")), "right")
    shared = F.size(F.array_intersect("of_left", "of_right"))
    out_of = F.size("of_left") if containment else F.size("of_left") + F.size("of_right") - F.col("shared")
    return whole.withColumn("shared", shared).withColumn("share", F.col("shared") / out_of).where(F.col("share") >= least).select("left", "right", "shared", "share")
