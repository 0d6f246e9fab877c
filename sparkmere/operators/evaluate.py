"""Ranking quality, gates, replay analytics and their roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranking_metrics(ranked: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """query_id, precision, recall, mrr, hit at k. ranked: query_id, rank, node_id, matched; expected: query_id, n. Precision divides by k."""
    top = ranked.where(F.col("rank") <= k).groupBy("query_id").agg(F.sum(F.col("matched").cast("int")).alias("found"), F.min(F.when(F.col("matched"), F.col("rank"))).alias("first"))
    joined = expected.join(top, "query_id", "left")
    found = F.coalesce("found", F.lit(0))
    return joined.select(
        "query_id", F.round(found / k, 6).alias("precision"), F.when(F.col("n") > 0, F.round(found / F.col("n"), 6)).otherwise(0.0).alias("recall"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), (found > 0).cast("double").alias("hit"), F.col("first").alias("first_rank"),
    )


def macro_average(metrics: DataFrame, suite: str = "suite") -> DataFrame:
    names = ["precision", "recall", "mrr", "hit"]
    return metrics.groupBy(suite).agg(F.count(F.lit(1)).alias("cases"), *(F.round(F.avg(n), 6).alias(n) for n in names))


def gated(metrics: DataFrame, floors: dict[str, float]) -> DataFrame:
    """Adds failures, the metrics below their floor, and passed."""
    below = F.array_compact(F.array(*(F.when(F.col(n) < floor, F.lit(n)) for n, floor in floors.items())))
    return metrics.withColumn("failures", F.array_join(below, ",")).withColumn("passed", F.col("failures") == "")


def compared(target: DataFrame, baseline: DataFrame, key: str, names: list[str]) -> DataFrame:
    """key and the change of each metric; a side that lacks the key gives null."""
    old = baseline.select(F.col(key).alias("k"), *(F.col(n).alias(f"old_{n}") for n in names))
    joined = target.join(old, F.col(key) == F.col("k"), "full")
    return joined.select(F.coalesce(F.col(key), F.col("k")).alias(key), *(F.round(F.col(n) - F.col(f"old_{n}"), 6).alias(f"delta_{n}") for n in names))


def divergence(hit: Column, mrr: Column, delta: Column, low: float = 0.5, steep: float = -0.25, slight: float = -0.10) -> Column:
    return F.when(hit < low, "investigate").when(delta <= steep, "reauthor").when((delta <= slight) | (mrr < low), "monitor").otherwise("ok")


def pressure(metrics: DataFrame) -> DataFrame:
    """The cases that are found, but not first."""
    return metrics.where((F.col("hit") > 0) & (F.col("recall") > 0) & (F.col("mrr") < 1) & (F.col("first_rank") > 1))


def ranking_gate(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """name, passed, baseline, candidate: whether a candidate ranking may ship, from the metrics of both (query_id, precision, recall, mrr, hit, first_rank).

    Averages must not fall and cases under pressure must not become more; such a case must not move down, and none may be new. A value that a side lacks is null.
    """
    sides = {"baseline": baseline, "candidate": candidate}
    names = ["hit", "recall", "mrr"]
    averages = [d.agg(*(F.round(F.coalesce(F.avg(n), F.lit(0.0)), 6).alias(n) for n in names)).select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias(side)) for n in names))).alias("x")).select("x.*") for side, d in sides.items()]
    kept = averages[0].join(averages[1], "name").select(F.concat("name", F.lit("_not_decreased")).alias("name"), (F.col("candidate") + 1e-9 >= F.col("baseline")).alias("passed"), "baseline", "candidate")
    pressed = [pressure(d).select("query_id", F.col("first_rank").cast("double").alias(side)) for side, d in sides.items()]
    counts = [d.agg(F.count(F.lit(1)).cast("double").alias(side)) for side, d in zip(sides, pressed, strict=True)]
    more = counts[0].join(counts[1]).select(F.lit("ranking_pressure_count").alias("name"), (F.col("candidate") <= F.col("baseline")).alias("passed"), "baseline", "candidate")  # a row each
    both = pressed[0].join(pressed[1], "query_id", "full")
    case = F.col("query_id").cast("string")
    moved = both.where("baseline IS NOT NULL AND candidate IS NOT NULL").select(F.concat(F.lit("case_first_matched_rank:"), case).alias("name"), (F.col("candidate") <= F.col("baseline")).alias("passed"), "baseline", "candidate")
    new = both.where("baseline IS NULL").select(F.concat(F.lit("new_pressure_case:"), case).alias("name"), F.lit(False).alias("passed"), "baseline", "candidate")
    return kept.unionByName(more).unionByName(moved).unionByName(new)


def severity(metrics: DataFrame, failed: Column | None = None) -> DataFrame:
    """query_id, severity, status. failed: whether a case has failures or negative hits, or didn't pass."""
    urgent = (F.col("hit") < 1) | (F.col("recall") <= 0)
    urgent = urgent if failed is None else failed | urgent
    level = F.when(urgent, 3).when((F.col("recall") < 1) | (F.col("mrr") < 0.5), 2).when(F.col("first_rank").isNull(), 1).otherwise(0)
    label = F.when(level == 3, "urgent").when(level > 0, "review").otherwise("ok")
    return metrics.select("query_id", level.alias("severity"), label.alias("status"))


def replay_overlap(old: DataFrame, new: DataFrame) -> DataFrame:
    """query_id, jaccard, same_top of two rankings (query_id, rank, node_id)."""
    sides = [d.groupBy("query_id").agg(F.collect_set("node_id").alias(f"{n}_ids"), F.max(F.when(F.col("rank") == 1, F.col("node_id"))).alias(f"{n}_top")) for d, n in ((old, "old"), (new, "new"))]
    joined = sides[0].join(sides[1], "query_id")
    share = F.size(F.array_intersect("old_ids", "new_ids")) / F.size(F.array_union("old_ids", "new_ids"))
    return joined.select("query_id", F.round(share, 6).alias("jaccard"), (F.col("old_top") == F.col("new_top")).alias("same_top"))


def latency(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Exact percentiles with linear interpolation."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.percentile(value, 0.5).alias("p50"), F.percentile(value, 0.95).alias("p95"))


def citation_quality(answers: DataFrame) -> DataFrame:
    """query_id, cited, supported: how many ids an answer cites in brackets, and whether all are among its contexts (array)."""
    cited = F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[(cit_[0-9]+)\]"), F.lit(1)))
    return answers.select("query_id", F.size(cited).alias("cited"), ((F.size(cited) > 0) & (F.size(F.array_except(cited, "contexts")) == 0)).alias("supported"))
