"""Score calibration, reordering, grading and rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmere.plans.folding import folded


def calibrated(scores: DataFrame, kind: str, group: str = "query_id", score: str = "score", temperature: float = 1.0) -> DataFrame:
    """Adds calibrated: minmax, zscore, sigmoid or identity within a group; one row or equal scores give 0.5, but for identity.

    The statistics are aggregated before they meet the rows, so that a large group isn't gathered.
    """
    if kind == "identity":
        return scores.withColumn("calibrated", F.col(score))
    stats = scores.groupBy(F.col(group).alias("g")).agg(F.min(score).alias("low"), F.max(score).alias("high"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("sd"), F.count(F.lit(1)).alias("n"))
    joined = scores.join(stats, F.col(group) == F.col("g"))
    flat = (F.col("n") == 1) | (F.col("high") == F.col("low"))
    value = {
        "minmax": (F.col(score) - F.col("low")) / (F.col("high") - F.col("low")),
        "zscore": (F.col(score) - F.col("mean")) / F.col("sd"),
        "sigmoid": 1 / (1 + F.exp(-F.col(score) / temperature)),
    }[kind]
    return joined.withColumn("calibrated", F.when(flat, 0.5).otherwise(value)).drop("g", "low", "high", "mean", "sd", "n")


def reordered(results: DataFrame, scores: DataFrame) -> DataFrame:
    """results in the order of a reranker's scores (query_id, node_id, new_score); rows it didn't score are dropped; ties keep their order."""
    order = Window.partitionBy("query_id").orderBy(F.desc("new_score"), "rank")
    return results.join(scores, ["query_id", "node_id"]).withColumn("new_rank", F.row_number().over(order))


def crag_grade(top1: Column, top2: Column, depth: Column, high: float = 0.6, low: float = 0.2, margin: float = 0.05, skipped: Column | None = None, least_depth: int = 1) -> Column:
    """no_signal where nothing was reranked; high if the best score is, clear of the next; low if it is low or there is none; else inconclusive."""
    graded_ = (
        F.when(depth == 0, "low")
        .when((top1 >= high) & (top1 - F.coalesce(top2, F.lit(0.0)) >= margin) & (depth >= least_depth), "high")
        .when(top1 <= low, "low")
        .otherwise("inconclusive")
    )
    return graded_ if skipped is None else F.when(skipped, "no_signal").otherwise(graded_)


def graded(results: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """query_id, grade of ranked results (query_id, rank, score). With runs (query_id, cache_status, vendor) every run has a grade: those that were skipped or
    went to noop no_signal, those without results low."""
    best = results.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("b"), F.count(F.lit(1)).alias("n"))
    if runs is None:
        return best.select("query_id", crag_grade(F.col("a"), F.col("b"), F.col("n")).alias("grade"))
    joined = runs.join(best, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    skipped = F.coalesce(F.col("cache_status") == "skipped", F.lit(False)) | F.coalesce(F.col("vendor") == "noop", F.lit(False))
    return joined.select("query_id", crag_grade(F.col("a"), F.col("b"), F.col("n"), skipped=skipped).alias("grade"))


def rerank_summary(runs: DataFrame, group: str) -> DataFrame:
    """group, kind, name, value: what reranked runs (group, vendor, cache_status, warnings array, latency_ms, truncated) of each group amount to.

    Kinds are vendor, cache and warning (how many runs), and summary: plans, fallbacks, fallback_rate, cache_hit_rate, percentiles of the latency, truncated
    documents. A run fell back if its vendor is noop or a warning says so. Unknown vendors and cache states are named unknown.
    """
    named = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")) == "", "unknown").otherwise(F.col(c))
    none = F.array().cast("array<string>")
    rows = runs.select(group, named("vendor").alias("vendor"), named("cache_status").alias("cache"), F.coalesce("warnings", none).alias("warnings"), F.coalesce("latency_ms", F.lit(0.0)).alias("latency"), F.coalesce("truncated", F.lit(0)).alias("truncated"))
    counts = [rows.groupBy(group, F.lit(kind).alias("kind"), F.col(kind).alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value")) for kind in ("vendor", "cache")]
    warned = rows.select(group, F.explode("warnings").alias("name")).groupBy(group, F.lit("warning").alias("kind"), "name").agg(F.count(F.lit(1)).cast("double").alias("value"))
    fell = (F.col("vendor") == "noop") | F.exists("warnings", lambda w: w.startswith("reranker_fallback"))
    totals = rows.groupBy(group).agg(
        F.count(F.lit(1)).cast("double").alias("plans"), F.count_if(fell).cast("double").alias("fallbacks"), F.round(F.count_if(fell) / F.count(F.lit(1)), 6).alias("fallback_rate"),
        F.round(F.count_if(F.col("cache") == "hit") / F.count(F.lit(1)), 6).alias("cache_hit_rate"), F.round(F.percentile("latency", 0.5) + 1e-9, 3).alias("latency_p50"), F.round(F.percentile("latency", 0.95) + 1e-9, 3).alias("latency_p95"),
        F.sum("truncated").cast("double").alias("truncated"),
    )
    names = ["plans", "fallbacks", "fallback_rate", "cache_hit_rate", "latency_p50", "latency_p95", "truncated"]
    long = totals.select(group, F.lit("summary").alias("kind"), F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names))).alias("x")).select(group, "kind", "x.name", "x.value")
    return counts[0].unionByName(counts[1]).unionByName(warned).unionByName(long)


def window_counts(events: DataFrame, seconds: int) -> DataFrame:
    """key, cell, n: calls of each key in fixed windows (number of the window since the epoch)."""
    cell = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / seconds)
    return events.groupBy("key", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def limit_estimates(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """key, cell, n, before, over: the sliding estimate at the middle of each window, half of the window before plus this one, if all calls count."""
    counts = window_counts(events, seconds)
    by_key = Window.partitionBy("key").orderBy("cell")
    before = F.when(F.lag("cell").over(by_key) == F.col("cell") - 1, F.lag("n").over(by_key)).otherwise(0)
    return counts.withColumn("before", before.cast("long")).withColumn("over", 0.5 * F.col("before") + F.col("n") >= limit)


def limiter(seconds: int, limit: int):
    """The step of the exact limiter over rows (key, event_id, at): the state is the window, its allowed calls and those of the window before."""

    def step(state, row):
        cell, now, before = state
        own = int(row[2] // seconds)
        if own != cell:
            before, now = (now if cell is not None and own == cell + 1 else 0), 0
        ok = before * (1 - (row[2] - own * seconds) / seconds) + now < limit
        return (own, now + ok, before), (bool(ok),)

    return step


def limited(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """key, event_id, allowed: the exact limiter, in which only allowed calls count. Events of a key are folded in order of time."""
    timed = events.select("key", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("at"))
    return folded(timed, "key", ["at", "event_id"], lambda: (None, 0, 0), limiter(seconds, limit), {"allowed": "boolean"}).select("key", "event_id", "allowed")
