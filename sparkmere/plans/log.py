"""The query-plan log and the feedback log: merges, retention, filters, latest overlays, plans and replay verdicts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = ("intent", "cache_status", "rerank_vendor", "created_after", "created_before")


def merged_plans(inserts: DataFrame, updates: DataFrame) -> DataFrame:
    """plan_id and the columns of inserts, each overwritten by the last update that isn't null. updates: plan_id, seq, columns."""
    columns = [c for c in inserts.columns if c != "plan_id"]
    last = updates.groupBy("plan_id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"new_{c}") for c in columns if c in updates.columns))
    joined = inserts.join(last, "plan_id", "left")
    return joined.select("plan_id", *(F.coalesce(f"new_{c}", c).alias(c) if c in updates.columns else F.col(c) for c in columns))


def pruned(plans: DataFrame, now: Column, days: int) -> DataFrame:
    return plans.where(F.col("created_at") >= now - F.make_dt_interval(F.lit(days)))


def parsed_filters(text: str) -> dict[str, str]:
    """key=value pairs, separated by commas; unknown and repeated keys are errors."""
    found: dict[str, str] = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        key, sign, value = part.partition("=")
        if not sign or key not in FILTERS or key in found or not value:
            raise ValueError(f"bad filter: {part!r}")
        found[key] = value
    return found


def filtered(plans: DataFrame, text: str) -> DataFrame:
    for key, value in parsed_filters(text).items():
        if key == "created_after":
            plans = plans.where(F.col("created_at") >= F.lit(datetime.fromisoformat(value)).cast("timestamp_ntz"))
        elif key == "created_before":
            plans = plans.where(F.col("created_at") < F.lit(datetime.fromisoformat(value)).cast("timestamp_ntz"))
        else:
            plans = plans.where(F.col(key) == value)
    return plans


def decoded(plans: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their JSON decoded, and the rows whose JSON is bad."""
    read = plans.withColumn("decoded", F.from_json(column, schema))
    bad = F.col("decoded").isNull()
    return read.where(~bad), read.where(bad).drop("decoded")


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, as an aggregate of structs, which is combined before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max(F.struct(*order, *(c for c in rest if c not in order))).alias("s")).select(key, *(F.col(f"s.{c}").alias(c) for c in rest))


def promotable(feedback: DataFrame, existing: DataFrame, least: int = 2) -> DataFrame:
    """Feedback (feedback_id, query, matcher) that may become a case: long enough, with a matcher, not there yet."""
    usable = feedback.where((F.length(F.trim("query")) >= least) & F.col("matcher").isNotNull())
    return usable.join(existing.select("feedback_id"), "feedback_id", "left_anti")


def plan(queries: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """query_id, intent, rerank, persist, deadline_ms of queries (query_id, intent, private, tier)."""
    deadline = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in budgets.items() for x in kv)), F.col("tier")), F.lit(min(budgets.values())))
    rerank = ~F.col("private") & (F.col("intent") != "OUT_OF_SCOPE")
    return queries.select("query_id", "intent", rerank.alias("rerank"), (~F.col("private")).alias("persist"), deadline.alias("deadline_ms"))


def replay_verdicts(steps: DataFrame) -> DataFrame:
    """plan_id, verdict: match if every step (tool, grade, source, args) is well formed."""
    sound = (F.length("tool") > 0) & (F.col("grade").isNull() | F.col("grade").isin("high", "low", "inconclusive", "no_signal")) & F.col("source").isin("rule", "llm") & F.col("args").isNotNull()
    return steps.groupBy("plan_id").agg(F.when(F.bool_and(F.coalesce(sound, F.lit(False))), "match").otherwise("mismatch").alias("verdict"))
