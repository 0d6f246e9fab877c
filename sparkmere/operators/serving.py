"""Decisions of serving as columns and folds over logs: rerank routing, circuit breaker, budgets, refusals, and diagnostics of contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmere.plans.folding import folded

LEAST_BUDGET_MS = 500
FAILURES, COOLDOWN_SECONDS = 3, 30.0


def rerank_route(enabled: Column, tier: Column, external: Column, remaining_ms: Column, cached: Column, error: Column, least_ms: int = LEAST_BUDGET_MS) -> Column:
    """Where a rerank goes and why: the first reason that holds, a hit of the cache, a fallback after an error, or the vendor."""
    return (
        F.when(~enabled, "noop_via_settings_disabled").when(tier == "off", "noop_via_tier_off").when(~external, "noop_via_acl")
        .when(remaining_ms < least_ms, "reranker_skipped_due_to_budget").when(cached, "cache_hit").when(error.isNotNull(), F.concat(F.lit("reranker_fallback:"), error)).otherwise("vendor")
    )


def breaker_step(failures: int = FAILURES, cooldown: float = COOLDOWN_SECONDS):
    """The step of the circuit breaker over rows (key, at, failed): the state is the failures in a row and when it opened."""

    def step(state, row):
        count, opened = state
        if opened is not None and row[1] - opened < cooldown:
            return state, ("rejected",)
        count = 0 if opened is not None else count
        count = count + 1 if row[2] else 0
        return (count, row[1] if count >= failures else None), ("failed" if row[2] else "ok",)

    return step


def breaker(calls: DataFrame, failures: int = FAILURES, cooldown: float = COOLDOWN_SECONDS) -> DataFrame:
    """key, at, failed, state of each call (key, at seconds, failed boolean): ok, failed, or rejected while the breaker is open.

    It opens with failures in a row and lets calls through again, counting from 0, when cooldown seconds have passed.
    """
    return folded(calls.select("key", "at", "failed"), "key", ["at", "failed"], lambda: (0, None), breaker_step(failures, cooldown), {"state": "string"})


def budget_left(steps: DataFrame, iterations: int, tokens: int, tool_calls: int) -> DataFrame:
    """plan, step, iterations_left, tokens_left, tool_calls_left, exhausted (the first budget that is used up) after each step (plan, step, tokens, tools)."""
    so_far = Window.partitionBy("plan").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    left = {"iterations": (iterations, F.count(F.lit(1)).over(so_far)), "tokens": (tokens, F.sum("tokens").over(so_far)), "tool_calls": (tool_calls, F.sum("tools").over(so_far))}
    own = steps.select("plan", "step", *(F.greatest(F.lit(0), F.lit(most) - used).alias(f"{n}_left") for n, (most, used) in left.items()))
    spent = F.when(F.col("iterations_left") <= 0, "max_iterations").when(F.col("tokens_left") <= 0, "max_agent_tokens").when(F.col("tool_calls_left") <= 0, "max_tool_calls")
    return own.withColumn("exhausted", spent)


def refusal(answerable: Column, reason: Column, enabled: Column, error: Column, citations: Column) -> tuple[Column, Column]:
    """(kind, reason) of an answer: a refusal without evidence, an error if generation is off, fails, or cites nothing that is allowed, else an answer."""
    kind = F.when(~answerable, "refusal").when(~enabled | error.isNotNull() | (citations == 0), "error").otherwise("answer")
    why = F.when(~answerable, F.coalesce(reason, F.lit("insufficient_evidence"))).when(~enabled, "generation_disabled").when(error.isNotNull() | (citations == 0), "generation_failed")
    return kind, why
