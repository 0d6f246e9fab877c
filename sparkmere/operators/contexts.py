"""Contexts for questions: which evidence a token budget takes, and which neighbouring evidence is merged into it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmere.functions.text import token_estimate
from sparkmere.operators import compaction
from sparkmere.operators.evidence import OVERLAP_COST
from sparkmere.operators.intervals import overlapping

# Fixed values of the context behaviour.
LEAST_COVERAGE, LEAST_USEFULNESS = 0.3, 0.45
SCORE_SHARE, RANK_SHARE = 0.28, 0.04
MOST_MERGED, REACH = 3, 5


def coverage(text: Column, asked: Column) -> Column:
    """Share of the asked terms (array) that a text has."""
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(compaction.terms(text), asked)) / F.size(asked)).otherwise(0.0)


def scored(evidence: DataFrame) -> DataFrame:
    """evidence (query_id, rank from 1, node_id, source, section, page_first, page_last, score, text, asked) with words, coverage, usefulness and value.

    value, by which evidence is selected, is its usefulness and, if it covers enough of the question, something for its score beside the query's best and
    for its rank.
    """
    text = F.coalesce("text", F.lit(""))
    rows = evidence.withColumns({"text": text, "asked": F.coalesce("asked", F.array().cast("array<string>"))})
    rows = rows.withColumns({"words": compaction.terms(F.col("text")), "coverage": coverage(F.col("text"), F.col("asked")), "usefulness": compaction.usefulness(F.col("text"), F.col("asked"))})
    best = F.max("score").over(Window.partitionBy("query_id"))
    share = F.when(best > 0, F.least(F.lit(SCORE_SHARE), SCORE_SHARE * F.greatest(F.lit(0.0), F.col("score")) / best)).otherwise(0.0)
    more = share + F.least(F.lit(RANK_SHARE), RANK_SHARE / F.greatest(F.lit(1), F.col("rank") - 1))
    return rows.withColumn("value", F.col("usefulness") + F.when(F.col("coverage") >= LEAST_COVERAGE, more).otherwise(0.0))


def mergeable(rows: DataFrame) -> DataFrame:
    """query_id, node_id, near: for each row of scored the ranks of the evidence that may be merged into it, the best first.

    Evidence of the same source within REACH nodes, of overlapping pages (or, where neither has pages, of the same section), that covers enough of the
    question or is useful. Pages meet by an interval join.
    """
    own = rows.select("query_id", "source", "section", "node_id", F.col("rank").alias("id"), F.col("page_first").alias("first"), F.col("page_last").alias("last"), "score", "usefulness", "coverage")
    good = own.where((F.col("coverage") >= LEAST_COVERAGE) | (F.col("usefulness") >= LEAST_USEFULNESS))
    keys = ["query_id", "source"]
    paged = overlapping(own, good, keys).select("query_id", "left_id", "right_id")
    no_pages = "first IS NULL OR last IS NULL"
    a, b = own.where(no_pages), good.where(no_pages)
    sections = a.select(*keys, "section", F.col("id").alias("left_id")).join(b.select(*keys, F.col("section").alias("other"), F.col("id").alias("right_id")), keys).where(F.col("section").eqNullSafe(F.col("other")))
    # Where one of both has no pages, nothing keeps them apart.
    mixed = a.select(*keys, F.col("id").alias("left_id")).join(good.where(f"NOT ({no_pages})").select(*keys, F.col("id").alias("right_id")), keys)
    mixed = mixed.unionByName(own.where(f"NOT ({no_pages})").select(*keys, F.col("id").alias("left_id")).join(b.select(*keys, F.col("id").alias("right_id")), keys))
    pairs = paged.unionByName(sections.select("query_id", "left_id", "right_id")).unionByName(mixed.select("query_id", "left_id", "right_id")).where("left_id != right_id")
    left = own.select("query_id", F.col("id").alias("left_id"), F.col("node_id").alias("node"))
    right = good.select("query_id", F.col("id").alias("right_id"), "node_id", "score", "usefulness")
    gap = F.abs(F.col("node") - F.col("node_id"))
    joined = pairs.join(left, ["query_id", "left_id"]).join(right, ["query_id", "right_id"]).where(gap <= REACH)
    order = F.struct((-F.col("usefulness")).alias("a"), (-F.col("score")).alias("b"), gap.alias("c"), F.col("right_id").alias("rank"))
    near = F.transform(F.array_sort(F.collect_list(order)), lambda x: x["rank"])
    return joined.groupBy("query_id", F.col("left_id").alias("rank")).agg(near.alias("near"))


def _tokens(text: str) -> int:
    return max(1, (len(text) + 3) // 4)


def _fitted(sentences: list, most: int) -> str:
    """The best sentences that fit most tokens, in their order; sentences come by score, as (order, at, size, sentence)."""
    kept: list[tuple[int, str]] = []
    for s in sentences:
        if kept and -s["order"] < max(compaction.LEAST_SCORE, -sentences[0]["order"] * compaction.LEAST_SHARE):
            continue
        if _tokens(" ".join(x for _, x in sorted([*kept, (s["at"], s["sentence"])]))) <= most:
            kept.append((s["at"], s["sentence"]))
        if len(kept) >= compaction.MOST_SENTENCES:
            break
    return " ".join(x for _, x in sorted(kept))


def _selected(rows: list[dict], budget: int) -> list[dict]:
    """Greedily by value less overlap with what is chosen, then score, then rank, as long as something fits."""
    left, chosen, open_ = budget, [], rows

    def gain(r: dict) -> tuple:
        overlap = max((len(r["set"] & c["set"]) / max(1, len(r["set"] | c["set"])) if r["set"] else 0.0 for c in chosen), default=0.0)
        return (-(r["value"] - OVERLAP_COST * overlap), -r["score"], r["rank"])

    while fitting := [r for r in open_ if r["tokens"] <= left]:
        best = min(fitting, key=gain)
        chosen.append(best)
        open_ = [r for r in open_ if r is not best]
        left -= best["tokens"]
    return chosen


def _merged(budget: int, most: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("rank").to_dict("records")
        for r in rows:
            r["set"] = set(r["words"])
        by_rank, gone, used, out = {r["rank"]: r for r in rows}, set(), 0, []
        for place, item in enumerate(_selected(rows, budget), 1):
            if item["rank"] in gone:
                continue
            content, refs = item["content"], [item["rank"]]
            size, near = _tokens(content), [by_rank[k] for k in (item["near"] if item["near"] is not None else []) if k not in gone]
            for other in near[:most]:
                whole = f"{content.rstrip()}\n\n{other['content'].strip()}".strip()
                if _tokens(whole) > budget - used:
                    short = _fitted(list(other["sentences"]), max(1, budget - used - size)) if other["sentences"] is not None and len(other["sentences"]) > 1 else ""
                    whole = f"{content.rstrip()}\n\n{short.strip()}".strip()
                    if not short or short.strip() == other["text"].strip() or _tokens(whole) > budget - used:
                        continue
                content, size = whole, _tokens(whole)
                refs.append(other["rank"])
                gone.add(other["rank"])
            used += size
            out.append((item["query_id"], place, item["node_id"], content, [by_rank[k]["node_id"] for k in refs], refs, size))
        return pd.DataFrame(out, columns=["query_id", "place", "node_id", "content", "refs", "ranks", "tokens"])

    return run


def contexts(evidence: DataFrame, budget: int, most: int = MOST_MERGED) -> DataFrame:
    """query_id, place, node_id, content, refs, ranks, tokens: the items of each query's context.

    evidence as for scored; a query has a bounded number of rows (its top-k). Long evidence is compacted to a share of the budget. Items are taken
    greedily; into each, in turn, up to most neighbours are merged that aren't part of an item yet, shortened if the budget asks for it; an item
    that has been merged into one before it is left out. refs are the nodes that an item holds, its own first, ranks their ranks.
    """
    rows = scored(evidence)
    pieces = rows.select("query_id", F.col("rank").alias("node_id"), "text", "asked")  # a rank is one row, even if a node comes twice
    content = compaction.compacted(pieces, compaction.compaction_target(budget)).withColumnRenamed("node_id", "rank")
    sentences = compaction.ranked_sentences(pieces).select("query_id", F.col("node_id").alias("rank"), F.col("all").alias("sentences"))
    joined = rows.join(content, ["query_id", "rank"]).join(sentences, ["query_id", "rank"], "left").join(mergeable(rows), ["query_id", "rank"], "left")
    slim = joined.select("query_id", "rank", "node_id", "score", "value", "words", "text", "content", "sentences", "near", token_estimate(F.col("content")).alias("tokens"))
    return slim.groupBy("query_id").applyInPandas(_merged(budget, most), "query_id long, place int, node_id long, content string, refs array<long>, ranks array<int>, tokens long")


def diagnostics(evidence: DataFrame, items: DataFrame) -> DataFrame:
    """query_id, rank, node_id, score, coverage, tokens, selected, place: each row of scored evidence and the place of the context item that holds it."""
    taken = items.select("query_id", "place", F.explode("ranks").alias("rank")).groupBy("query_id", "rank").agg(F.max("place").alias("place"))
    joined = evidence.join(taken, ["query_id", "rank"], "left")
    numbers = [F.round(c, 6).alias(c) for c in ("score", "coverage")]
    return joined.select("query_id", "rank", "node_id", *numbers, token_estimate(F.col("text")).alias("tokens"), F.col("place").isNotNull().alias("selected"), "place")


def inspected(queries: DataFrame, evidence: DataFrame, items: DataFrame, budget: int) -> DataFrame:
    """query_id, evidence_count, context_item_count, merged_count, token_budget, token_count, answerable, fallback_reason of every query (query_id).

    evidence as for scored, items of contexts: a query without evidence has no results, one without items a budget that is exhausted.
    """
    rows = evidence.groupBy("query_id").agg(F.count(F.lit(1)).alias("evidence_count"))
    held = items.groupBy("query_id").agg(F.count(F.lit(1)).alias("context_item_count"), F.sum(F.size("refs") - 1).alias("merged_count"), F.sum("tokens").alias("token_count"))
    joined = queries.select("query_id").join(rows, "query_id", "left").join(held, "query_id", "left").fillna(0)
    reason = F.when(F.col("evidence_count") == 0, "no_results").when(F.col("context_item_count") == 0, "context_budget_exhausted").otherwise("")
    return joined.select("query_id", "evidence_count", "context_item_count", "merged_count", F.lit(budget).alias("token_budget"), "token_count", (reason == "").alias("answerable"), reason.alias("fallback_reason"))
