"""Evidence and context: usefulness, confidence, neighbours, greedy packing, answers and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmere.functions.chunking import any_of
from sparkmere.functions.text import token_estimate

SNIPPET = 700
OVERLAP_COST = 0.35


def usefulness(coverage: Column, definitions: Column, actions: Column, chrome: Column) -> Column:
    """0 or more: coverage, definition cues, action cues where coverage is good, less a penalty for page chrome."""
    acted = F.when(coverage >= 0.35, F.least(F.lit(0.12), 0.04 * actions)).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(0.4), coverage) + F.least(F.lit(0.36), 0.12 * definitions) + acted - chrome)


def cues(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words a text has, anywhere, whatever the case."""
    low = F.lower(text)
    return sum((low.contains(w).cast("int") for w in words), F.lit(0))


def confidence(score: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 6)


def evidence_rows(results: DataFrame) -> DataFrame:
    """query_id, rank, evidence_id, citation_id, snippet, confidence, tokens of ranked results (query_id, rank, text, score)."""
    number = F.lpad(F.col("rank").cast("string"), 3, "0")
    return results.select("query_id", "rank", F.concat(F.lit("ev_"), number).alias("evidence_id"), F.concat(F.lit("cit_"), number).alias("citation_id"), F.substring("text", 1, SNIPPET).alias("snippet"), confidence(F.col("score")).alias("confidence"), token_estimate(F.col("text")).alias("tokens"))


def answerability(evidence: DataFrame, queries: DataFrame, budget: int) -> DataFrame:
    """query_id, status, confidence of every query: whether anything was found, and whether the smallest evidence fits the budget."""
    found = evidence.groupBy("query_id").agg(F.max("confidence").alias("best"), F.min("tokens").alias("least"))
    joined = queries.select("query_id").join(found, "query_id", "left")
    status = F.when(F.col("best").isNull(), "no_results").when(F.col("least") > budget, "context_budget_exhausted").otherwise("answerable")
    return joined.select("query_id", status.alias("status"), F.coalesce("best", F.lit(0.0)).alias("confidence"))


def adjacent_evidence(sparse: DataFrame, chunks: DataFrame, distance: int = 2, least_length: int = 40) -> DataFrame:
    """node_id, neighbour: for each sparse chunk the nearest chunk of the same source within distance that has enough text.

    The interval join runs on cells of node numbers.
    """
    width = distance + 1
    cell = F.floor(F.col("node_id") / width)
    a = sparse.select(F.col("node_id").alias("at"), "source", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    b = chunks.where(F.length("text") >= least_length).select("node_id", "source", cell.alias("cell"))
    gap = F.abs(F.col("node_id") - F.col("at"))
    joined = a.join(b, ["source", "cell"]).where((gap > 0) & (gap <= distance))
    return joined.groupBy("at").agg(F.min_by("node_id", F.struct(gap, "node_id")).alias("neighbour")).select(F.col("at").alias("node_id"), "neighbour")


def same_page_order(results: DataFrame, strong: float = 0.55, lead: float = 0.15, least: float = 0.45) -> DataFrame:
    """results (query_id, rank, page, header, score, coverage, usefulness) with new_rank.

    Only queries in which a page or a header repeats are reordered, by usefulness, coverage, score, and not if the first result is useful by itself, has
    peers of its score that are no more useful, leads clearly, or is itself the first one that is useful (least at least, and the best of them).
    """
    own = Window.partitionBy("query_id")

    def repeats(column: str) -> Column:
        return F.when(F.coalesce(F.col(column).cast("string"), F.lit("")) != "", F.count(F.lit(1)).over(Window.partitionBy("query_id", column))).otherwise(0)

    paged = results.withColumn("same", F.greatest(repeats("page"), repeats("header")))
    first = {c: F.max(F.when(F.col("rank") == 1, F.col(c))).over(own) for c in ("usefulness", "score")}
    paged = paged.withColumns({"first_useful": first["usefulness"], "first_score": first["score"], "best": F.max("usefulness").over(own)})
    second = F.max(F.when(F.col("rank") > 1, F.col("score"))).over(own)
    peer = F.max(F.when((F.col("rank") > 1) & (F.abs(F.col("first_score") - F.col("score")) <= 1e-6), F.col("usefulness"))).over(own)
    useful = F.min(F.when((F.col("best") > 0) & (F.col("usefulness") >= F.greatest(F.lit(least), F.col("best") - 1e-9)), F.col("rank"))).over(own)
    stay = F.max("same").over(own) < 2
    stay = stay | (F.col("first_useful") >= strong) | F.coalesce(peer <= F.col("first_useful") + 1e-9, F.lit(False))
    stay = stay | F.coalesce(F.col("first_score") - second >= lead, F.lit(False)) | (F.coalesce(useful, F.lit(1)) <= 1)
    new = F.row_number().over(own.orderBy(F.desc("usefulness"), F.desc("coverage"), F.desc("score"), "rank"))
    return paged.withColumns({"stay": stay, "new": new}).withColumn("new_rank", F.when(F.col("stay"), F.col("rank")).otherwise(F.col("new"))).drop("same", "stay", "new", "first_useful", "first_score", "best")


def answer_excerpts(evidence: DataFrame, most: int = 3, fingerprint: int = 160) -> DataFrame:
    """query_id, answer: the first few excerpts, each citation and each opening once."""
    opening = F.substring("snippet", 1, fingerprint)
    once = evidence.withColumn("k", F.row_number().over(Window.partitionBy("query_id", opening).orderBy("rank"))).where("k = 1")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    top = once.withColumn("k", order).where(F.col("k") <= most)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat(opening, F.lit(" ["), "citation_id", F.lit("]")).alias("line")))), lambda s: s["line"])
    return top.groupBy("query_id").agg(F.array_join(lines, "\n").alias("answer"))


def valid_citations(cited: Column, allowed: Column) -> Column:
    return F.array_intersect(F.array_distinct(cited), allowed)


def conversation_context(turns: DataFrame, last: int = 2, question: int = 220, answer: int = 360) -> DataFrame:
    """conv_id, turn, context: each user turn with the last turns before it, white space made single and cut to length."""
    flat = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\s]+", " "))
    cut = F.when(F.col("role") == "user", F.substring(flat, 1, question)).otherwise(F.substring(flat, 1, answer))
    line = turns.select("conv_id", "turn", "role", F.concat("role", F.lit(": "), cut).alias("line"))
    before = Window.partitionBy("conv_id").orderBy("turn", "role").rowsBetween(-last, -1)
    return line.select("conv_id", "turn", "role", F.array_join(F.collect_list("line").over(before), " | ").alias("context")).where("role = 'user'")


def visual_overlap(queries: DataFrame, assets: DataFrame, least: float = 0.1, k: int = 4) -> DataFrame:
    """query_id, asset_id, overlap: the assets that share the greatest part of a query's tokens (query_id, term), (asset_id, term)."""
    sizes = queries.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    shared = queries.join(assets, "term").groupBy("query_id", "asset_id").agg(F.count(F.lit(1)).alias("shared"))
    scored = shared.join(sizes, "query_id").select("query_id", "asset_id", (F.col("shared") / F.col("n")).alias("overlap")).where(F.col("overlap") >= least)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("overlap"), "asset_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


# Fixed values of the answer-intent behaviour.
GENERIC_TERMS = (
    "api", "apis", "branch", "branches", "commit", "commits", "docs", "documentation", "github", "markdown", "pull request", "readme", "repository",
    "repositories", "tutorial", "workflow",
)
TROUBLE_TERMS = (
    "how to", "what should", "troubleshoot", "fix", "fault", "problem", "weak", "low", "small", "怎么办", "怎麼辦", "如何处理", "如何處理", "怎么处理",
    "怎麼處理", "故障", "异常", "異常",
)


def answer_intent(question: Column) -> Column:
    """troubleshooting for questions with a term of trouble and none of documentation; else generic, null too."""
    return F.when(any_of(question, GENERIC_TERMS), "generic").when(any_of(question, TROUBLE_TERMS), "troubleshooting").otherwise("generic")
