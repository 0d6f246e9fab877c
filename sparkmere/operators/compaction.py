"""Usefulness of texts for a question by the wording of definitions and instructions, and the sentences of a text that a small budget keeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the usefulness behaviour.
DEFINITIONS = (
    r"\bis (?:a|an|the)\b", r"\bare (?:a|an|the|written|used|available)\b", r"\bmeans\b", r"\brefers to\b", r"\bas (?:a|an|the)\b", r"\bcontains?\b", r"\binclude?s?\b",
)
ACTIONS = (
    r"\bmust\b", r"\bshould\b", r"\bcan\b", r"\bif\b", r"\bwhen\b", r"\bchoose\b", r"\bselect\b", r"\buse\b", r"\bopen\b", r"\bclick\b", "請", "如果", "使用", "選擇", "清潔",
)
CHROME_CHARS = 180
MOST_SENTENCES, LEAST_SCORE, LEAST_SHARE = 3, 0.2, 0.45


def terms(text: Column) -> Column:
    """Distinct runs of letters a-z, digits and CJK of two characters or more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9㐀-鿿]+"), F.lit(0)), lambda t: F.length(t) >= 2))


def cue_counts(text: Column, patterns: tuple[str, ...]) -> Column:
    """How many of the patterns occur."""
    return reduce(lambda a, b: a + b, (text.rlike(p).cast("int") for p in patterns))


def usefulness(text: Column, asked: Column) -> Column:
    """0 and up: the share of the asked terms (array) that a text has, cues of definitions, and cues of actions if it has enough; less if it starts as a menu."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))

    def score(plain: Column) -> Column:
        share = F.size(F.array_intersect(terms(plain), asked)) / F.greatest(F.lit(1), F.size(asked))
        head = F.substring(plain, 1, CHROME_CHARS)
        chrome = F.when(head.contains("source: http") | head.contains("navigation"), 0.2).otherwise(0.0)
        cues = F.least(F.lit(0.36), 0.12 * cue_counts(plain, DEFINITIONS)) + F.when(share >= 0.35, F.least(F.lit(0.12), 0.04 * cue_counts(plain, ACTIONS))).otherwise(0.0)
        return F.when(plain == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(0.4), share) + cues - chrome))

    return F.get(F.transform(F.array(plain), score), 0)


# Fixed values of the ordering of one page's results.
CHROME = ("source:", "navigation", "copy as markdown", "article ", "next :", "previous", "table of contents")


def page_usefulness(text: Column, asked: Column) -> tuple[Column, Column]:
    """(coverage, usefulness) of a result with its heading, by which results of one page are ordered."""
    low = F.lower(text)
    share = F.when(F.size(asked) > 0, F.size(F.array_intersect(terms(text), asked)) / F.size(asked)).otherwise(0.0)
    head = F.substring(F.trim(F.regexp_replace(low, r"\s+", " ")), 1, CHROME_CHARS)
    framed = F.concat(F.lit(" "), low, F.lit(" "))
    menus = reduce(lambda a, b: a + b, (framed.contains(c).cast("int") for c in CHROME))
    chrome = F.when(head.contains("source: http") | head.contains("navigation") | (menus > 0), F.least(F.lit(0.2), 0.08 * F.greatest(F.lit(1), menus))).otherwise(0.0)
    cues = F.least(F.lit(0.36), 0.12 * cue_counts(framed, DEFINITIONS)) + F.when(share >= 0.35, F.least(F.lit(0.12), 0.04 * cue_counts(framed, ACTIONS[:-1]))).otherwise(0.0)
    score = F.when(F.trim(text) == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(0.4), share) + cues - chrome))
    return F.round(share, 6), F.round(score, 6)


def sentence_score(sentence: Column, asked: Column) -> Column:
    met = F.size(F.array_intersect(terms(sentence), asked))
    return met / F.greatest(F.lit(1), F.size(asked)) + F.least(F.lit(0.24), 0.08 * met) + 0.5 * usefulness(sentence, asked)


def compaction_target(budget: int) -> int:
    return 1 if budget <= 0 else max(48, min(180, int(budget * 0.45)))


def ranked_sentences(rows: DataFrame) -> DataFrame:
    """query_id, node_id, all: the sentences of each row's text (query_id, node_id, text, asked terms), the best first: order (less is better), at, size, sentence."""
    plain = F.trim(F.regexp_replace("text", r"\s+", " "))
    pieces = F.filter(F.transform(F.split(plain, r"(?<=[。.!?！？；;])\s+"), F.trim), lambda s: s != "")
    scored = rows.select("query_id", "node_id", "asked", F.posexplode(pieces).alias("at", "sentence")).withColumn("score", sentence_score(F.col("sentence"), F.col("asked")))
    own = F.struct((-F.col("score")).alias("order"), "at", F.length("sentence").alias("size"), "sentence")
    return scored.groupBy("query_id", "node_id").agg(F.array_sort(F.collect_list(own)).alias("all"))


def compacted(rows: DataFrame, target: int) -> DataFrame:
    """rows (query_id, node_id, text, asked terms) with content: the text, or if it has more than target tokens its best sentences in their order.

    Sentences come by score, then place; after the first those count that have LEAST_SCORE and LEAST_SHARE of the best score, MOST_SENTENCES in all, while
    their joined length fits the target. Sentences are scored as rows; the fold runs over one text's sentences.
    """
    ranked = ranked_sentences(rows.where(F.floor((F.length("text") + 3) / 4) > target))
    start = F.struct(F.array().cast("array<struct<at:int,sentence:string>>").alias("kept"), F.lit(0).alias("size"))

    def step(s: Column, x: Column) -> Column:
        none = F.size(s["kept"]) == 0
        size = F.when(none, x["size"]).otherwise(s["size"] + 1 + x["size"])
        good = none | (-x["order"] >= F.greatest(F.lit(LEAST_SCORE), -F.get("all", 0)["order"] * LEAST_SHARE))
        take = (F.size(s["kept"]) < MOST_SENTENCES) & good & (F.greatest(F.lit(1), F.floor((size + 3) / 4)) <= target)
        kept = F.array_append(s["kept"], F.struct(x["at"].alias("at"), x["sentence"].alias("sentence")))
        return F.when(take, F.struct(kept.alias("kept"), size.cast("int").alias("size"))).otherwise(s)

    chosen = F.aggregate("all", start, step, lambda s: F.array_join(F.transform(F.array_sort(s["kept"]), lambda k: k["sentence"]), " "))
    short = ranked.where(F.size("all") > 1).select("query_id", "node_id", chosen.alias("short"))
    joined = rows.join(short, ["query_id", "node_id"], "left")
    return joined.select("query_id", "node_id", F.when(F.coalesce("short", F.lit("")) != "", F.col("short")).otherwise(F.col("text")).alias("content"))
