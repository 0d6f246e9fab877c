"""Expectations of evaluation cases: which results meet them, negatives, and the run's metrics by case and suite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plain_spaced(text: Column) -> Column:
    """Control characters and white space as single spaces."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\p{C}]+", " "))


def _contains(text: Column, needle: Column) -> Column:
    return F.contains(text, needle) | ((plain_spaced(needle) != "") & F.contains(plain_spaced(text), plain_spaced(needle)))


def matches(results: DataFrame, expected: DataFrame) -> DataFrame:
    """case_id, rank, expectation, matched, ambiguous of each result with each expectation of its case.

    results: case_id, rank, source_file, header, anchor_key, text, metadata (map to array<string>); expected: case_id, expectation, source_file, header,
    anchor_key, needles (array<string>), wanted (map to array<string>); null or empty asks for nothing. A file name without a folder stands for the one file
    of that name among the case's results; if there are several it is ambiguous and doesn't match.
    """
    named = results.withColumn("name", F.substring_index("source_file", "/", -1)).where("case_id IS NOT NULL AND name IS NOT NULL")
    # Over peers of a name within the case, which leaves rows dealt by case where they are; a join by case and name would shuffle whole results twice.
    own = Window.partitionBy("case_id").orderBy("name").rangeBetween(Window.currentRow, Window.currentRow)
    named = named.withColumn("several", F.min("source_file").over(own) != F.max("source_file").over(own))
    asked = expected.select("case_id", "expectation", "needles", "wanted", *(F.col(c).alias(f"want_{c}") for c in ("source_file", "header", "anchor_key")))
    both = named.join(asked, "case_id")

    def open_(c: str) -> Column:
        return F.coalesce(F.col(f"want_{c}"), F.lit("")) == ""

    by_name = ~F.col("want_source_file").rlike(r"[/\\]") & (F.col("name") == F.col("want_source_file"))
    same = F.col("source_file") == F.col("want_source_file")
    source = open_("source_file") | same | (by_name & ~F.col("several"))
    texts = F.forall(F.coalesce("needles", F.array().cast("array<string>")), lambda n: _contains(F.col("text"), n))
    entries = F.coalesce(F.map_entries("wanted"), F.array().cast("array<struct<key:string,value:array<string>>>"))
    metadata = F.forall(entries, lambda e: F.size(F.array_except(e["value"], F.coalesce(F.try_element_at("metadata", e["key"]), F.array().cast("array<string>")))) == 0)
    header = open_("header") | (F.trim("header") == F.trim("want_header"))
    anchor = open_("anchor_key") | F.coalesce(F.col("anchor_key") == F.col("want_anchor_key"), F.lit(False))
    ambiguous = ~open_("source_file") & ~same & by_name & F.col("several")
    return both.select("case_id", "rank", "expectation", (source & texts & metadata & header & anchor).alias("matched"), ambiguous.alias("ambiguous"))


def negative_hits(results: DataFrame, negatives: DataFrame, k: int) -> DataFrame:
    """case_id, hits: how many (result, negative) pairs match in the first k; a case with any fails."""
    found = matches(results, negatives).where(F.col("matched") & (F.col("rank") <= k))
    return found.groupBy("case_id").agg(F.count(F.lit(1)).alias("hits"))


def case_metrics(cases: DataFrame, matched: DataFrame, negatives: DataFrame, k: int, floors: dict[str, float]) -> DataFrame:
    """case_id, suite, precision, recall, mrr, hit, first_rank, negatives, failures, passed of all cases (case_id, suite, n expectations).

    Precision counts results with any expectation against k, recall the distinct expectations met.
    """
    top = matched.where(F.col("matched") & (F.col("rank") <= k)).groupBy("case_id").agg(F.count_distinct("rank").alias("relevant"), F.count_distinct("expectation").alias("met"), F.min("rank").alias("first_rank"))
    own = cases.join(top, "case_id", "left").join(negatives.withColumnRenamed("hits", "negatives"), "case_id", "left").fillna(0, ["relevant", "met", "negatives"])
    own = own.select(
        "case_id", "suite", F.round(F.col("relevant") / k, 6).alias("precision"), F.when(F.col("n") > 0, F.round(F.col("met") / F.col("n"), 6)).otherwise(0.0).alias("recall"),
        F.round(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), 6).alias("mrr"), (F.col("relevant") > 0).cast("double").alias("hit"), "first_rank", "negatives",
    )
    failures = F.array_compact(F.array(*(F.when(F.col(n) < floor, n) for n, floor in floors.items()), F.when(F.col("negatives") > 0, "negatives")))
    return own.withColumn("failures", F.array_join(failures, ",")).withColumn("passed", F.col("failures") == "")


def run_summary(metrics: DataFrame) -> DataFrame:
    """suite, cases, passed, and the macro averages."""
    return metrics.groupBy("suite").agg(F.count(F.lit(1)).alias("cases"), F.count_if("passed").alias("passed"), *(F.round(F.avg(n), 6).alias(n) for n in ("precision", "recall", "mrr", "hit")))


def context_quality(cases: DataFrame, matched: DataFrame, selected: DataFrame) -> DataFrame:
    """suite, cases, selected_rate: the share of cases of whose expected evidence a result (case_id, rank) was selected into the context."""
    found = matched.where("matched").join(selected.select("case_id", "rank"), ["case_id", "rank"], "left_semi").select("case_id").distinct().withColumn("found", F.lit(1))
    return cases.join(found, "case_id", "left").groupBy("suite").agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg(F.coalesce("found", F.lit(0))), 6).alias("selected_rate"))


def page_dominance(results: DataFrame, k: int, near: float) -> DataFrame:
    """case_id, source_file, source_hits, header_hits, near_ties, diagnosis of the first k results (case_id, rank, score, source_file, header).

    The most frequent file and header of a case, how many scores lie within near of the best, and what that suggests.
    """
    top = results.where(F.col("rank") <= k)
    files = top.groupBy("case_id", "source_file").agg(F.count(F.lit(1)).alias("n")).groupBy("case_id").agg(F.max("n").alias("source_hits"), F.max_by("source_file", F.struct("n", "source_file")).alias("source_file"))
    headers = top.groupBy("case_id", "source_file", "header").agg(F.count(F.lit(1)).alias("n")).groupBy("case_id").agg(F.max("n").alias("header_hits"))
    best = top.groupBy("case_id").agg(F.max("score").alias("best"))
    ties = top.join(best, "case_id").groupBy("case_id").agg((F.count_if(F.col("best") - F.col("score") <= near) - 1).alias("near_ties"))
    diagnosis = F.when(F.col("header_hits") >= 2, "same_header").when((F.col("source_hits") >= 2) & (F.col("near_ties") > 0), "same_page_near_tie").when(F.col("source_hits") >= 2, "same_page").otherwise("spread")
    return files.join(headers, "case_id").join(ties, "case_id").select("case_id", "source_file", "source_hits", "header_hits", "near_ties", diagnosis.alias("diagnosis"))


def facets(nodes: DataFrame, fields: list[str]) -> DataFrame:
    """field, value, n: how many nodes have each value of each field, in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields)))
    return nodes.select(pairs.alias("x")).select("x.*").where("value IS NOT NULL AND value <> ''").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def worst_status(checks: DataFrame, group: str, order: list[str]) -> DataFrame:
    """group, status: the worst status of each group's checks, order being from best to worst, and how many checks have it."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("status"))
    ranked = checks.groupBy(group, "status").agg(F.count(F.lit(1)).alias("n")).withColumn("place", place)
    return ranked.groupBy(group).agg(F.max_by("status", "place").alias("status"), F.max_by("n", "place").alias("n"))
