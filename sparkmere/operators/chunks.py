"""Chunk tables: sections with their heading paths, splitting of long chunks and merging of short ones, and roll-ups of page quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmere.functions import chunking

MAX_CHARS, MIN_CHARS = 500, 50


def heading_paths(sections: DataFrame) -> DataFrame:
    """sections (doc_id, section, level, header, ...) with path: the headers of the levels above, and the own one; [''] without a heading.

    A heading ends those of its level and below. For each level the last header and its section are known by windows; those of a level count if no
    section of a smaller level came after them.
    """
    upto = Window.partitionBy("doc_id").orderBy("section")
    levels = range(1, 7)
    last = {k: F.last(F.when(F.col("level") == k, F.struct(F.col("section").alias("at"), F.col("header").alias("header"))), ignorenulls=True).over(upto) for k in levels}
    with_last = sections.select("*", *(c.alias(f"last_{k}") for k, c in last.items()))

    def at(k: int):
        return F.coalesce(F.col(f"last_{k}.at"), F.lit(-1))

    parts = [F.when((F.col("level") >= k) & F.col(f"last_{k}").isNotNull() & (F.greatest(F.lit(-1), *(at(j) for j in range(1, k)), F.lit(-1)) < at(k)), F.col(f"last_{k}.header")) for k in levels]
    path = F.when(F.col("level") > 0, F.array_compact(F.array(*parts))).otherwise(F.array(F.lit("")))
    return with_last.withColumn("path", path).drop(*(f"last_{k}" for k in levels))


def split_chunks(chunks: DataFrame, size: int = MAX_CHARS, overlap: int = 0) -> DataFrame:
    """doc_id, chunk, part, path, start_line, text, reason: chunks longer than size in parts, the others as they are (reason null)."""
    long = F.length("text") > size
    parts = F.when(long, chunking.split_text(F.col("text"), size, overlap)).otherwise(F.array("text"))
    each = chunks.select("doc_id", "chunk", "path", "start_line", long.alias("long"), F.posexplode(parts).alias("part", "text"))
    reason = F.when(F.col("long"), chunking.split_reason(F.col("text")))
    return each.select("doc_id", "chunk", "part", "path", (F.col("start_line") + F.col("part")).alias("start_line"), "text", reason.alias("reason"))


def merge_short(parts: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """doc_id, number, path, start_line, text, reason: a part shorter than least joins the one before if both have one path.

    Whether a part joins follows from its own length and the path before it, so that the runs are a running sum and not a loop.
    """
    order = Window.partitionBy("doc_id").orderBy("chunk", "part")
    joins = (F.length("text") < least) & F.col("path").eqNullSafe(F.lag("path").over(order)) & F.lag(F.lit(1)).over(order).isNotNull()
    runs = parts.withColumn("number", F.sum((~joins).cast("int")).over(order) - 1)
    own = F.struct("chunk", "part", "path", "start_line", "text", "reason")
    runs = runs.groupBy("doc_id", "number").agg(F.array_sort(F.collect_list(own)).alias("all")).withColumn("first", F.get("all", 0))
    return runs.select("doc_id", F.col("number").cast("int").alias("number"), "first.path", "first.start_line", chunking.joined_lines(F.col("all.text")).alias("text"), "first.reason")


def page_quality(pages: DataFrame, counts: list[str]) -> DataFrame:
    """doc_id, pages, the sums of counts, and warnings: how many pages have each (warnings array<string>), as a map."""
    sums = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in counts))
    warned = pages.select("doc_id", F.explode("warnings").alias("warning")).groupBy("doc_id", "warning").agg(F.count(F.lit(1)).alias("n"))
    warned = warned.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("warning", "n"))).alias("warnings"))
    return sums.join(warned, "doc_id", "left")
