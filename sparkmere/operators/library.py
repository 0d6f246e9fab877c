"""Library state: identities, rebuild impact, bulk import checks, narrowing by metadata, generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rebuild_impact(old: DataFrame, new: DataFrame) -> DataFrame:
    """key, outcome of chunks (key, text_hash): added, removed, changed or reused."""
    joined = old.select("key", F.col("text_hash").alias("a")).join(new.select("key", F.col("text_hash").alias("b")), "key", "full")
    outcome = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "reused").otherwise("changed")
    return joined.select("key", outcome.alias("outcome"))


def vector_sync(old: DataFrame, new: DataFrame) -> DataFrame:
    """key, action of vectors (key, node_id, text_hash): upsert, delete, reuse, or move if only the node differs."""
    joined = old.select("key", F.col("node_id").alias("a_node"), F.col("text_hash").alias("a")).join(new.select("key", F.col("node_id").alias("b_node"), F.col("text_hash").alias("b")), "key", "full")
    action = (
        F.when(F.col("b").isNull(), "delete").when(F.col("a").isNull() | (F.col("a") != F.col("b")), "upsert").when(F.col("a_node") == F.col("b_node"), "reuse").otherwise("move")
    )
    return joined.select("key", action.alias("action"))


def duplicates(rows: DataFrame, key: str, code: str) -> DataFrame:
    """row, code of every row whose key occurs twice or more; the counts are joined back, not windowed, as a key may be frequent."""
    repeated = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)
    return rows.join(repeated, key, "left_semi").select("row", F.lit(code).alias("code"))


def conflicting(rows: DataFrame, key: str, value: str, code: str) -> DataFrame:
    mixed = rows.groupBy(key).agg(F.min(value).alias("a"), F.max(value).alias("b")).where("a != b").select(key)
    return rows.join(mixed, key, "left_semi").select("row", F.lit(code).alias("code"))


def file_matches(rows: DataFrame, files: DataFrame) -> DataFrame:
    """row, file, match: by exact name first, what is left by base name; several base names are ambiguous. rows: row, name; files: file."""
    exact = rows.join(files, F.col("name") == F.col("file")).select("row", "file", F.lit("exact").alias("match"))
    left = rows.join(exact, "row", "left_anti")

    def base(c: str) -> Column:
        return F.element_at(F.split(c, "/"), -1)

    found = left.withColumn("base", base("name")).join(files.withColumn("base", base("file")), "base").groupBy("row").agg(F.min("file").alias("file"), F.count(F.lit(1)).alias("n"))
    by_base = found.select("row", F.when(F.col("n") == 1, F.col("file")).alias("file"), F.when(F.col("n") == 1, "basename").otherwise("ambiguous").alias("match"))
    missing = left.join(found, "row", "left_anti").select("row", F.lit(None).cast("string").alias("file"), F.lit("missing").alias("match"))
    return exact.unionByName(by_base).unionByName(missing)


def versioned(events: DataFrame) -> DataFrame:
    """manual, version, updated, status: the state after a log of changes (manual, ts, event_id, op); only replacements and upserts raise the version."""
    raising = F.count_if(F.col("op").isin("file_replace", "upsert"))
    return events.groupBy("manual").agg((1 + raising).alias("version"), F.max("ts").alias("updated"), F.max_by("op", F.struct("ts", "event_id")).alias("last_op"))


def metadata_index(nodes: DataFrame, fields: list[str]) -> DataFrame:
    """field, value, nodes: how many nodes have each normalised value."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.lower(F.trim(F.col(f))).alias("value")) for f in fields))
    return nodes.select("node_id", F.explode(pairs).alias("p")).where("p.value != ''").groupBy("p.field", "p.value").agg(F.count_distinct("node_id").alias("nodes"))


def narrowed(queries: DataFrame, index: DataFrame, least: int) -> DataFrame:
    """query_id, mode, field, value: the first indexed value, in order of field and value, that is a word of the query.

    A value with fewer than least nodes only boosts; without a value there is no narrowing.
    """
    words = queries.select("query_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^a-z0-9#-]+"))).alias("value"))
    hits = words.join(index, "value").groupBy("query_id").agg(F.min(F.struct("field", "value", "nodes")).alias("hit"))
    joined = queries.select("query_id").join(hits, "query_id", "left")
    mode = F.when(F.col("hit").isNull(), "none").when(F.col("hit.nodes") < least, "boost").otherwise("hard_filter")
    return joined.select("query_id", mode.alias("mode"), F.col("hit.field").alias("field"), F.col("hit.value").alias("value"))


def trimmed_generations(generations: DataFrame, keep: int = 20) -> DataFrame:
    """The generations (kb, gen, state, retired_at) to drop: the oldest retired beyond keep; active and shadow ones never."""
    rank = F.row_number().over(Window.partitionBy("kb").orderBy(F.desc("retired_at"), F.desc("gen")))
    return generations.where("state = 'retired'").withColumn("k", rank).where(F.col("k") > keep).drop("k")


def worst_status(rows: DataFrame, group: str) -> DataFrame:
    order = F.element_at(F.create_map(*(F.lit(x) for p in {"ready": 0, "needs_review": 1, "not_ready": 2}.items() for x in p)), F.col("status"))
    return rows.groupBy(group).agg(F.max_by("status", order).alias("status"))


def bundle_plan(incoming: DataFrame, existing: DataFrame, mode: str = "skip") -> DataFrame:
    """manual, action of bundle entries (manual, source_file, checksum): matched by manual first, then by source file."""
    by_id = existing.select(F.col("manual").alias("m1"), F.col("checksum").alias("c1"))
    by_file = existing.groupBy(F.col("source_file").alias("f2")).agg(F.min("manual").alias("m2"))
    joined = incoming.join(by_id, F.col("manual") == F.col("m1"), "left").join(by_file, F.col("source_file") == F.col("f2"), "left")
    met = {"skip": "skip", "overwrite": "overwrite", "fail": "conflict"}[mode]
    action = F.when(F.col("m1").isNull() & F.col("m2").isNull(), "create").when(F.col("c1") == F.col("checksum"), "unchanged").otherwise(met)
    return joined.select("manual", action.alias("action"))
