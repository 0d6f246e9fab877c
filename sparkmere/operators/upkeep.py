"""Upkeep of a knowledge base: connector sync, incremental plans, dirty manifests, the rebuild queue, inspections, manifests and index generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_DIRTY_MANUALS, MOST_DIRTY_CHUNKS = 20, 500
RETIRE_HOURS = 24


def synced(records: DataFrame) -> DataFrame:
    """manual, payload, status: a connector's records (manual, seq, op, payload) folded to the last of each manual; a delete leaves a tombstone."""
    last = records.groupBy("manual").agg(F.max_by(F.struct("op", "payload"), "seq").alias("last"))
    deleted = F.col("last.op") == "delete"
    return last.select("manual", F.when(~deleted, F.col("last.payload")).alias("payload"), F.when(deleted, "deleted").otherwise("active").alias("status"))


def sidecar_metadata(files: DataFrame, sidecars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source_file, manual, title, tags of each file, from its sidecar or from its path), (manual, files: ids that several files claim).

    A sidecar (path, manual, title, tags) lies beside its file as <stem>.metadata.json.
    """
    stem = F.regexp_replace("source_file", r"\.[^./]*$", "")
    beside = sidecars.withColumn("stem", F.regexp_replace("path", r"\.metadata\.json$", "")).select("stem", "manual", "title", "tags")
    joined = files.withColumn("stem", stem).join(beside, "stem", "left")
    name = F.substring_index("stem", "/", -1)
    found = joined.select("source_file", F.coalesce("manual", F.regexp_replace(F.lower("stem"), "[^a-z0-9]+", "-")).alias("manual"), F.coalesce("title", name).alias("title"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    return found, found.groupBy("manual").agg(F.count(F.lit(1)).alias("files")).where("files > 1")


BULK = "manual string, source_file string, tags string"


def _bulk(rows: DataFrame, broken: Column, tag_separator: str) -> DataFrame:
    """row, manual, source_file, tags, error of rows (row, x: struct of BULK)."""
    raw = F.coalesce(F.col("x.tags"), F.lit(""))
    split = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.split(raw, tag_separator))
    tags = F.array_distinct(F.filter(F.transform(split, lambda t: F.lower(F.trim(t))), lambda t: t != ""))
    error = F.when(broken, "INVALID_ROW").when(F.coalesce(F.trim("x.manual"), F.lit("")) == "", "MISSING_MANUAL_ID")
    return rows.select("row", F.col("x.manual").alias("manual"), F.col("x.source_file").alias("source_file"), F.coalesce(tags, F.array().cast("array<string>")).alias("tags"), error.alias("error"))


def bulk_rows(lines: DataFrame, tag_separator: str = r"[,;|]") -> DataFrame:
    """row, manual, source_file, tags, error of JSON lines (row, line): tags as a list or as one string to split; a line that isn't an object has an error."""
    parsed = lines.withColumn("x", F.from_json("line", BULK))
    return _bulk(parsed, F.col("x").isNull() | ~F.coalesce(F.trim("line").startswith("{"), F.lit(False)), tag_separator)


def bulk_array_rows(files: DataFrame, tag_separator: str = r"[,;|]") -> DataFrame:
    """file, row, manual, source_file, tags, error of JSON arrays of objects (file, text); row is the place in the array, a text that is no array one broken row."""
    items = F.from_json("text", "array<string>")
    rows = files.select("file", F.posexplode(F.when(F.size(F.coalesce(items, F.array().cast("array<string>"))) > 0, items).otherwise(F.array(F.lit(None).cast("string")))).alias("place", "line"))
    numbered = rows.select(F.struct("file", "place").alias("row"), "line")
    return bulk_rows(numbered, tag_separator).select("row.file", F.col("row.place").alias("row"), "manual", "source_file", "tags", "error")


def bulk_csv_rows(lines: DataFrame, header: list[str], tag_separator: str = r"[;|]") -> DataFrame:
    """row, manual, source_file, tags, error of CSV lines (row, line) under a header, whatever the order of its columns; others than BULK's are left aside.

    A line with fewer or more fields than the header has an error.
    """
    schema = ", ".join(f"c{k} string" for k in range(len(header))) + ", bad string"
    parsed = lines.withColumn("c", F.from_csv("line", schema, {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}))
    at = {name.strip().lower(): k for k, name in enumerate(header)}
    fields = [(F.col(f"c.c{at[n]}") if n in at else F.lit(None).cast("string")).alias(n) for n in ("manual", "source_file", "tags")]
    broken = F.col("line").isNull() | (F.trim("line") == "") | F.col("c.bad").isNotNull()
    return _bulk(parsed.withColumn("x", F.struct(*fields)), broken, tag_separator)


def loaded_vectors(wanted: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node_id, vector of wanted ids, in the store), (node_id of wanted ids that the store lacks: a load with any fails)."""
    return wanted.join(vectors, "node_id"), wanted.join(vectors, "node_id", "left_anti")


def suite_cases(lines: DataFrame, schema: str) -> DataFrame:
    """row, case_id, error and the parsed case of a suite's JSON lines (row, line): malformed rows, missing fields and repeated ids are told, not dropped."""
    parsed = lines.withColumn("case", F.from_json("line", schema))
    own = parsed.select("row", F.col("case.id").alias("case_id"), "case")
    often = own.where("case_id IS NOT NULL").groupBy("case_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1")  # lines without an id don't meet
    error = F.when(F.col("case").isNull() | F.col("case_id").isNull(), "malformed").when(F.coalesce(F.trim("case.query"), F.lit("")) == "", "query").when(F.col("times") > 1, "duplicate_id")
    return own.join(often, "case_id", "left").select("row", "case_id", error.alias("error"), "case")


def incremental_plan(old: DataFrame, new: DataFrame, dirty: DataFrame) -> DataFrame:
    """identity_key, manual, action of the new chunks (identity_key, manual): kept (clean manual), reused (dirty, but an old vector has its key, once) or embed."""
    changed = new.join(dirty.select("manual").withColumn("dirty", F.lit(True)), "manual", "left")
    known = old.select("identity_key").distinct().withColumn("known", F.lit(True))
    place = F.row_number().over(Window.partitionBy("identity_key", F.col("dirty").isNotNull()).orderBy("manual", "chunk"))
    told = changed.withColumn("place", place).join(known, "identity_key", "left")
    action = F.when(F.col("dirty").isNull(), "kept").when(F.col("known").isNotNull() & (F.col("place") == 1), "reused").otherwise("embed")
    return told.select("manual", "chunk", "identity_key", action.alias("action"))


def auto_mode(plan: DataFrame) -> DataFrame:
    """kb, dirty_manuals, dirty_chunks, mode: incremental while few manuals and chunks are dirty. plan: kb, manual, action."""
    counts = plan.groupBy("kb").agg(F.count_distinct(F.when(F.col("action") != "kept", F.col("manual"))).alias("dirty_manuals"), F.count_if(F.col("action") == "embed").alias("dirty_chunks"))
    few = (F.col("dirty_manuals") <= MOST_DIRTY_MANUALS) & (F.col("dirty_chunks") <= MOST_DIRTY_CHUNKS)
    return counts.withColumn("mode", F.when(few, "incremental").otherwise("full"))


def dirty_manifest(marks: DataFrame, builds: DataFrame) -> DataFrame:
    """manual, reason, marked_at: the last mark (manual, at, reason) of each manual that no build (manual, at) has cleared since."""
    last = marks.groupBy("manual").agg(F.max_by("reason", F.struct("at", "reason")).alias("reason"), F.max("at").alias("marked_at"))
    cleared = builds.groupBy("manual").agg(F.max("at").alias("built_at"))
    return last.join(cleared, "manual", "left").where(F.col("built_at").isNull() | (F.col("built_at") < F.col("marked_at"))).drop("built_at")


def rebuild_queue(requests: DataFrame) -> DataFrame:
    """kb, first_at, requests, mode, manuals: waiting requests (kb, at, mode, manual) coalesced to a job a base; full beats incremental."""
    full = F.max((F.col("mode") == "full").cast("int")) == 1
    return requests.groupBy("kb").agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("requests"), F.when(full, "full").otherwise("incremental").alias("mode"), F.count_distinct("manual").alias("manuals"))


def retry_at(failed_at: Column, attempt: Column, base_seconds: int = 30, most_seconds: int = 3600) -> Column:
    """When a failed job is tried again: base seconds, doubled with each attempt, up to a bound."""
    return failed_at + F.make_dt_interval(secs=F.least(F.lit(most_seconds), base_seconds * F.pow(F.lit(2), attempt - 1)))


def metadata_messages(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """manual, field, code, severity of rows (manual, source_file, status, tags): what a registry (manual) would object to. Info doesn't block."""
    known = existing.select("manual").distinct().withColumn("known", F.lit(True))
    own = rows.join(known, "manual", "left")

    def message(condition: Column, field: str, code: str, severity: str) -> Column:
        return F.when(condition, F.struct(F.lit(field).alias("field"), F.lit(code).alias("code"), F.lit(severity).alias("severity")))

    unsafe = F.col("source_file").rlike(r"(^|/)\.\.(/|$)|^/|\\")
    messages = F.array_compact(F.array(
        message(F.coalesce(F.trim("manual"), F.lit("")) == "", "manual_id", "MISSING_MANUAL_ID", "error"), message(unsafe, "source_file", "UNSAFE_SOURCE_PATH", "error"),
        message(~F.lower(F.trim(F.coalesce("status", F.lit("")))).isin("", "active", "disabled", "archived"), "status", "INVALID_STATUS", "error"),
        message(F.col("known").isNotNull(), "manual_id", "DUPLICATE_MANUAL_ID", "error"), message(F.size("tags") >= 2, "tags", "TAG_ORDERING_HINT", "info"),
    ))
    return own.select("manual", F.explode(messages).alias("m")).select("manual", "m.*")


def vector_inspection(nodes: DataFrame, points: DataFrame, dims: int) -> DataFrame:
    """node_id, problem: ids that the store lacks, has too many, or holds in another dimension."""
    both = nodes.select("node_id", F.lit(True).alias("node")).join(points.select("node_id", F.size("vector").alias("size"), F.lit(True).alias("point")), "node_id", "full")
    problem = F.when(F.col("point").isNull(), "missing").when(F.col("node").isNull(), "extra").when(F.col("size") != dims, "dimension")
    return both.select("node_id", problem.alias("problem")).where("problem IS NOT NULL")


def asset_problems(manifest: DataFrame, stored: DataFrame, documents: DataFrame) -> DataFrame:
    """asset, problem: assets of the manifest (asset, doc_id) whose file is missing or whose document is gone, and stored files that it doesn't name."""
    kept = manifest.join(documents.select("doc_id").withColumn("doc", F.lit(True)), "doc_id", "left")
    both = kept.join(stored.select("asset").withColumn("file", F.lit(True)), "asset", "full")
    problem = F.when(F.col("doc_id").isNull(), "orphan_file").when(F.col("doc").isNull(), "orphan_entry").when(F.col("file").isNull(), "missing_file")
    return both.select("asset", problem.alias("problem")).where("problem IS NOT NULL")


def migration_report(sidecars: DataFrame, registry: DataFrame) -> DataFrame:
    """manual, outcome of moving sidecars (manual, checksum) into a registry: new, same, or conflict of checksums; registry rows without sidecar are kept."""
    both = sidecars.select("manual", F.col("checksum").alias("own")).join(registry.select("manual", F.col("checksum").alias("other")), "manual", "full")
    outcome = F.when(F.col("other").isNull(), "new").when(F.col("own").isNull(), "registry_only").when(F.col("own") == F.col("other"), "same").otherwise("conflict")
    return both.select("manual", outcome.alias("outcome"))


def cooccurrence_to_save(edges: DataFrame) -> DataFrame:
    """Edges in order of (src, dst), in ranges of it; an empty graph is refused rather than written over a good one."""
    if edges.isEmpty():
        raise ValueError("an empty cooccurrence graph is not saved")
    return edges.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst")


def generation_faults(generations: DataFrame, pointers: DataFrame) -> DataFrame:
    """kb, fault: pointers (kb, active, shadow) against generations (kb, generation, state, swap_at)."""
    own = generations.select("kb", "generation", "state", "swap_at")
    active = own.select("kb", F.col("generation").alias("active"), F.col("state").alias("active_state"), F.col("swap_at").alias("active_swap"))
    shadow = own.select("kb", F.col("generation").alias("shadow"), F.col("state").alias("shadow_state"))
    joined = pointers.join(active, ["kb", "active"], "left").join(shadow, ["kb", "shadow"], "left")
    faults = F.array_compact(F.array(
        F.when(F.col("active") == F.col("shadow"), "active_is_shadow"),
        F.when(F.col("active").isNotNull() & ~F.coalesce(F.col("active_state") == "ready", F.lit(False)), "active_not_ready"),
        F.when((F.col("active_state") == "ready") & F.col("active_swap").isNull(), "active_without_swap"),
        F.when(F.col("shadow").isNotNull() & ~F.coalesce(F.col("shadow_state") == "shadow", F.lit(False)), "shadow_not_building"),
    ))
    return joined.select("kb", F.explode(faults).alias("fault"))


def retirement(generations: DataFrame, pointers: DataFrame, now: Column, force: bool = False) -> DataFrame:
    """kb, generation, decision: retire, or why not. Only ready generations retire, none that is active or shadow, none within RETIRE_HOURS of its swap."""
    joined = generations.join(pointers, "kb", "left")
    young = F.lit(False) if force else F.coalesce(now - F.col("swap_at") < F.expr(f"INTERVAL '{RETIRE_HOURS}' HOUR"), F.lit(False))
    decision = (
        F.when(F.col("generation").eqNullSafe(F.col("active")), "refused_active").when(F.col("generation").eqNullSafe(F.col("shadow")), "refused_shadow")
        .when(F.col("state") != "ready", "refused_not_ready").when(young, "refused_too_young").otherwise("retire")
    )
    return joined.select("kb", "generation", decision.alias("decision"))
