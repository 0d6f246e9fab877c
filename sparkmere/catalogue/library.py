from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmere.catalogue import query
from sparkmere.functions.text import normalized_identifier, text_hash
from sparkmere.operators import library, search
from sparkmere.sources.tables import manuals, table

STATES = """
d AS (SELECT doc_id AS node_id, CAST(doc_id AS VARCHAR) AS key, 'sha256:' || sha256(text) AS h FROM documents),
o AS (SELECT key, node_id, h FROM d WHERE node_id % 10 <> 0),
n AS (SELECT key, CASE WHEN node_id % 7 = 0 THEN node_id + 1 ELSE node_id END AS node_id, CASE WHEN node_id % 10 = 3 THEN h || 'x' ELSE h END AS h FROM d WHERE node_id % 10 <> 1)
"""


def states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents before and after a change: some added, removed, changed and moved."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), F.col("doc_id").cast("string").alias("key"), text_hash(F.col("text")).alias("text_hash"))
    changed = F.when(F.col("node_id") % 10 == 3, F.concat("text_hash", F.lit("x"))).otherwise(F.col("text_hash"))
    moved = F.when(F.col("node_id") % 7 == 0, F.col("node_id") + 1).otherwise(F.col("node_id"))
    return docs.where("node_id % 10 != 0"), docs.where("node_id % 10 != 1").select("key", moved.alias("node_id"), changed.alias("text_hash"))


@query(f"WITH {STATES} SELECT coalesce(o.key, n.key) AS key, CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed' WHEN o.h = n.h THEN 'reused' ELSE 'changed' END AS outcome FROM o FULL JOIN n ON o.key = n.key")
def rebuild_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.rebuild_impact(*states(spark, sf_dir))


@query(f"WITH {STATES} SELECT coalesce(o.key, n.key) AS key, CASE WHEN n.key IS NULL THEN 'delete' WHEN o.key IS NULL OR o.h <> n.h THEN 'upsert' WHEN o.node_id = n.node_id THEN 'reuse' ELSE 'move' END AS action FROM o FULL JOIN n ON o.key = n.key")
def vector_sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.vector_sync(*states(spark, sf_dir))


@query("""WITH r AS (SELECT s_suppkey AS row, s_nationkey AS k, s_acctbal > 0 AS v FROM supplier)
SELECT row, 'DUPLICATE_KEY' AS code FROM r WHERE k IN (SELECT k FROM r GROUP BY k HAVING count(*) > 1) UNION ALL SELECT row, 'CONFLICTING_STATUS' FROM r WHERE k IN (SELECT k FROM r GROUP BY k HAVING min(v) <> max(v))""")
def duplicate_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row"), F.col("s_nationkey").alias("k"), (F.col("s_acctbal") > 0).alias("v"))
    return library.duplicates(rows, "k", "DUPLICATE_KEY").unionByName(library.conflicting(rows, "k", "v", "CONFLICTING_STATUS"))


@query("""WITH r AS (SELECT p_partkey AS row, CASE WHEN p_partkey % 3 = 0 THEN p_brand || '/' || p_size ELSE 'x/' || p_partkey END AS name FROM part),
f AS (SELECT DISTINCT p_brand || '/' || p_size AS file FROM part UNION ALL SELECT 'y/' || p_partkey FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'z/' || p_partkey FROM part WHERE p_partkey % 5 = 0),
e AS (SELECT row, file FROM r JOIN f ON name = file), l AS (SELECT * FROM r WHERE row NOT IN (SELECT row FROM e)),
b AS (SELECT row, min(file) AS file, count(*) AS n FROM l JOIN f ON split_part(name, '/', -1) = split_part(file, '/', -1) GROUP BY row)
SELECT row, file, 'exact' AS match FROM e UNION ALL SELECT row, CASE WHEN n = 1 THEN file END, CASE WHEN n = 1 THEN 'basename' ELSE 'ambiguous' END FROM b UNION ALL SELECT row, NULL, 'missing' FROM l WHERE row NOT IN (SELECT row FROM b)""")
def file_match_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    path = F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string"))
    key = F.col("p_partkey").cast("string")
    rows = part.select(F.col("p_partkey").alias("row"), F.when(F.col("p_partkey") % 3 == 0, path).otherwise(F.concat(F.lit("x/"), key)).alias("name"))
    files = part.select(path.alias("file")).distinct().unionByName(part.where("p_partkey % 2 = 0").select(F.concat(F.lit("y/"), key).alias("file"))).unionByName(part.where("p_partkey % 5 = 0").select(F.concat(F.lit("z/"), key).alias("file")))
    return library.file_matches(rows, files)


OPS = "CASE event_id % 4 WHEN 0 THEN 'upsert' WHEN 1 THEN 'metadata' WHEN 2 THEN 'file_replace' ELSE 'delete' END"


@query(f"WITH e AS (SELECT user_id AS manual, ts, event_id, {OPS} AS op FROM events) SELECT manual, 1 + count_if(op IN ('upsert', 'file_replace')) AS version, max(ts) AS updated, arg_max(op, (ts, event_id)) AS last_op FROM e GROUP BY manual")
def manual_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.versioned(table(spark, sf_dir, "events").select(F.col("user_id").alias("manual"), "ts", "event_id", F.expr(OPS).alias("op")))


INDEX = """ix AS (SELECT field, lower(trim(value)) AS value, count(DISTINCT node_id) AS nodes FROM (UNPIVOT (SELECT doc_id AS node_id, source, lang FROM documents) ON source, lang INTO NAME field VALUE value) GROUP BY ALL)"""


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.metadata_index(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "node_id"), ["source", "lang"])


@query(f"WITH {INDEX} SELECT * FROM ix")
def metadata_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir)


@query(f"""WITH {INDEX}, w AS (SELECT conv_id * 100 + turn AS query_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9#-]+'))) AS value FROM conversations),
h AS (SELECT query_id, min((field, value, nodes)) AS hit FROM w JOIN ix USING (value) GROUP BY ALL)
SELECT conv_id * 100 + turn AS query_id, CASE WHEN hit IS NULL THEN 'none' WHEN hit[3] < 130 THEN 'boost' ELSE 'hard_filter' END AS mode, hit[1] AS field, hit[2] AS value FROM conversations LEFT JOIN h ON query_id = conv_id * 100 + turn""")
def narrowing_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), "text")
    return library.narrowed(asked, index(spark, sf_dir), 130)


@query("""WITH g AS (SELECT user_id AS kb, event_id AS gen, CASE WHEN event_type = 'view' THEN 'active' ELSE 'retired' END AS state, ts AS retired_at FROM events)
SELECT kb, gen, state, retired_at FROM g WHERE state = 'retired' QUALIFY row_number() OVER (PARTITION BY kb ORDER BY retired_at DESC, gen DESC) > 20""")
def generation_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("event_type") == "view", "active").otherwise("retired")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("kb"), F.col("event_id").alias("gen"), state.alias("state"), F.col("ts").alias("retired_at"))
    return library.trimmed_generations(rows)


@query("SELECT n_name AS nation, CASE max(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END) WHEN 0 THEN 'ready' WHEN 1 THEN 'needs_review' ELSE 'not_ready' END AS status FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL")
def readiness_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("status") == "F", "ready").when(F.col("status") == "O", "needs_review").otherwise("not_ready")
    return library.worst_status(manuals(spark, sf_dir).withColumn("status", status), "nation")


@query("""WITH i AS (SELECT o_orderkey AS manual, 'f' || o_custkey AS source_file, o_orderstatus AS checksum FROM orders WHERE o_orderkey % 2 = 0),
x AS (SELECT o_orderkey AS manual, 'f' || o_custkey AS source_file, CASE WHEN o_orderkey % 5 = 0 THEN 'old' ELSE o_orderstatus END AS checksum FROM orders WHERE o_orderkey % 3 = 0)
SELECT i.manual, CASE WHEN a.manual IS NULL AND b.f IS NULL THEN 'create' WHEN a.checksum = i.checksum THEN 'unchanged' ELSE 'overwrite' END AS action
FROM i LEFT JOIN x a ON a.manual = i.manual LEFT JOIN (SELECT DISTINCT source_file AS f FROM x) b ON b.f = i.source_file""")
def bundle_import_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("manual"), F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("source_file"), F.col("o_orderstatus").alias("checksum"))
    known = rows.where("manual % 3 = 0").withColumn("checksum", F.when(F.col("manual") % 5 == 0, "old").otherwise(F.col("checksum")))
    return library.bundle_plan(rows.where("manual % 2 = 0"), known, "overwrite")


@query("SELECT doc_id, source, lang FROM documents WHERE lower(source) = 'src3' AND lower(lang) = 'en'")
def filter_nodes_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.matching(table(spark, sf_dir, "documents"), {"source": " SRC3 ", "lang": "EN", "brand": " "}).select("doc_id", "source", "lang")


@query("SELECT p_partkey FROM part WHERE lower(p_brand) IN ('brand#11', 'brand#23') OR lower(p_type) = 'small brass'")
def filter_nodes_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = table(spark, sf_dir, "part").withColumn("tags", F.array("p_brand", "p_type"))
    return search.matching(tagged, {"tags": ["Brand#11", " brand#23", "Small Brass"]}).select("p_partkey")


@query("""WITH t AS (SELECT s_suppkey, regexp_replace(lower(replace(s_name, chr(92), '/')), '[^a-z0-9/._-]+', '-', 'g') AS x FROM supplier)
SELECT s_suppkey, CASE WHEN y = '' THEN 'manual' ELSE y END AS identifier FROM (SELECT s_suppkey, regexp_replace(regexp_replace(regexp_replace(x, '[/_.]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS y FROM t)""")
def normalized_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", normalized_identifier(F.col("s_name")).alias("identifier"))
