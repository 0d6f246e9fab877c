from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmere.catalogue import query
from sparkmere.plans import log
from sparkmere.sources.tables import table
from sparkmere.streaming.windows import sessions, windowed


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("plan_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("intent"), F.col("value").alias("latency_ms"), "user_id", "props")


@query("""WITH i AS (SELECT event_id AS plan_id, event_type AS intent, value AS latency_ms FROM events WHERE event_id % 2 = 0),
u AS (SELECT event_id - event_id % 10 AS plan_id, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS intent, CASE WHEN event_id % 5 = 1 THEN NULL ELSE value END AS latency_ms FROM events WHERE event_id % 2 = 1),
l AS (SELECT plan_id, arg_max(intent, seq) AS a, arg_max(latency_ms, seq) AS b FROM u GROUP BY ALL)
SELECT plan_id, coalesce(a, intent) AS intent, coalesce(b, latency_ms) AS latency_ms FROM i LEFT JOIN l USING (plan_id)""")
def plan_log_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even events as plans, odd ones as late results of the plan of their ten."""
    rows = plans(spark, sf_dir)
    inserts = rows.where("plan_id % 2 = 0").select("plan_id", "intent", "latency_ms")
    seq = F.col("plan_id")
    updates = rows.where("plan_id % 2 = 1").select((seq - seq % 10).alias("plan_id"), seq.alias("seq"), F.when(seq % 3 != 0, F.col("intent")).alias("intent"), F.when(seq % 5 != 1, F.col("latency_ms")).alias("latency_ms"))
    return log.merged_plans(inserts, updates)


@query("SELECT event_id AS plan_id, ts AS created_at FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY")
def plan_log_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-31").cast("timestamp_ntz")
    return log.pruned(plans(spark, sf_dir), now, 14).select("plan_id", "created_at")


@query("SELECT event_id AS plan_id FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'")
def replay_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.filtered(plans(spark, sf_dir), "intent=click,created_after=2024-01-10,created_before=2024-01-20").select("plan_id")


@query("SELECT user_id, ts, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def feedback_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", ["ts", "event_id"])


@query("SELECT event_id AS feedback_id, event_type AS query FROM events WHERE event_type <> 'view' AND event_id NOT IN (SELECT doc_id FROM labels)")
def feedback_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("feedback_id"), F.col("event_type").alias("query"), F.when(F.col("event_type") != "view", F.col("props")).alias("matcher"))
    return log.promotable(rows, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("feedback_id"))).select("feedback_id", "query")


@query("SELECT event_id AS plan_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = log.decoded(plans(spark, sf_dir), "props", "k long")
    return good.select("plan_id", F.col("decoded.k").alias("k"))


@query("""SELECT event_id AS query_id, event_type AS intent, user_id % 5 <> 0 AND event_type <> 'error' AS rerank, user_id % 5 <> 0 AS persist, CAST(CASE event_type WHEN 'click' THEN 2000 WHEN 'view' THEN 500 ELSE 500 END AS INT) AS deadline_ms FROM events""")
def build_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("query_id"), F.when(F.col("event_type") == "error", "OUT_OF_SCOPE").otherwise(F.col("event_type")).alias("intent"), (F.col("user_id") % 5 == 0).alias("private"), F.col("event_type").alias("tier"))
    planned = log.plan(rows, {"click": 2000, "view": 500})
    return planned.withColumn("intent", F.when(F.col("intent") == "OUT_OF_SCOPE", "error").otherwise(F.col("intent")))


@query("SELECT user_id AS plan_id, CASE WHEN bool_and(event_type <> 'error' OR value < 50) THEN 'match' ELSE 'mismatch' END AS verdict FROM events GROUP BY ALL")
def replay_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tool = F.when((F.col("event_type") == "error") & (F.col("value") >= 50), "").otherwise(F.col("event_type"))
    steps = table(spark, sf_dir, "events").select(F.col("user_id").alias("plan_id"), tool.alias("tool"), F.lit(None).cast("string").alias("grade"), F.lit("rule").alias("source"), F.col("props").alias("args"))
    return log.replay_verdicts(steps)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windowed(table(spark, sf_dir, "events"))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions(table(spark, sf_dir, "events"))
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
