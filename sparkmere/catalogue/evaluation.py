from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmere.catalogue import query
from sparkmere.catalogue.vectors import EDGES, asked
from sparkmere.operators import evaluate, rerank, search
from sparkmere.sources.tables import nodes, table

RANKED = f"""{EDGES},
rk AS (SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, s.node_id, s.label = q.label AS matched, round(sim, 6) AS score FROM sims s JOIN n q ON q.node_id = s.query_id WHERE s.node_id <> s.query_id
  WINDOW w AS (PARTITION BY query_id ORDER BY round(sim, 6) DESC, s.node_id) QUALIFY row_number() OVER w <= 10),
ex AS (SELECT q.node_id AS query_id, q.label AS suite, (SELECT count(*) FROM n m WHERE m.label = q.label AND m.node_id <> q.node_id) AS n FROM n q WHERE q.node_id % 20 = 0),
tp AS (SELECT query_id, sum(matched::INT) AS found, min(CASE WHEN matched THEN rank END) AS first FROM rk GROUP BY ALL),
m AS (SELECT query_id, suite, round(coalesce(found, 0) / 10::DOUBLE, 6) AS precision, CASE WHEN n > 0 THEN round(coalesce(found, 0) / n::DOUBLE, 6) ELSE 0 END AS recall,
  round(coalesce(1 / first::DOUBLE, 0), 6) AS mrr, (coalesce(found, 0) > 0)::INT::DOUBLE AS hit, first AS first_rank FROM ex LEFT JOIN tp USING (query_id)),
s AS (SELECT suite, count(*) AS cases, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(hit), 6) AS hit FROM m GROUP BY ALL)
"""


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest other nodes of each query; those of the same label are relevant."""
    own = nodes(spark, sf_dir)
    sims = search.similarities(asked(spark, sf_dir), own, 11).where("node_id != query_id").withColumn("score", F.round("sim", 6))
    top = search.top_k(sims, "score", 10)
    labels = own.select("node_id", "label")
    return top.join(labels, "node_id").join(labels.select(F.col("node_id").alias("query_id"), F.col("label").alias("suite")), "query_id").withColumn("matched", F.col("label") == F.col("suite"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = nodes(spark, sf_dir)
    sizes = own.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n"))
    expected = own.where("node_id % 20 = 0").join(sizes, "label").select(F.col("node_id").alias("query_id"), F.col("label").alias("suite"), "n")
    found = evaluate.ranking_metrics(ranked(spark, sf_dir), expected, 10)
    return found.join(expected.select("query_id", "suite"), "query_id")


@query(f"WITH {RANKED} SELECT query_id, suite, precision, recall, mrr, hit, first_rank FROM m")
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir)


@query(f"WITH {RANKED} SELECT * FROM s")
def suite_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.macro_average(metrics(spark, sf_dir))


@query(f"WITH {RANKED} SELECT suite, concat_ws(',', CASE WHEN precision < 0.2 THEN 'precision' END, CASE WHEN mrr < 0.4 THEN 'mrr' END) AS failures, precision >= 0.2 AND mrr >= 0.4 AS passed FROM s")
def threshold_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.gated(evaluate.macro_average(metrics(spark, sf_dir)), {"precision": 0.2, "mrr": 0.4}).select("suite", "failures", "passed")


@query(f"WITH {RANKED}, a AS (SELECT suite, avg(mrr) AS mrr, avg(hit) AS hit FROM m WHERE query_id % 40 = 0 GROUP BY ALL), b AS (SELECT suite, avg(mrr) AS mrr, avg(hit) AS hit FROM m WHERE query_id % 40 <> 0 GROUP BY ALL) SELECT suite, round(round(a.mrr, 6) - round(b.mrr, 6), 6) AS delta_mrr, round(round(a.hit, 6) - round(b.hit, 6), 6) AS delta_hit FROM a FULL JOIN b USING (suite)")
def baseline_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the queries as the run, the others as its baseline."""
    own = metrics(spark, sf_dir)
    a, b = (evaluate.macro_average(own.where(c)) for c in ("query_id % 40 = 0", "query_id % 40 != 0"))
    return evaluate.compared(a, b, "suite", ["mrr", "hit"])


@query(f"WITH {RANKED} SELECT query_id, CASE WHEN hit < 0.5 THEN 'investigate' WHEN precision - 0.5 <= -0.25 THEN 'reauthor' WHEN precision - 0.5 <= -0.1 OR mrr < 0.5 THEN 'monitor' ELSE 'ok' END AS verdict FROM m")
def suite_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = evaluate.divergence(F.col("hit"), F.col("mrr"), F.col("precision") - 0.5)
    return metrics(spark, sf_dir).select("query_id", verdict.alias("verdict"))


@query(f"WITH {RANKED} SELECT query_id, first_rank FROM m WHERE hit > 0 AND recall > 0 AND mrr < 1 AND first_rank > 1")
def first_match_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.pressure(metrics(spark, sf_dir)).select("query_id", "first_rank")


@query(f"WITH {RANKED}, v AS (SELECT query_id, CASE WHEN hit < 1 OR recall <= 0 THEN 3 WHEN recall < 1 OR mrr < 0.5 THEN 2 WHEN first_rank IS NULL THEN 1 ELSE 0 END AS severity FROM m) SELECT query_id, severity, CASE WHEN severity = 3 THEN 'urgent' WHEN severity > 0 THEN 'review' ELSE 'ok' END AS status FROM v")
def report_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.severity(metrics(spark, sf_dir))


SECOND = "r2 AS (SELECT query_id, node_id, rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score + CASE WHEN node_id % 3 = 0 THEN 0.05 ELSE 0 END DESC, rank) AS INT) AS new_rank FROM rk WHERE node_id % 5 <> 0)"


def second(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = ranked(spark, sf_dir)
    boost = F.when(F.col("node_id") % 3 == 0, 0.05).otherwise(0.0)
    scores = own.where("node_id % 5 != 0").select("query_id", "node_id", (F.col("score") + boost).alias("new_score"))
    return rerank.reordered(own.select("query_id", "node_id", "rank"), scores)


@query(f"WITH {RANKED}, {SECOND} SELECT query_id, node_id, rank, new_rank FROM r2")
def rerank_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return second(spark, sf_dir).select("query_id", "node_id", "rank", "new_rank")


@query(f"""WITH {RANKED}, {SECOND}, o AS (SELECT query_id, list(node_id) AS a, max(CASE WHEN rank = 1 THEN node_id END) AS t FROM rk WHERE rank <= 5 GROUP BY ALL),
w AS (SELECT query_id, list(node_id) AS b, max(CASE WHEN new_rank = 1 THEN node_id END) AS u FROM r2 WHERE new_rank <= 5 GROUP BY ALL)
SELECT query_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) AS jaccard, t = u AS same_top FROM o JOIN w USING (query_id)""")
def replay_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = second(spark, sf_dir).select("query_id", "node_id", F.col("new_rank").alias("rank")).where("rank <= 5")
    return evaluate.replay_overlap(ranked(spark, sf_dir).where("rank <= 5"), new)


@query(f"WITH {RANKED} SELECT query_id, rank, round(1 / rank::DOUBLE, 6) AS score FROM rk")
def noop_rank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir).select("query_id", "rank", F.round(1 / F.col("rank"), 6).alias("score"))


@query(f"""WITH {RANKED}, b AS (SELECT query_id, max(CASE WHEN rank = 1 THEN score END) AS a, max(CASE WHEN rank = 2 THEN score END) AS b FROM rk WHERE score >= 0.3 GROUP BY ALL)
SELECT q.node_id AS query_id, CASE WHEN q.label = 0 THEN 'no_signal' WHEN a IS NULL THEN 'low' WHEN a >= 0.6 AND a - coalesce(b, 0) >= 0.05 THEN 'high' WHEN a <= 0.2 THEN 'low' ELSE 'inconclusive' END AS grade
FROM n q LEFT JOIN b ON query_id = q.node_id WHERE q.node_id % 20 = 0""")
def crag_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs over the neighbours of a similarity of 0.3 at least; queries of label 0 went to no reranker."""
    runs = nodes(spark, sf_dir).where("node_id % 20 = 0").select(F.col("node_id").alias("query_id"), F.lit("miss").alias("cache_status"), F.when(F.col("label") == 0, "noop").otherwise("vendor").alias("vendor"))
    return rerank.graded(ranked(spark, sf_dir).where("score >= 0.3"), runs)


M2 = """e2 AS (SELECT r2.query_id, new_rank AS rank, matched FROM r2 JOIN rk USING (query_id, node_id)), t2 AS (SELECT query_id, sum(matched::INT) AS found, min(CASE WHEN matched THEN rank END) AS first FROM e2 GROUP BY ALL),
m2 AS (SELECT query_id, CASE WHEN n > 0 THEN round(coalesce(found, 0) / n::DOUBLE, 6) ELSE 0 END AS recall, round(coalesce(1 / first::DOUBLE, 0), 6) AS mrr, (coalesce(found, 0) > 0)::INT::DOUBLE AS hit, first AS first_rank FROM ex LEFT JOIN t2 USING (query_id)),
a1 AS (SELECT unnest(['hit', 'recall', 'mrr']) AS k, unnest([round(avg(hit), 6), round(avg(recall), 6), round(avg(mrr), 6)]) AS v FROM m), a2 AS (SELECT unnest(['hit', 'recall', 'mrr']) AS k, unnest([round(avg(hit), 6), round(avg(recall), 6), round(avg(mrr), 6)]) AS v FROM m2),
p1 AS (SELECT query_id, first_rank::DOUBLE AS r FROM m WHERE hit > 0 AND recall > 0 AND mrr < 1 AND first_rank > 1), p2 AS (SELECT query_id, first_rank::DOUBLE AS r FROM m2 WHERE hit > 0 AND recall > 0 AND mrr < 1 AND first_rank > 1)"""


@query(f"""WITH {RANKED}, {SECOND}, {M2}
SELECT k || '_not_decreased' AS name, a2.v + 1e-9 >= a1.v AS passed, a1.v AS baseline, a2.v AS candidate FROM a1 JOIN a2 USING (k)
UNION ALL SELECT 'ranking_pressure_count', (SELECT count(*) FROM p2) <= (SELECT count(*) FROM p1), (SELECT count(*) FROM p1), (SELECT count(*) FROM p2)
UNION ALL SELECT 'case_first_matched_rank:' || query_id, p2.r <= p1.r, p1.r, p2.r FROM p1 JOIN p2 USING (query_id)
UNION ALL SELECT 'new_pressure_case:' || query_id, false, NULL, p2.r FROM p2 ANTI JOIN p1 USING (query_id)""")
def ranking_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reranked results against the first ones."""
    own = nodes(spark, sf_dir)
    sizes = own.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n"))
    expected = own.where("node_id % 20 = 0").join(sizes, "label").select(F.col("node_id").alias("query_id"), "n")
    matched = ranked(spark, sf_dir).select("query_id", "node_id", "matched")
    again = second(spark, sf_dir).select("query_id", "node_id", F.col("new_rank").alias("rank")).join(matched, ["query_id", "node_id"])
    return evaluate.ranking_gate(metrics(spark, sf_dir), evaluate.ranking_metrics(again, expected, 10))


@query(f"WITH {RANKED}, {SECOND}, f AS (SELECT query_id, min(rank) AS old, min(new_rank) AS new FROM r2 WHERE node_id % 2 = 0 GROUP BY ALL) SELECT query_id, old AS old_first, new AS new_first, new > old AS regressed FROM f")
def rank_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = second(spark, sf_dir).where("node_id % 2 = 0").groupBy("query_id").agg(F.min("rank").alias("old_first"), F.min("new_rank").alias("new_first"))
    return first.withColumn("regressed", F.col("new_first") > F.col("old_first"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), "event_id", F.col("value").alias("score"))


def _calibration_sql(value: str) -> str:
    return f"""WITH e AS (SELECT user_id, event_id, value, min(value) OVER u AS lo, max(value) OVER u AS hi, avg(value) OVER u AS m, stddev_pop(value) OVER u AS sd, count(*) OVER u AS n FROM events WINDOW u AS (PARTITION BY user_id))
SELECT event_id, round(CASE WHEN n = 1 OR hi = lo THEN 0.5 ELSE {value} END, 5)::DOUBLE AS calibrated FROM e"""


def _calibration(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return rerank.calibrated(_scores(spark, sf_dir), kind).select("event_id", F.round("calibrated", 5).alias("calibrated"))


@query(_calibration_sql("(value - lo) / (hi - lo)"))
def calibrate_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibration(spark, sf_dir, "minmax")


@query(_calibration_sql("(value - m) / sd"))
def calibrate_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibration(spark, sf_dir, "zscore")


@query(_calibration_sql("1 / (1 + exp(-value))"))
def calibrate_sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibration(spark, sf_dir, "sigmoid")


@query("SELECT event_id, round(value, 5) AS calibrated FROM events")
def calibrate_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibration(spark, sf_dir, "identity")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", "ts")


@query("SELECT user_id AS key, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS cell, count(*) AS n FROM events GROUP BY ALL")
def fixed_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.window_counts(calls(spark, sf_dir), 3600)


@query("""WITH c AS (SELECT user_id AS key, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS cell, count(*) AS n FROM events GROUP BY ALL),
b AS (SELECT *, CASE WHEN lag(cell) OVER k = cell - 1 THEN lag(n) OVER k ELSE 0 END AS before FROM c WINDOW k AS (PARTITION BY key ORDER BY cell))
SELECT key, cell, n, before, 0.5 * before + n >= 2 AS over FROM b""".replace("AS over FROM", "AS \"over\" FROM"))
def rate_limit_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.limit_estimates(calls(spark, sf_dir), 3600, 2)


@query()
def rate_limit_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.limited(calls(spark, sf_dir), 3600, 2)


@query("SELECT event_type, count(*) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY ALL")
def replay_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.latency(table(spark, sf_dir, "events"), "event_type", "value")


@query("""WITH a AS (SELECT conv_id AS query_id, 'see [cit_' || lpad((turn % 4 + 1)::VARCHAR, 3, '0') || '] and [cit_' || lpad((conv_id % 3 + 1)::VARCHAR, 3, '0') || ']' AS answer, turn FROM conversations),
c AS (SELECT query_id, turn, list_distinct(regexp_extract_all(answer, '\\[(cit_[0-9]+)\\]', 1)) AS cited FROM a)
SELECT query_id, CAST(len(cited) AS INT) AS cited, len(cited) > 0 AND len(list_filter(cited, lambda x: NOT list_contains(['cit_001', 'cit_002'], x))) = 0 AS supported FROM c""")
def answer_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    def cit(n):
        return F.concat(F.lit("[cit_"), F.lpad(n.cast("string"), 3, "0"), F.lit("]"))

    answer = F.concat(F.lit("see "), cit(F.col("turn") % 4 + 1), F.lit(" and "), cit(F.col("conv_id") % 3 + 1))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), answer.alias("answer"), F.array(F.lit("cit_001"), F.lit("cit_002")).alias("contexts"))
    return evaluate.citation_quality(rows)


@query("""WITH r AS (SELECT user_id, event_type AS vendor, CASE WHEN value >= 100 THEN 'miss' WHEN value >= 20 THEN 'hit' ELSE '' END AS cache, CASE WHEN event_type = 'error' THEN ['reranker_fallback:error', 'slow'] WHEN value < 10 THEN ['slow'] ELSE [] END AS w, value, (event_id % 3)::DOUBLE AS t FROM events),
s AS (SELECT user_id, count(*)::DOUBLE AS plans, count_if(vendor = 'error')::DOUBLE AS fallbacks, round(count_if(vendor = 'error') / count(*)::DOUBLE, 6) AS fallback_rate, round(count_if(cache = 'hit') / count(*)::DOUBLE, 6) AS cache_hit_rate,
  round(quantile_cont(value, 0.5) + 1e-9, 3) AS latency_p50, round(quantile_cont(value, 0.95) + 1e-9, 3) AS latency_p95, sum(t) AS truncated FROM r GROUP BY ALL)
SELECT user_id, 'vendor' AS kind, vendor AS name, count(*)::DOUBLE AS value FROM r GROUP BY ALL UNION ALL SELECT user_id, 'cache', CASE WHEN cache = '' THEN 'unknown' ELSE cache END, count(*) FROM r GROUP BY ALL
UNION ALL SELECT user_id, 'warning', x, count(*) FROM (SELECT user_id, unnest(w) AS x FROM r) GROUP BY ALL UNION ALL SELECT user_id, 'summary', name, value FROM (UNPIVOT s ON COLUMNS(* EXCLUDE user_id) INTO NAME name VALUE value)""")
def rerank_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reranked runs: their type the vendor, their value the latency and, in bands, the state of the cache."""
    kind, value = F.col("event_type"), F.col("value")
    warnings = F.when(kind == "error", F.array(F.lit("reranker_fallback:error"), F.lit("slow"))).when(value < 10, F.array(F.lit("slow"))).otherwise(F.array().cast("array<string>"))
    runs = table(spark, sf_dir, "events").select("user_id", kind.alias("vendor"), F.when(value >= 100, "miss").when(value >= 20, "hit").otherwise("").alias("cache_status"), warnings.alias("warnings"), value.alias("latency_ms"), (F.col("event_id") % 3).alias("truncated"))
    return rerank.rerank_summary(runs, "user_id")
