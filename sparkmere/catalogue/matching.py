from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmere.catalogue import query
from sparkmere.operators import matching
from sparkmere.sources.tables import table

K = 3
#: Orders stand for cases and their lines for ranked results.
RESULTS = r"""
r AS (SELECT l_orderkey AS case_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey) AS INT) AS rank, l_extendedprice AS score,
  'd' || l_suppkey % 2 || '/' || l_partkey % 5 || '.md' AS source_file, l_partkey % 5 || '.md' AS name, ' ' || l_returnflag AS header, 'part' || chr(9) || chr(10) || l_partkey % 3 || ' of supplier ' || l_suppkey AS text,
  [l_linestatus, CASE WHEN l_discount > 0.05 THEN 'cheap' END] AS tags FROM lineitem),
f AS (SELECT case_id, name, count(DISTINCT source_file) AS files FROM r GROUP BY ALL),
x AS (SELECT o_orderkey AS case_id, unnest([1, 2, 3]) AS expectation, o_custkey AS c FROM orders),
j AS (SELECT r.case_id, rank, expectation, c, score, name, source_file, header, text, tags, files FROM r JOIN f USING (case_id, name) JOIN x USING (case_id)),
m AS (SELECT case_id, rank, expectation, CASE expectation WHEN 1 THEN (c % 5) || '.md' = name AND files = 1
    WHEN 2 THEN trim(header) = 'R' AND contains(regexp_replace(text, '\s+', ' ', 'g'), 'part ' || c % 3 || ' of') ELSE source_file = 'd1/' || c % 5 || '.md' AND list_contains(tags, 'cheap') END AS matched,
  expectation = 1 AND (c % 5) || '.md' = name AND files > 1 AS ambiguous FROM j),
ng AS (SELECT case_id, count(*) AS hits FROM r JOIN orders ON o_orderkey = case_id WHERE rank <= 3 AND trim(header) = 'A' AND o_orderstatus = 'F' GROUP BY ALL),
t AS (SELECT case_id, count(DISTINCT rank) AS relevant, count(DISTINCT expectation) AS met, min(rank) AS first_rank FROM m WHERE matched AND rank <= 3 GROUP BY ALL),
cm AS (SELECT o_orderkey AS case_id, o_orderpriority AS suite, round(coalesce(relevant, 0) / 3::DOUBLE, 6) AS precision, round(coalesce(met, 0) / 3::DOUBLE, 6) AS recall, round(coalesce(1 / first_rank::DOUBLE, 0), 6) AS mrr,
  CASE WHEN relevant > 0 THEN 1.0::DOUBLE ELSE 0 END AS hit, first_rank, coalesce(hits, 0) AS negatives FROM orders o LEFT JOIN t ON t.case_id = o_orderkey LEFT JOIN ng ON ng.case_id = o_orderkey),
cf AS (SELECT *, concat_ws(',', CASE WHEN recall < 0.3 THEN 'recall' END, CASE WHEN mrr < 0.5 THEN 'mrr' END, CASE WHEN negatives > 0 THEN 'negatives' END) AS failures FROM cm)
"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("l_extendedprice"), "l_partkey"))
    tags = F.array_compact(F.array("l_linestatus", F.when(F.col("l_discount") > 0.05, "cheap")))
    return table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "case_id").select(  # before the window, so that rows stay dealt by case_id
        "case_id", rank.alias("rank"), F.col("l_extendedprice").alias("score"),
        F.format_string("d%d/%d.md", F.col("l_suppkey") % 2, F.col("l_partkey") % 5).alias("source_file"), F.concat(F.lit(" "), "l_returnflag").alias("header"),
        F.lit(None).cast("string").alias("anchor_key"), F.format_string("part\t\n%d of supplier %d", F.col("l_partkey") % 3, F.col("l_suppkey")).alias("text"), F.create_map(F.lit("tags"), tags).alias("metadata"),
    )


def _expected(spark: SparkSession, sf_dir: str, rows) -> DataFrame:
    kind = "struct<expectation:int,source_file:string,header:string,anchor_key:string,needles:array<string>,wanted:map<string,array<string>>>"
    structs = F.array(*(F.struct(*(F.lit(v) if not hasattr(v, "alias") else v for v in r)).cast(kind) for r in rows))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), "o_orderstatus", F.explode(structs).alias("x")).select("case_id", "o_orderstatus", "x.*")


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.format_string("%d.md", F.col("o_custkey") % 5)
    needle = F.array(F.format_string("part %d  of", F.col("o_custkey") % 3))
    none = F.lit(None)
    return _expected(spark, sf_dir, [(1, name, none, none, none, none), (2, "", "R ", none, needle, none), (3, F.concat(F.lit("d1/"), name), none, none, none, F.create_map(F.lit("tags"), F.array(F.lit("cheap"))))])


def negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None)
    rows = _expected(spark, sf_dir, [(1, none, "A", none, none, none)]).where("o_orderstatus = 'F'")
    return matching.negative_hits(results(spark, sf_dir), rows, K)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("suite"), F.lit(3).alias("n"))


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.matches(results(spark, sf_dir), expected(spark, sf_dir))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.case_metrics(cases(spark, sf_dir), matched(spark, sf_dir), negatives(spark, sf_dir), K, {"recall": 0.3, "mrr": 0.5})


@query(f"WITH {RESULTS} SELECT case_id, rank, expectation, matched, ambiguous FROM m WHERE matched OR ambiguous")
def expectation_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(spark, sf_dir).where("matched OR ambiguous")


@query(f"WITH {RESULTS} SELECT case_id, hits FROM ng")
def negative_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives(spark, sf_dir)


@query(f"WITH {RESULTS} SELECT *, failures = '' AS passed FROM cf")
def eval_run_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)


@query(f"WITH {RESULTS} SELECT suite, count(*) AS cases, count_if(failures = '') AS passed, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(hit), 6) AS hit FROM cf GROUP BY ALL")
def eval_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.run_summary(run(spark, sf_dir))


@query(f"WITH {RESULTS}, s AS (SELECT DISTINCT case_id FROM m WHERE matched AND rank % 2 = 1) SELECT o_orderpriority AS suite, count(*) AS cases, round(avg((s.case_id IS NOT NULL)::INT), 6) AS selected_rate FROM orders LEFT JOIN s ON s.case_id = o_orderkey GROUP BY ALL")
def context_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.context_quality(cases(spark, sf_dir), matched(spark, sf_dir), results(spark, sf_dir).where("rank % 2 = 1"))


@query(f"""WITH {RESULTS}, tp AS (SELECT * FROM r WHERE rank <= 5), fc AS (SELECT case_id, source_file, count(*) AS n FROM tp GROUP BY ALL),
fb AS (SELECT case_id, n AS source_hits, source_file FROM fc QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY n DESC, source_file DESC) = 1),
hb AS (SELECT case_id, max(n) AS header_hits FROM (SELECT case_id, source_file, header, count(*) AS n FROM tp GROUP BY ALL) GROUP BY ALL),
nt AS (SELECT case_id, count(*) FILTER (best - score <= 1000) - 1 AS near_ties FROM (SELECT *, max(score) OVER (PARTITION BY case_id) AS best FROM tp) GROUP BY ALL)
SELECT case_id, source_file, source_hits, header_hits, near_ties, CASE WHEN header_hits >= 2 THEN 'same_header' WHEN source_hits >= 2 AND near_ties > 0 THEN 'same_page_near_tie' WHEN source_hits >= 2 THEN 'same_page' ELSE 'spread' END AS diagnosis
FROM fb JOIN hb USING (case_id) JOIN nt USING (case_id)""")
def same_page_diagnostic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.page_dominance(results(spark, sf_dir), 5, 1000.0)


@query("SELECT field, value, count(*) AS n FROM (SELECT 'brand' AS field, p_brand AS value FROM part UNION ALL SELECT 'category', p_type FROM part UNION ALL SELECT 'size', p_size::VARCHAR FROM part) GROUP BY ALL")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("p_size").alias("size"))
    return matching.facets(parts, ["brand", "category", "size"])


@query("""WITH s AS (SELECT o_custkey AS release, CASE WHEN o_totalprice < 50000 THEN 'failed' WHEN o_orderstatus = 'O' THEN 'needs_review' ELSE 'passed' END AS status FROM orders),
c AS (SELECT release, status, count(*) AS n, CASE status WHEN 'passed' THEN 1 WHEN 'needs_review' THEN 2 ELSE 3 END AS place FROM s GROUP BY ALL)
SELECT release, status, n FROM c QUALIFY row_number() OVER (PARTITION BY release ORDER BY place DESC) = 1""")
def release_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand for releases and their orders for checks."""
    status = F.when(F.col("o_totalprice") < 50000, "failed").when(F.col("o_orderstatus") == "O", "needs_review").otherwise("passed")
    checks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("release"), status.alias("status"))
    return matching.worst_status(checks, "release", ["passed", "needs_review", "failed"])
