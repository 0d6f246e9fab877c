from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmere.catalogue import query
from sparkmere.functions.text import normalized_tag
from sparkmere.operators import governance
from sparkmere.sources.tables import table

NAMES = """
names AS (SELECT p_partkey, lower(replace(p_name, ' ', '-')) AS tag FROM part),
kinds AS (SELECT DISTINCT tag FROM names),
canon AS (SELECT tag FROM kinds WHERE length(tag) % 3 = 0),
syn AS (SELECT k.tag, min(c.tag) AS target FROM kinds k JOIN canon c ON left(k.tag, 3) = left(c.tag, 3) WHERE length(k.tag) % 3 = 1 GROUP BY ALL),
dep AS (SELECT tag FROM kinds WHERE length(tag) % 6 = 5),
st AS (SELECT k.tag, CASE WHEN c.tag IS NOT NULL THEN 'canonical' WHEN s.target IS NOT NULL THEN 'synonym' WHEN d.tag IS NOT NULL THEN 'deprecated' ELSE 'unknown' END AS status,
  coalesce(c.tag, s.target) AS target FROM kinds k LEFT JOIN canon c USING (tag) LEFT JOIN syn s USING (tag) LEFT JOIN dep d USING (tag))
"""


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", normalized_tag(F.col("p_name")).alias("tag"), "p_brand")


def policy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """tags, canonical, synonyms, deprecated, by rules over the lengths of names."""
    tags = named(spark, sf_dir).select("tag").distinct()
    canonical = tags.where(F.length("tag") % 3 == 0)
    same = tags.where(F.length("tag") % 3 == 1).join(canonical.select(F.col("tag").alias("c")), F.substring("tag", 1, 3) == F.substring("c", 1, 3)).groupBy("tag").agg(F.min("c").alias("target"))
    return tags, canonical, same, tags.where(F.length("tag") % 6 == 5)


@query(f"WITH {NAMES} SELECT * FROM st")
def tag_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.resolved(*policy(spark, sf_dir))


@query("""WITH u AS (SELECT DISTINCT p_brand AS tag, l_orderkey AS manual, o_orderstatus <> 'F' AS active FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey)
SELECT tag, count(*) AS manuals, count_if(active) AS active, count_if(NOT active) AS inactive, array_to_string(list_sort(list(manual))[1:5], ',') AS examples FROM u GROUP BY tag""")
def tag_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return governance.usage(lines.select(F.col("p_brand").alias("tag"), F.col("l_orderkey").alias("manual"), (F.col("o_orderstatus") != "F").alias("active")))


NEAR = """
pa AS (SELECT tag, list_distinct(string_split(tag, '-')) AS p FROM kinds),
nr AS (SELECT k.tag, min(c.tag) AS canonical FROM pa k JOIN (SELECT tag, p FROM pa SEMI JOIN canon USING (tag)) c ON k.tag <> c.tag AND ((length(k.tag) >= 5 AND length(c.tag) >= 5 AND (starts_with(k.tag, c.tag) OR starts_with(c.tag, k.tag)))
  OR (length(k.tag) >= 5 AND levenshtein(k.tag, c.tag) <= 2) OR len(list_intersect(k.p, c.p)) / (len(k.p) + len(c.p) - len(list_intersect(k.p, c.p)))::DOUBLE >= 0.8) GROUP BY k.tag)"""


@query(f"""WITH {NAMES.strip()},{NEAR},
u AS (SELECT tag, count(DISTINCT p_partkey) FILTER (p_partkey % 2 = 0) AS manuals, count(DISTINCT p_partkey) FILTER (p_partkey % 3 <> 1) AS graph FROM names GROUP BY tag),
s AS (SELECT tag, status, coalesce(target, tag) AS canonical, manuals, graph FROM u JOIN st USING (tag) WHERE manuals > 0 OR graph > 0)
SELECT 'warning' AS severity, CASE status WHEN 'unknown' THEN 'UNKNOWN_TAG' WHEN 'synonym' THEN 'SYNONYM_IN_USE' ELSE 'DEPRECATED_TAG_IN_USE' END AS code, tag, canonical, manuals AS count FROM s WHERE status <> 'canonical' AND manuals > 0
UNION ALL SELECT 'warning', 'GRAPH_LIBRARY_TAG_DRIFT', tag, canonical, manuals FROM s WHERE manuals <> graph
UNION ALL SELECT 'info', 'LIKELY_DUPLICATE_TAG', tag, nr.canonical, manuals FROM s JOIN nr USING (tag) WHERE status = 'unknown' AND manuals > 0""")
def tag_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as manuals: even ones are the library's, those that aren't 1 modulo 3 the graph's."""
    own = named(spark, sf_dir).select(F.col("p_partkey").alias("manual"), "tag")
    tags, canonical, synonyms, deprecated = policy(spark, sf_dir)
    counts = governance.tag_counts(own.where("manual % 2 = 0"), own.where("manual % 3 <> 1"))
    return governance.drift(counts.join(governance.resolved(tags, canonical, synonyms, deprecated), "tag"), governance.near_canonical(tags, canonical))


@query(f"""WITH {NAMES} SELECT p_partkey AS manual, tag, CASE status WHEN 'unknown' THEN 'TAG_UNKNOWN' WHEN 'synonym' THEN 'TAG_SYNONYM_USED' ELSE 'TAG_DEPRECATED' END AS code,
CASE WHEN status = 'synonym' THEN 'warning' ELSE 'error' END AS severity, target AS canonical FROM names JOIN st USING (tag) WHERE status <> 'canonical'""")
def tag_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In strict mode."""
    uses = named(spark, sf_dir).select(F.col("p_partkey").alias("manual"), "tag")
    return governance.validation_messages(uses, governance.resolved(*policy(spark, sf_dir)), strict=True)


@query(f"WITH {NAMES.strip()},{NEAR} SELECT tag, canonical FROM nr")
def near_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags, canonical, _, _ = policy(spark, sf_dir)
    return governance.near_canonical(tags, canonical)


@query("""WITH t AS (SELECT p_partkey, ['brand:' || lower(p_brand), 'size:' || p_size, lower(p_type)] AS tags, list_filter([lower(p_type), 'size:' || (p_size % 10)], lambda x: true) AS src FROM part)
SELECT p_partkey AS manual, array_to_string(list_filter(tags, lambda x: NOT list_contains(src, x)) || ['merged'], ',') AS tags FROM t""")
def tag_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array(F.concat(F.lit("brand:"), F.lower("p_brand")), F.concat(F.lit("size:"), F.col("p_size").cast("string")), F.lower("p_type"))
    sources = F.array(F.lower("p_type"), F.concat(F.lit("size:"), (F.col("p_size") % 10).cast("string")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("manual"), F.array_join(governance.rewritten(tags, sources, F.lit("merged")), ",").alias("tags"))


USEFUL = """(x <> '' AND x NOT IN ('a', 'an', 'and', 'by', 'for', 'from', 'guide', 'manual', 'of', 'on', 'or', 'pdf', 'the', 'to', 'txt', 'use', 'user', 'with')
  AND (length(x) >= 3 OR (regexp_matches(x, '[a-z]') AND regexp_matches(x, '[0-9]'))) AND NOT regexp_matches(x, '^v?[0-9]+(-[0-9]+)*$'))"""


@query(f"""WITH f AS (SELECT doc_id, unnest(['title', 'source_file', 'text_sample']) AS s, unnest([split_part(text, chr(10), 1), source, text]) AS v FROM documents),
p AS (SELECT doc_id, s, list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce(v, ''), ' ')), '[\\s_]+', '-', 'g'), '[^a-z0-9:-]+', '-', 'g'), '-+', '-', 'g'), '-'), '-'), lambda x: x <> '') AS p FROM f),
w AS (SELECT *, list_filter(p, lambda x: {USEFUL} OR (regexp_matches(x, '[a-z]') AND regexp_matches(x, '[0-9]'))) AS w FROM p),
n AS (SELECT DISTINCT doc_id, s, unnest(list_filter(p, lambda x: {USEFUL})) AS tag FROM w
  UNION SELECT doc_id, s, a || '-' || b FROM (SELECT doc_id, s, unnest(w[1:len(w) - 1]) AS a, unnest(w[2:]) AS b FROM w) WHERE NOT (regexp_matches(a, '^v?[0-9]+$') AND regexp_matches(b, '^v?[0-9]+$'))),
e AS (SELECT tag, count(*) AS n FROM n WHERE s = 'title' AND doc_id % 2 = 0 AND contains(tag, '-') GROUP BY ALL),
d AS (SELECT doc_id, list_distinct(flatten(list(p))) AS d FROM p GROUP BY ALL),
t AS (SELECT tag, list_distinct(string_split(tag, '-')) AS q, unnest(list_distinct(string_split(tag, '-'))) AS one FROM e),
m AS (SELECT doc_id, tag FROM (SELECT doc_id, unnest(d) AS one FROM d) JOIN t USING (one) GROUP BY doc_id, tag, len(q) HAVING count(*) / len(q)::DOUBLE >= 0.67),
g AS (SELECT doc_id, tag, list_sort(list(DISTINCT s)) AS sources FROM (FROM n UNION ALL SELECT doc_id, 'existing_tags', tag FROM m) GROUP BY ALL),
c AS (SELECT doc_id, tag, sources, round(least(0.99, list_sum(list_transform(sources, lambda s: CASE s WHEN 'existing_tags' THEN 0.6::DOUBLE WHEN 'text_sample' THEN 0.1 ELSE 0.25 END)) + 0.05 * (len(sources) - 1)
  + CASE WHEN list_contains(sources, 'existing_tags') THEN least(0.12, 0.02 * n) ELSE 0 END)::DOUBLE + 1e-9, 3) AS score FROM g LEFT JOIN e USING (tag))
SELECT doc_id, tag, score, array_to_string(sources, ',') AS sources, CAST(row_number() OVER o AS INT) AS rank FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY score DESC, tag) QUALIFY row_number() OVER o <= 8""")
def tag_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as drafts; the phrases in the titles of even ones are the tags in use."""
    docs = table(spark, sf_dir, "documents").withColumn("title", F.split_part("text", F.lit("\n"), F.lit(1)))
    used = governance.named(docs.where("doc_id % 2 = 0"), {"title": "title"}).where(F.contains("tag", F.lit("-")))
    found = governance.suggestions(docs, {"title": "title", "source_file": "source", "text_sample": "text"}, used.groupBy("tag").agg(F.count(F.lit(1)).alias("n")))
    return found.withColumn("sources", F.array_join("sources", ","))


POLICY = """
sy AS (SELECT p_partkey AS tag, CASE WHEN p_partkey % 50 = 11 THEN p_partkey ELSE p_partkey // 2 END AS target FROM part WHERE p_partkey % 10 <> 0 AND p_partkey > 1),
ca AS (SELECT p_partkey AS tag FROM part WHERE p_partkey % 10 = 0 OR p_partkey % 77 = 3),
de AS (SELECT s_suppkey AS tag, s_suppkey + 5000000 * (s_suppkey % 3) AS replacement FROM supplier)"""


@query(f"""WITH RECURSIVE {POLICY.strip()},
w AS (SELECT tag, target, 1 AS n FROM sy UNION ALL SELECT w.tag, sy.target, n + 1 FROM w JOIN sy ON sy.tag = w.target WHERE n < 40),
e AS (SELECT tag, arg_max(target, n) AS target, max(n) AS n FROM w GROUP BY tag)
SELECT 'alias_is_canonical' AS code, tag FROM sy SEMI JOIN ca USING (tag) UNION ALL SELECT 'synonym_cycle', tag FROM e WHERE n >= 40 UNION ALL SELECT 'target_not_canonical', tag FROM e WHERE n < 40 AND target NOT IN (SELECT tag FROM ca)
UNION ALL SELECT 'deprecated_is_canonical', tag FROM de SEMI JOIN ca USING (tag) UNION ALL SELECT 'replacement_not_canonical', tag FROM de WHERE replacement NOT IN (SELECT tag FROM ca UNION ALL SELECT tag FROM sy)""")
def policy_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts stand for tags: chains of halves, some of them pointing at themselves."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tag"))
    target = F.when(F.col("tag") % 50 == 11, F.col("tag")).otherwise(F.floor(F.col("tag") / 2))
    synonyms = part.where("tag % 10 != 0 AND tag > 1").select("tag", target.alias("target"))
    deprecated = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tag"), (F.col("s_suppkey") + 5000000 * (F.col("s_suppkey") % 3)).alias("replacement"))
    return governance.policy_faults(synonyms, part.where("tag % 10 = 0 OR tag % 77 = 3"), deprecated)
