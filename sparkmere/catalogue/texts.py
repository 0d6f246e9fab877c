from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmere.catalogue import query
from sparkmere.functions import text as fn
from sparkmere.operators import lexical, routing
from sparkmere.sources.tables import table

RE = "'[a-z0-9]+(?:[-_][a-z0-9]+)*'"
SINGULAR = """CASE WHEN length(t) > 4 AND t LIKE '%ies' THEN left(t, length(t) - 3) || 'y' WHEN length(t) > 5 AND t LIKE '%sses' THEN left(t, length(t) - 2)
  WHEN length(t) > 4 AND regexp_matches(t, '(ches|shes|xes|zes)$') THEN left(t, length(t) - 2)
  WHEN length(t) > 3 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN left(t, length(t) - 1) ELSE t END"""
KIND = """CASE WHEN regexp_matches(t, '^[0-9]+$') THEN NULL
  WHEN length(regexp_replace(t, '[-_]', '', 'g')) >= 4 AND regexp_matches(t, '[a-z]') AND regexp_matches(t, '[0-9]') THEN 'model'
  WHEN regexp_matches(t, '^[a-z]{1,4}[- ]?[0-9]{1,5}[a-z0-9]*$') OR regexp_matches(regexp_replace(t, '[-_]', '', 'g'), '^[a-z]{1,4}[- ]?[0-9]{1,5}[a-z0-9]*$') THEN 'exact_code'
  WHEN length(t) >= 2 AND t NOT IN ('a','an','and','for','if','in','is','of','on','or','the','to','with') THEN 'ordinary' END"""
TERMS = rf"""
qt AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), {RE}))) AS t FROM benchmark),
qn AS (SELECT query_id, t, {KIND} AS kind FROM qt),
qs AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '\b[a-z]{{1,4}}\s+[0-9]{{1,5}}[a-z0-9]*\b')) AS t FROM benchmark),
qr AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[㐀-鿿]{{2,}}')) AS t FROM benchmark),
qg AS (SELECT query_id, t FROM qr UNION ALL SELECT query_id, substr(t, i, 2) FROM qr, generate_series(1, 400) g(i) WHERE i < length(t)
  UNION ALL SELECT query_id, substr(t, i, 3) FROM qr, generate_series(1, 400) g(i) WHERE i + 1 < length(t)),
qk AS (SELECT query_id, t AS term, kind FROM qn WHERE kind IS NOT NULL UNION SELECT query_id, regexp_replace(t, '[-_]', '', 'g'), kind FROM qn WHERE kind IN ('exact_code', 'model')
  UNION SELECT query_id, t, 'exact_code' FROM qs UNION SELECT query_id, regexp_replace(t, '\s+', '', 'g'), 'exact_code' FROM qs
  UNION SELECT query_id, t, 'cjk' FROM qg WHERE t NOT IN ({", ".join(f"'{t}'" for t in fn.CJK_STOP_TERMS)})),
docs AS (SELECT doc_id AS node_id, split_part(text, chr(10), 1) AS heading, text AS body, source || ' ' || lang AS identity FROM documents)
"""
FIELD_COLUMNS = {"heading": "heading", "body": "body", "identity": "identity"}


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("node_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("heading"), F.col("text").alias("body"), F.concat("source", F.lit(" "), "lang").alias("identity"), "text", "source")


@query(f"WITH {TERMS} SELECT query_id, term, kind FROM qk")
def lexical_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.query_terms(queries(spark, sf_dir))


FIELDS = f"""
ft AS (SELECT node_id, field, lower(x) AS x FROM (UNPIVOT docs ON heading, body, identity INTO NAME field VALUE x)),
fw AS (SELECT DISTINCT node_id, field, {SINGULAR} AS one FROM (SELECT node_id, field, unnest(list_distinct(regexp_extract_all(x, {RE}))) AS t FROM ft WHERE field <> 'identity')),
tt AS (SELECT DISTINCT term, term AS t, kind FROM qk WHERE kind IN ('ordinary', 'cjk')),
th AS (SELECT node_id, field, term FROM ft, tt WHERE field <> 'identity' AND contains(x, term)
  UNION SELECT node_id, field, term FROM fw JOIN (SELECT term, {SINGULAR} AS one FROM tt WHERE kind = 'ordinary') USING (one)),
qc AS (SELECT DISTINCT query_id, kind, regexp_replace(term, '[^a-z0-9㐀-鿿]+', '', 'g') AS term FROM qk WHERE kind IN ('exact_code', 'model')),
tc AS (SELECT node_id, field, term FROM (SELECT node_id, field, regexp_replace(x, '[^a-z0-9㐀-鿿]+', '', 'g') AS x FROM ft WHERE field <> 'body'), (SELECT DISTINCT term FROM qc) WHERE contains(x, term)),
hits AS (SELECT query_id, node_id, field, count(*) FILTER (kind = 'exact_code') AS codes, count(*) FILTER (kind = 'model') AS models, count(*) FILTER (kind = 'term') AS n
  FROM (SELECT DISTINCT query_id, node_id, field, 'term' AS kind, term FROM th JOIN (SELECT query_id, term FROM qk WHERE kind IN ('ordinary', 'cjk')) USING (term)
    UNION ALL SELECT query_id, node_id, field, kind, term FROM tc JOIN qc USING (term)) GROUP BY ALL),
fs AS (SELECT *, CASE field WHEN 'heading' THEN 1.0 WHEN 'body' THEN 0.9 ELSE 0.85 END::DOUBLE * (CASE WHEN codes > 0 THEN 0.15 ELSE 0 END + CASE WHEN models > 0 THEN 0.12 ELSE 0 END
  + 0.2 * least(n, 4))::DOUBLE AS score FROM hits),
sc AS (SELECT query_id, node_id, round(least(1.6, sum(score)), 6) AS score FROM fs GROUP BY ALL HAVING sum(score) > 0)
"""


@query(f"WITH {TERMS}, {FIELDS} SELECT query_id, node_id, field, codes, models, n AS hits FROM hits")
def lexical_term_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.lexical_hits(queries(spark, sf_dir), chunks(spark, sf_dir), FIELD_COLUMNS)


@query(f"WITH {TERMS}, {FIELDS} SELECT query_id, node_id, score, CAST(row_number() OVER w AS INT) AS rank FROM sc WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, node_id) QUALIFY row_number() OVER w <= 32")
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.lexical_topk(queries(spark, sf_dir), chunks(spark, sf_dir), FIELD_COLUMNS)


@query(f"WITH {TERMS} SELECT query_id, term, kind FROM qk WHERE kind IN ('exact_code', 'model') UNION ALL SELECT query_id, term, kind FROM qk WHERE kind NOT IN ('exact_code', 'model')")
def lexical_full_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.query_terms(queries(spark, sf_dir))


@query()
def lexical_full_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stand for public web pages, whose bodies have compact windows."""
    nodes = chunks(spark, sf_dir).withColumn("web", F.lit(True))
    return lexical.full_lexical_topk(queries(spark, sf_dir), nodes, FIELD_COLUMNS)


@query(f"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), {RE})) AS t FROM documents) SELECT t AS word, {SINGULAR} AS singular FROM w")
def plural_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(fn.tokens(F.col("text")))).alias("word")).distinct()
    return words.select("word", fn.singular(F.col("word")).alias("singular"))


COVER = f"""
cq AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), {RE})) AS a FROM benchmark),
ct AS (SELECT query_id, len(a) AS n, unnest(a) AS t FROM cq),
dt AS (SELECT doc_id AS node_id, unnest(list_distinct(regexp_extract_all(lower(text), {RE}))) AS t FROM documents),
cov AS (SELECT query_id, node_id, count(*) / any_value(n)::DOUBLE AS coverage FROM ct JOIN dt USING (t) GROUP BY ALL)
"""


@query(f"WITH {COVER} SELECT query_id, node_id, round(coverage, 6) AS coverage FROM cov")
def query_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.query_coverage(queries(spark, sf_dir), chunks(spark, sf_dir)).withColumn("coverage", F.round("coverage", 6))


@query(f"WITH {COVER} SELECT query_id, node_id, CAST(row_number() OVER w AS INT) AS rank, round(coverage, 6) AS coverage FROM cov WINDOW w AS (PARTITION BY query_id ORDER BY round(coverage, 6) DESC, node_id) QUALIFY row_number() OVER w <= 5")
def coverage_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.covered_topk(queries(spark, sf_dir), chunks(spark, sf_dir), 5)
    return found.select("query_id", "node_id", "rank", F.round("coverage", 6).alias("coverage"))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS text_hash, left(sha256(source || '|' || lang || '|' || split_part(text, chr(10), 1) || '|' || left(text, 80)), 12) AS anchor_key, 'sha256:' || sha256(trim(text, ' ')) AS query_hash FROM documents")
def identity_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.split_part("text", F.lit("\n"), F.lit(1))
    key = fn.anchor_key(F.array("source", "lang"), head, F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", fn.text_hash(F.col("text")).alias("text_hash"), key.alias("anchor_key"), fn.query_hash(F.col("text")).alias("query_hash"))


@query("""WITH h AS (SELECT doc_id, sha256('chunk:' || doc_id || chr(0) || 'hash' || chr(0) || '1') AS d FROM documents)
SELECT doc_id, concat_ws('-', d[1:8], d[9:12], d[13:16], d[17:20], d[21:32]) AS point_id FROM h""")
def vector_point_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunk = F.concat(F.lit("chunk:"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", fn.vector_point_id(chunk, F.lit("hash"), F.lit("1")).alias("point_id"))


@query("SELECT text_hash, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, 'sha256:' || sha256(text) AS text_hash FROM documents) GROUP BY ALL")
def identity_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "documents").select("doc_id", fn.text_hash(F.col("text")).alias("text_hash"))
    return hashed.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


PII = {"email": r"[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+", "phone": r"[+]?[0-9][0-9 ()-]{7,}[0-9]"}


@query(f"SELECT doc_id, regexp_replace(regexp_replace(text, '{PII['email']}', '[email]', 'g'), '{PII['phone']}', '[phone]', 'g') AS text FROM documents")
def pii_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fn.masked_pii(F.col("text"), PII).alias("text"))


@query("""WITH t AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_type || ' ' || p_brand)), '[\\s_]+', '-', 'g'), '[^a-z0-9:-]+', '-', 'g') AS x FROM part)
SELECT p_partkey AS tag, regexp_replace(regexp_replace(x, '-+', '-', 'g'), '^-|-$', '', 'g') AS name FROM t""")
def normalized_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tag"), fn.normalized_tag(F.concat("p_type", F.lit(" "), "p_brand")).alias("name"))


@query("SELECT doc_id, CAST(greatest(1, (length(text) + 3) // 4) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fn.token_estimate(F.col("text")).alias("tokens"))


@query("""WITH p AS (SELECT doc_id, unnest(range(0, length(text), 500)) AS a, text FROM documents),
s AS (SELECT doc_id, a, trim(substr(text, a + 1, 500), ' ') AS piece FROM p)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS INT) AS part, piece FROM s WHERE piece <> ''""")
def hard_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(fn.hard_split(F.col("text"), 500)).alias("part", "piece"))


@query("SELECT source, count(*) AS chunks, min(length(text)) AS least, median(length(text)) AS median, max(length(text)) AS most FROM documents GROUP BY ALL")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length("text").cast("long")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.min(size).alias("least"), F.median(size).alias("median"), F.max(size).alias("most"))


def _any(words: tuple[str, ...], column: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


@query(f"SELECT conv_id, turn, CASE WHEN {_any(routing.OUT_OF_SCOPE, 'lower(text)')} THEN 'OUT_OF_SCOPE' ELSE 'TEXT_ANSWER' END AS intent FROM conversations")
def intent_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", routing.intent(F.col("text")).alias("intent"))


@query(rf"""WITH m AS (SELECT conv_id, turn, lower(text) AS low, trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) AS x FROM conversations),
r AS (SELECT *, CASE WHEN x = '' OR x IN ({", ".join(f"'{g}'" for g in routing.GREETINGS)}) OR {_any(routing.OUT_OF_SCOPE, 'low')} THEN 'no_retrieval'
  WHEN {_any(routing.COMPARISONS, 'x')} OR {_any(routing.STEPS, 'x')} OR len(list_distinct(regexp_extract_all(x, '{routing.MODEL}'))) >= 2 THEN 'multi_hop' ELSE 'single_shot' END AS route FROM m)
SELECT conv_id, turn, route, CASE route WHEN 'no_retrieval' THEN 0.95 WHEN 'multi_hop' THEN 0.75 ELSE 0.6 END::DOUBLE AS confidence FROM r""")
def route_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("route", routing.route(F.col("text")))
    return rows.select("conv_id", "turn", "route", routing.route_confidence(F.col("route")).alias("confidence"))


@query(f"SELECT item_id, {_any(routing.VISUAL, 'lower(text)')} OR {_any(routing.VISUAL_CJK, 'text')} AS visual FROM benchmark")
def visual_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", routing.visual(F.col("text")).alias("visual"))


@query(f"""SELECT doc_id, CASE WHEN {_any(routing.OUT_OF_SCOPE, 'lower(text)')} THEN 'OUT_OF_SCOPE' ELSE 'TEXT_ANSWER' END AS intent,
  {_any(routing.VISUAL, 'lower(text)')} OR {_any(routing.VISUAL_CJK, 'text')} AS visual FROM documents""")
def document_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent and visual wish of every document as if it were a question."""
    return table(spark, sf_dir, "documents").select("doc_id", routing.intent(F.col("text")).alias("intent"), routing.visual(F.col("text")).alias("visual"))


@query(f"""WITH t AS (SELECT source AS kb, unnest(list_distinct(regexp_extract_all(lower(text), {RE}))) AS t FROM documents),
k AS (SELECT kb, t, count(*) AS n FROM t WHERE length(t) >= 2 GROUP BY ALL),
v AS (SELECT kb, t FROM k QUALIFY row_number() OVER (PARTITION BY kb ORDER BY n DESC, t) <= 80),
q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), {RE}))) AS t FROM benchmark),
s AS (SELECT query_id, kb, 2 * count(*) AS score FROM q JOIN v USING (t) GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, kb))
SELECT query_id, kb, CAST(score AS BIGINT) AS score, score >= 2 AND score >= coalesce(nxt, 0) + 1 AS accepted FROM r WHERE k = 1""")
def kb_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as knowledge bases, their 80 most frequent terms as values."""
    held = table(spark, sf_dir, "documents").select(F.col("source").alias("kb"), F.explode(F.array_distinct(fn.tokens(F.col("text")))).alias("term")).where("length(term) >= 2")
    counts = held.groupBy("kb", "term").agg(F.count(F.lit(1)).alias("n"))
    top = counts.withColumn("k", F.row_number().over(Window.partitionBy("kb").orderBy(F.desc("n"), "term"))).where("k <= 80").select("kb", "term")
    asked = queries(spark, sf_dir).select("query_id", F.explode(F.array_distinct(fn.tokens(F.col("text")))).alias("term"))
    scores = asked.join(top, "term").groupBy("query_id", "kb").agg((2 * F.count(F.lit(1))).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "kb")
    ranked = scores.withColumns({"k": F.row_number().over(order), "next": F.lead("score").over(order)}).where("k = 1")
    return ranked.select("query_id", "kb", "score", ((F.col("score") >= 2) & (F.col("score") >= F.coalesce("next", F.lit(0)) + 1)).alias("accepted"))
