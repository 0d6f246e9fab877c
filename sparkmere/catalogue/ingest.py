from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmere.catalogue import query
from sparkmere.operators import graph
from sparkmere.sources import parsers
from sparkmere.sources.tables import table


@query("SELECT doc_id AS src, lead(doc_id) OVER (ORDER BY doc_id) AS dst, 0.15::DOUBLE AS weight FROM documents QUALIFY dst IS NOT NULL")
def consecutive_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges cross documents, so one order runs over all nodes; node ids only are sorted."""
    return graph.consecutive_edges(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id")))


@query("SELECT doc_id AS src, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS dst, 0.15::DOUBLE AS weight FROM documents QUALIFY dst IS NOT NULL")
def consecutive_edges_in_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.consecutive_edges(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), "source"), ["source"])


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands, (brand, type) and (brand, type, size) as a tree of paths, numbered by path."""
    part = table(spark, sf_dir, "part")
    levels = [F.array("p_brand"), F.array("p_brand", "p_type"), F.array("p_brand", "p_type", F.col("p_size").cast("string"))]
    every = part.select(F.explode(F.array(*levels)).alias("path")).distinct()
    return graph.numbered(every.withColumn("joined", F.array_join("path", "/")), "joined").drop("joined")


@query("""WITH p AS (SELECT DISTINCT unnest([p_brand, p_brand || '/' || p_type, p_brand || '/' || p_type || '/' || p_size]) AS path FROM part),
n AS (SELECT row_number() OVER (ORDER BY path) AS id, path, len(string_split(path, '/')) AS depth, CASE WHEN contains(path, '/') THEN left(path, length(path) - length(split_part(path, '/', -1)) - 1) ELSE '' END AS parent FROM p)
SELECT least(a.id, b.id) AS src, greatest(a.id, b.id) AS dst, 0.2::DOUBLE AS weight, 'parent_child' AS kind FROM n a JOIN n b ON b.parent = a.path
UNION ALL SELECT a.id, b.id, 0.1, 'sibling' FROM n a JOIN n b ON a.parent = b.parent AND a.depth = b.depth AND a.depth > 1 AND a.id < b.id""")
def structural_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.structural_edges(paths(spark, sf_dir))


MARKED = "CASE WHEN conv_id % 3 = 0 THEN '## turn ' || turn || chr(10) || text WHEN conv_id % 3 = 1 THEN '# ' || role || chr(10) || text ELSE text END"


@query(f"""WITH d AS (SELECT conv_id AS doc_id, string_agg({MARKED}, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY ALL),
l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT *, length(regexp_extract(line, '^(#{{1,6}})[ \\t]+(.+?)[ \\t]*$', 1)) AS level, regexp_extract(line, '^(#{{1,6}})[ \\t]+(.+?)[ \\t]*$', 2) AS header FROM l),
s AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS section FROM m)
SELECT doc_id, CAST(section AS INT) AS section, CAST(max(level) AS INT) AS level, max(header) AS header, CAST(min(k) AS INT) AS start_line, string_agg(line, chr(10) ORDER BY k) AS text FROM s GROUP BY doc_id, section""")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as Markdown documents, with headings of two levels or none."""
    text = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("## turn "), F.col("turn").cast("string"), F.lit("\n"), "text")).when(F.col("conv_id") % 3 == 1, F.concat(F.lit("# "), "role", F.lit("\n"), "text")).otherwise(F.col("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))
    docs = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n").alias("text"))
    return parsers.markdown_sections(docs)


@query()
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.html_blocks(table(spark, sf_dir, "pages"))


@query("""WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS place, trim(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', ''), '/') AS path FROM pages),
x AS (SELECT page_id, left(trim(regexp_replace(lower(CASE WHEN path = '' THEN place ELSE place || '-' || path END), '[^a-z0-9._-]+', '-', 'g'), '-._'), 96) AS x FROM u)
SELECT page_id, CASE WHEN x = '' THEN 'web-page' ELSE x END AS identifier FROM x""")
def page_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", parsers.page_identifier(F.col("url")).alias("identifier"))


@query("""WITH t AS (SELECT item_id AS doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+|[^a-z0-9 \\t\\n\\r\\f]')) AS token FROM benchmark
UNION ALL SELECT item_id, substr(text, i, 2) FROM (SELECT item_id, text, unnest(range(1, length(text))) AS i FROM benchmark) WHERE NOT regexp_matches(substr(text, i, 2), '^\\s+$'))
SELECT doc_id, CAST('0x' || left(sha256(token), 8) AS BIGINT) % 64 AS bucket, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY ALL""")
def hash_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.hash_buckets(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id"))


@query()
def hashing_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.hash_embedding(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id"))


@query()
def hash_buckets_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.hash_buckets(table(spark, sf_dir, "documents"))


@query()
def hashing_embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.hash_embedding(table(spark, sf_dir, "documents"))


@query("""SELECT p_partkey, array_to_string(list_filter(['widget', 'brand:' || lower(p_brand), CASE WHEN p_size > 25 THEN 'model:' || p_size END], lambda x: x IS NOT NULL), ',') AS tags FROM part""")
def prefixed_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise("")
    tags = parsers.prefixed_tags(F.array(F.lit("widget")), {"brand": F.lower("p_brand"), "model": model})
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tags, ",").alias("tags"))


@query()
def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a Markdown document under its identifier."""
    pages = table(spark, sf_dir, "pages")
    found = parsers.html_blocks(pages).join(pages.select("page_id", "url"), "page_id")
    return found.select("page_id", parsers.page_identifier(F.col("url")).alias("identifier"), "title", parsers.page_markdown(F.col("title"), F.col("url"), F.col("blocks")).alias("text"))
