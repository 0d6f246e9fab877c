from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmere.catalogue import query
from sparkmere.catalogue.texts import COVER, FIELD_COLUMNS, RE, chunks, coverage_topk, queries
from sparkmere.functions import text as fn
from sparkmere.operators import answers, compaction, contexts, evidence, lexical, prior
from sparkmere.plans.saving import saved
from sparkmere.sources.tables import table

DEFINITIONS = ("the", "of")
ACTIONS = ("an", "on", "re")
CHROME = ("menu", "cookie")

TOP = f"""{COVER},
top AS (SELECT query_id, node_id, CAST(row_number() OVER w AS INT) AS rank, round(coverage, 6) AS coverage FROM cov
  WINDOW w AS (PARTITION BY query_id ORDER BY round(coverage, 6) DESC, node_id) QUALIFY row_number() OVER w <= 5)"""


@query(f"""WITH {COVER}, c AS (SELECT query_id, node_id, coverage, lower(text) AS t FROM cov JOIN documents ON doc_id = node_id)
SELECT query_id, node_id, round(greatest(0, least(0.4, coverage) + least(0.36, 0.12 * (contains(t, 'the')::INT + contains(t, 'of')::INT))
  + CASE WHEN coverage >= 0.35 THEN least(0.12, 0.04 * (contains(t, 'an')::INT + contains(t, 'on')::INT + contains(t, 're')::INT)) ELSE 0 END
  - CASE WHEN contains(t, 'menu') OR contains(t, 'cookie') THEN 0.2 ELSE 0 END)::DOUBLE, 6) AS usefulness FROM c""")
def usefulness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cue counts are worked out once for each document, then joined with the covered pairs."""
    body = F.col("text")
    chrome = F.when(evidence.cues(body, CHROME) > 0, 0.2).otherwise(0.0)
    cued = chunks(spark, sf_dir).select("node_id", evidence.cues(body, DEFINITIONS).alias("definitions"), evidence.cues(body, ACTIONS).alias("actions"), chrome.alias("chrome"))
    covered = lexical.query_coverage(queries(spark, sf_dir), chunks(spark, sf_dir)).join(cued, "node_id")
    score = evidence.usefulness(F.col("coverage"), F.col("definitions"), F.col("actions"), F.col("chrome"))
    return covered.select("query_id", "node_id", F.round(score, 6).alias("usefulness"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), "text", "source")
    return coverage_topk(spark, sf_dir).join(docs, "node_id").withColumn("score", F.col("coverage"))


@query(f"""WITH {TOP} SELECT query_id, rank, 'ev_' || lpad(rank::VARCHAR, 3, '0') AS evidence_id, 'cit_' || lpad(rank::VARCHAR, 3, '0') AS citation_id,
substr(text, 1, 700) AS snippet, coverage AS confidence, CAST(greatest(1, (length(text) + 3) // 4) AS BIGINT) AS tokens FROM top JOIN documents ON doc_id = node_id""")
def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.evidence_rows(results(spark, sf_dir))


@query(f"""WITH {TOP}, f AS (SELECT query_id, max(coverage) AS best, min(greatest(1, (length(text) + 3) // 4)) AS least FROM top JOIN documents ON doc_id = node_id WHERE coverage >= 0.5 GROUP BY ALL)
SELECT item_id AS query_id, CASE WHEN best IS NULL THEN 'no_results' WHEN least > 100 THEN 'context_budget_exhausted' ELSE 'answerable' END AS status, coalesce(best, 0.0)::DOUBLE AS confidence
FROM benchmark LEFT JOIN f ON query_id = item_id""")
def answerability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence.evidence_rows(results(spark, sf_dir).where("score >= 0.5"))
    return evidence.answerability(rows, queries(spark, sf_dir), 100)


@query("""WITH s AS (SELECT doc_id, source FROM documents WHERE length(text) < 300)
SELECT s.doc_id AS node_id, arg_min(d.doc_id, abs(d.doc_id - s.doc_id) * 2 + CASE WHEN d.doc_id > s.doc_id THEN 1 ELSE 0 END) AS neighbour FROM s JOIN documents d ON s.source = d.source AND d.doc_id <> s.doc_id
AND abs(d.doc_id - s.doc_id) <= 20 AND length(d.text) >= 40 GROUP BY s.doc_id""")
def adjacent_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chunks(spark, sf_dir).select("node_id", "source", "text")
    return evidence.adjacent_evidence(own.where("length(text) < 300"), own, distance=20)


NEIGHBOURS = 2
PAGE_CHARS = 3000


def context_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best covered documents of each query and then the documents beside them in the same language, which stands for the file. Documents follow each
    other by number, from page to page; those without a line break have no pages. A document's first line is its section."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), F.coalesce("lang", F.lit("")).alias("source"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("section"), "text")
    top = coverage_topk(spark, sf_dir).select("query_id", "rank", "node_id", F.col("coverage").alias("score")).join(docs.select("node_id", "source"), "node_id")
    top = saved(top.select("query_id", "rank", "node_id", "source", "score"))
    beside = top.select("query_id", "rank", "source", "score", F.explode(F.sequence(F.col("node_id") - NEIGHBOURS, F.col("node_id") + NEIGHBOURS)).alias("node_id"))
    beside = beside.groupBy("query_id", "source", "node_id").agg(F.min("rank").alias("rank"), F.max("score").alias("score")).join(top.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    every = top.withColumn("later", F.lit(0)).unionByName(beside.withColumn("later", F.lit(1))).join(docs, ["node_id", "source"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("later", "rank", "node_id"))
    first = F.when(F.contains("text", F.lit("\n")), F.col("node_id"))
    asked = queries(spark, sf_dir).select("query_id", compaction.terms(F.col("text")).alias("asked"))
    rows = every.withColumn("rank", rank).join(asked, "query_id")
    return rows.withColumns({"page_first": first, "page_last": first + F.floor(F.length("text") / PAGE_CHARS)}).drop("later")


@query()
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts.contexts(context_evidence(spark, sf_dir), 600, most=0).select("query_id", "node_id", "place", "tokens")


@query()
def context_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = contexts.contexts(context_evidence(spark, sf_dir), 600)
    return items.select("query_id", "place", "node_id", "tokens", F.array_join("refs", ",").alias("refs"), F.sha2("content", 256).alias("content_sha256"))


@query()
def context_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence_rows = saved(context_evidence(spark, sf_dir))
    return contexts.diagnostics(contexts.scored(evidence_rows), contexts.contexts(evidence_rows, 600))


DEF_SQL = " + ".join(f"regexp_matches(t, '{p}')::INT" for p in compaction.DEFINITIONS)
ACT_SQL = " + ".join(f"regexp_matches(t, '{p}')::INT" for p in compaction.ACTIONS)
PAGE_ACT_SQL = " + ".join(f"regexp_matches(t, '{p}')::INT" for p in compaction.ACTIONS[:-1])
MENU_SQL = " + ".join(f"contains(t, '{c}')::INT" for c in compaction.CHROME)
PAGES = f"""{TOP}, a AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9㐀-鿿]+'), lambda x: length(x) >= 2)) AS asked FROM benchmark),
v AS (SELECT query_id, node_id, rank, source AS page, split_part(text, chr(10), 1) AS header, coverage AS score, asked, ' ' || lower(split_part(text, chr(10), 1) || chr(10) || text) || ' ' AS t
  FROM top JOIN documents ON doc_id = node_id JOIN a USING (query_id)),
m AS (SELECT *, {MENU_SQL} AS menus, left(trim(regexp_replace(t, '\\s+', ' ', 'g')), 180) AS head,
  coalesce(len(list_intersect(list_distinct(regexp_extract_all(t, '[a-z0-9㐀-鿿]+')), asked)) / nullif(len(asked), 0)::DOUBLE, 0) AS share FROM v),
u AS (SELECT query_id, node_id, rank, page, header, score, round(share, 6) AS coverage, round(greatest(0, least(0.4, share) + least(0.36, 0.12 * ({DEF_SQL})) + CASE WHEN share >= 0.35 THEN least(0.12, 0.04 * ({PAGE_ACT_SQL})) ELSE 0 END
  - CASE WHEN menus > 0 OR contains(head, 'source: http') OR contains(head, 'navigation') THEN least(0.2, 0.08 * greatest(1, menus)) ELSE 0 END)::DOUBLE, 6) AS usefulness FROM m),
w AS (SELECT *, max(same) OVER q AS most, max(usefulness) OVER q AS best, max(CASE WHEN rank = 1 THEN usefulness END) OVER q AS u1, max(CASE WHEN rank = 1 THEN score END) OVER q AS s1, max(CASE WHEN rank > 1 THEN score END) OVER q AS s2,
  row_number() OVER (PARTITION BY query_id ORDER BY usefulness DESC, coverage DESC, score DESC, rank) AS k
  FROM (SELECT *, greatest(count(*) OVER (PARTITION BY query_id, page), CASE WHEN header <> '' THEN count(*) OVER (PARTITION BY query_id, header) ELSE 0 END) AS same FROM u) WINDOW q AS (PARTITION BY query_id)),
z AS (SELECT *, max(CASE WHEN rank > 1 AND abs(s1 - score) <= 1e-6 THEN usefulness END) OVER q AS peer, min(CASE WHEN best > 0 AND usefulness >= greatest(0.45, best - 1e-9) THEN rank END) OVER q AS f FROM w WINDOW q AS (PARTITION BY query_id))"""


@query(f"""WITH {PAGES} SELECT query_id, node_id, rank, usefulness, CAST(CASE WHEN most < 2 OR u1 >= 0.55 OR coalesce(peer <= u1 + 1e-9, false) OR coalesce(s1 - s2 >= 0.15, false) OR coalesce(f, 1) <= 1 THEN rank ELSE k END AS INT) AS new_rank FROM z""")
def same_page_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = queries(spark, sf_dir).select("query_id", compaction.terms(F.col("text")).alias("asked"))
    header = F.split_part("text", F.lit("\n"), F.lit(1))
    rows = results(spark, sf_dir).join(asked, "query_id").withColumns({"page": F.col("source"), "header": header})
    share, useful = compaction.page_usefulness(F.concat("header", F.lit("\n"), "text"), F.col("asked"))
    ranked = evidence.same_page_order(rows.withColumns({"coverage": share, "usefulness": useful}))
    return ranked.select("query_id", "node_id", "rank", "usefulness", "new_rank")


@query(f"""WITH {TOP}, e AS (SELECT query_id, rank, 'cit_' || lpad(rank::VARCHAR, 3, '0') AS cid, substr(text, 1, 160) AS opening FROM top JOIN documents ON doc_id = node_id),
o AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY query_id, opening ORDER BY rank) = 1),
k AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 3)
SELECT query_id, string_agg(opening || ' [' || cid || ']', chr(10) ORDER BY rank) AS answer FROM k GROUP BY query_id""")
def answer_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.answer_excerpts(evidence.evidence_rows(results(spark, sf_dir)))


@query(f"""WITH {TOP}, c AS (SELECT query_id, list('cit_' || lpad((rank * 2)::VARCHAR, 3, '0') ORDER BY rank) AS cited, list('cit_' || lpad(rank::VARCHAR, 3, '0') ORDER BY rank) AS allowed FROM top GROUP BY ALL)
SELECT query_id, array_to_string(list_filter(cited, lambda x: list_contains(allowed, x)), ',') AS citations FROM c""")
def citation_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that cite every second id, of which those of the evidence stay."""
    def ids(step: int):
        return F.transform(F.array_sort(F.collect_list("rank")), lambda r: F.concat(F.lit("cit_"), F.lpad((r * step).cast("string"), 3, "0")))

    cited = coverage_topk(spark, sf_dir).groupBy("query_id").agg(ids(2).alias("cited"), ids(1).alias("allowed"))
    return cited.select("query_id", F.array_join(evidence.valid_citations(F.col("cited"), F.col("allowed")), ",").alias("citations"))


@query("""WITH l AS (SELECT conv_id, turn, role, role || ': ' || substr(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), 1, CASE WHEN role = 'user' THEN 220 ELSE 360 END) AS line FROM conversations),
c AS (SELECT conv_id, turn, role, lag(line, 2) OVER w AS a, lag(line) OVER w AS b FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role))
SELECT conv_id, turn, role, concat_ws(' | ', a, b) AS context FROM c WHERE role = 'user'""")
def conversation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.conversation_context(table(spark, sf_dir, "conversations"))


@query(f"""WITH q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), {RE}))) AS t FROM benchmark),
n AS (SELECT query_id, count(*) AS n FROM q GROUP BY ALL),
a AS (SELECT page_id AS asset_id, unnest(list_distinct(regexp_extract_all(lower(html), {RE}))) AS t FROM pages),
o AS (SELECT query_id, asset_id, count(*) / any_value(n)::DOUBLE AS overlap FROM q JOIN a USING (t) JOIN n USING (query_id) GROUP BY ALL HAVING count(*) / any_value(n)::DOUBLE >= 0.1)
SELECT query_id, asset_id, round(overlap, 6) AS overlap, CAST(row_number() OVER w AS INT) AS rank FROM o WINDOW w AS (PARTITION BY query_id ORDER BY overlap DESC, asset_id) QUALIFY row_number() OVER w <= 4""")
def visual_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = queries(spark, sf_dir).select("query_id", F.explode(F.array_distinct(fn.tokens(F.col("text")))).alias("term"))
    assets = table(spark, sf_dir, "pages").select(F.col("page_id").alias("asset_id"), F.explode(F.array_distinct(fn.tokens(F.col("html")))).alias("term"))
    return evidence.visual_overlap(asked, assets).withColumn("overlap", F.round("overlap", 6))


@query(r"""SELECT doc_id AS node_id, CASE WHEN regexp_matches(lower(text), '\b(api|apis|branch|branches|commit|commits|docs|documentation|github|markdown|pull\s+request|readme|repository|repositories|tutorial|workflow)\b') THEN 'generic'
WHEN regexp_matches(lower(text), '\b(how\s+to|what\s+should|troubleshoot|fix|fault|problem|weak|low|small)\b') OR regexp_matches(text, '怎么办|怎麼辦|如何处理|如何處理|怎么处理|怎麼處理|故障|异常|異常') THEN 'troubleshooting' ELSE 'generic' END AS intent FROM documents""")
def answer_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("node_id", evidence.answer_intent(F.col("text")).alias("intent"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, node_id, text, asked of the five best covered documents of each query."""
    asked = queries(spark, sf_dir).select("query_id", compaction.terms(F.col("text")).alias("asked"))
    return results(spark, sf_dir).join(asked, "query_id").select("query_id", "node_id", "text", "asked")


@query(f"""WITH {TOP}, a AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9㐀-鿿]+'), lambda x: length(x) >= 2)) AS asked FROM benchmark),
r AS (SELECT query_id, node_id, asked, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM top JOIN documents ON doc_id = node_id JOIN a USING (query_id)),
s AS (SELECT *, len(list_intersect(list_distinct(regexp_extract_all(t, '[a-z0-9㐀-鿿]+')), asked)) / greatest(1, len(asked))::DOUBLE AS share FROM r)
SELECT query_id, node_id, round(greatest(0, least(0.4, share) + least(0.36, 0.12 * ({DEF_SQL})) + CASE WHEN share >= 0.35 THEN least(0.12, 0.04 * ({ACT_SQL})) ELSE 0 END
  - CASE WHEN contains(left(t, 180), 'source: http') OR contains(left(t, 180), 'navigation') THEN 0.2 ELSE 0 END)::DOUBLE, 6) AS usefulness FROM s""")
def context_usefulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("query_id", "node_id", F.round(compaction.usefulness(F.col("text"), F.col("asked")), 6).alias("usefulness"))


@query()
def context_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compaction.compacted(_asked(spark, sf_dir), compaction.compaction_target(200))
    return found.select("query_id", "node_id", F.length("content").alias("n_chars"), F.sha2("content", 256).alias("content_sha256"))


@query()
def evidence_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the five best covered documents of each query; a document's first line is its heading, its source the file and its language the manual."""
    pairs = results(spark, sf_dir).select("query_id", "node_id").join(chunks(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), "lang"), "node_id"), "node_id")
    pairs = pairs.select("query_id", "node_id", F.col("heading").alias("header"), F.col("text").alias("body"), F.col("source").alias("source_file"), F.col("lang").alias("manual"))
    return prior.evidence_prior(pairs, queries(spark, sf_dir)).withColumn("prior", F.round("prior", 6))


@query()
def evidence_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical scores with one decimal, so that many are equal, ranked with the prior: the first ten of a pool of 32."""
    found = saved(lexical.lexical_topk(queries(spark, sf_dir), chunks(spark, sf_dir), FIELD_COLUMNS).select("query_id", "node_id", F.round("score", 1).alias("score")))
    docs = chunks(spark, sf_dir).select("node_id", F.col("heading").alias("header"), F.col("text").alias("body"), F.col("source").alias("source_file"), F.lit("").alias("manual"))
    ranked = prior.final_rank(found, prior.evidence_prior(found.select("query_id", "node_id").join(docs, "node_id"), queries(spark, sf_dir)), 10)
    return ranked.select("query_id", "node_id", "rank", "score", F.round("prior", 6).alias("prior"))


@query()
def extractive_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers from the merged contexts of the questions and, behind them, from their evidence."""
    rows = saved(context_evidence(spark, sf_dir))
    cited = F.concat(F.lit("cit_"), F.lpad(F.col("rank").cast("string"), 3, "0"))
    items = contexts.contexts(rows, 600).select("query_id", F.lit(0).alias("stage"), F.col("place").alias("at"), F.col("ranks")[0].alias("rank"), F.col("content").alias("text"))
    every = items.unionByName(rows.select("query_id", F.lit(1).alias("stage"), F.col("rank").alias("at"), "rank", "text")).withColumn("citation_id", cited)
    allowed = items.select("query_id", "rank").withColumn("citation_id", cited).select("query_id", "citation_id").distinct()
    found = answers.extractive_answers(queries(spark, sf_dir), every.join(allowed, ["query_id", "citation_id"], "left_semi"))
    return found.select("query_id", F.length("answer").alias("n_chars"), F.sha2("answer", 256).alias("answer_sha256"), F.array_join("citations", ",").alias("citations"))


@query()
def context_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = saved(context_evidence(spark, sf_dir))
    return contexts.inspected(queries(spark, sf_dir), rows, contexts.contexts(rows, 600), 600)
