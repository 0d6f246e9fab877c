from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmere.catalogue import query
from sparkmere.catalogue.texts import FIELD_COLUMNS, FIELDS, TERMS, chunks, queries
from sparkmere.functions.vectors import dot, norm, settled
from sparkmere.operators import graph, lexical, orchestrate, preselect, search, vectorwave
from sparkmere.plans import snapshots
from sparkmere.plans.saving import new_folder, saved
from sparkmere.sources.tables import nodes

THRESHOLD = 0.2

EDGES = """
n AS (SELECT vec_id AS node_id, embedding::DOUBLE[] AS v, label FROM embeddings),
sem AS (SELECT a.node_id AS src, b.node_id AS dst, list_dot_product(a.v, b.v) AS w FROM n a JOIN n b ON a.node_id < b.node_id WHERE list_dot_product(a.v, b.v) > 0.2),
cons AS (SELECT * FROM (SELECT node_id AS src, lead(node_id) OVER (ORDER BY node_id) AS dst FROM n) WHERE dst IS NOT NULL),
merged AS (SELECT coalesce(s.src, c.src) AS src, coalesce(s.dst, c.dst) AS dst, least(1.0::DOUBLE, coalesce(s.w, 0.0) + CASE WHEN c.src IS NULL THEN 0.0 ELSE 0.15::DOUBLE END) AS weight,
  CASE WHEN s.src IS NULL OR (c.src IS NOT NULL AND 0.15 >= s.w) THEN 'consecutive' ELSE 'semantic' END AS kind
  FROM sem s FULL JOIN cons c ON s.src = c.src AND s.dst = c.dst),
e AS (SELECT src, dst, weight FROM merged UNION ALL SELECT dst, src, weight FROM merged),
sims AS (SELECT q.node_id AS query_id, n.node_id, n.label, list_dot_product(q.v, n.v) AS sim FROM n q, n WHERE q.node_id % 20 = 0)
"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).where("node_id % 20 = 0").select(F.col("node_id").alias("query_id"), "vector")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.chunk_edges(nodes(spark, sf_dir), THRESHOLD)


def waved(spark: SparkSession, sf_dir: str, anchors: DataFrame | None = None, label: int | None = None) -> DataFrame:
    own = nodes(spark, sf_dir)
    eligible = own if label is None else own.where(F.col("label") == label)
    sims = search.similarities(asked(spark, sf_dir), eligible, search.SOURCES)
    return vectorwave.best_of_wave(sims, own, THRESHOLD, 5, None if label is None else eligible, anchors)


def wave_sql(combine: str, boost: str = "1.0", spread: str = "1.0", eligible: str = "true", graph_sql: str = EDGES) -> str:
    steps = "".join(
        f"""
w{k} AS (SELECT query_id, node_id, {combine}(a) AS a FROM (SELECT f.query_id, e.dst AS node_id, f.a * {spread} * e.weight * 0.7::DOUBLE AS a
  FROM w{k - 1} f JOIN e ON e.src = f.node_id JOIN n ON n.node_id = e.dst JOIN n s ON s.node_id = f.node_id WHERE f.a >= 0.01 AND {eligible}) WHERE a >= 0.01 GROUP BY ALL),"""
        for k in (1, 2, 3)
    )
    return f"""
WITH {graph_sql},
w0 AS (SELECT query_id, node_id, greatest(sim, 0) * {boost} AS a FROM sims n WHERE {eligible} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, node_id) <= 3),{steps}
amps AS (SELECT query_id, node_id, round({combine}(a) + 1e-9, 6) AS score FROM (FROM w0 UNION ALL FROM w1 UNION ALL FROM w2 UNION ALL FROM w3) GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS INT) AS rank, node_id, score FROM amps
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) <= 5
"""


@query(f"WITH {EDGES} SELECT src, dst, round(w, 6) AS weight FROM sem")
def semantic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.semantic_edges(nodes(spark, sf_dir), THRESHOLD).select("src", "dst", F.round("weight", 6).alias("weight"))


@query(f"WITH {EDGES} SELECT src, dst, round(weight, 6) AS weight, kind FROM merged")
def merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).select("src", "dst", F.round("weight", 6).alias("weight"), "kind")


@query(f"WITH {EDGES} SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, node_id, round(sim, 6) AS score FROM sims WINDOW w AS (PARTITION BY query_id ORDER BY sim DESC, node_id) QUALIFY row_number() OVER w <= 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = search.top_k(search.similarities(asked(spark, sf_dir), nodes(spark, sf_dir), 10), "sim", 10)
    return best.select("query_id", "rank", "node_id", F.round("sim", 6).alias("score"))


@query(wave_sql("max"))
def wave_search_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waved(spark, sf_dir)


@query(wave_sql("sum"))
def wave_search_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = nodes(spark, sf_dir)
    return vectorwave.sum_of_wave(search.similarities(asked(spark, sf_dir), own, search.SOURCES), own, THRESHOLD, 5)


@query(wave_sql("max", boost="CASE WHEN node_id % 37 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END", spread="CASE WHEN f.node_id % 37 = 0 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END"))
def wave_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pins = nodes(spark, sf_dir).where("node_id % 37 = 0").select("node_id", F.lit(2.0).alias("boost"), F.lit(1.5).alias("propagation_boost"))
    return waved(spark, sf_dir, anchors=pins)


@query(wave_sql("max", eligible="n.label = 1"))
def wave_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waved(spark, sf_dir, label=1)


@query("SELECT vec_id AS node_id, round(CASE WHEN label = 1 THEN 0.05 ELSE 0 END + CASE WHEN vec_id % 7 = 3 THEN 0.05 ELSE 0 END + 0.03 * (CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END), 6)::DOUBLE AS boost FROM embeddings")
def metadata_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = (F.col("node_id") % 2 == 0).cast("int") + (F.col("node_id") % 3 == 0).cast("int")
    boost = search.metadata_boost({"category": F.col("label") == 1, "model": F.col("node_id") % 7 == 3}, hits)
    return nodes(spark, sf_dir).select("node_id", F.round(boost, 6).alias("boost"))


@query(f"WITH {EDGES} SELECT query_id, node_id, round(sim, 6) AS sim FROM sims WHERE sim >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, node_id) <= 8")
def tag_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors: the cosine is the inner product."""
    near = search.similarities(asked(spark, sf_dir), nodes(spark, sf_dir), 8, 0.3).where("sim >= 0.3")
    return search.top_k(near, "sim", 8).select("query_id", "node_id", F.round("sim", 6).alias("sim"))


@query("""
WITH p AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: x::DOUBLE * x::DOUBLE) AS e FROM embeddings),
q AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM p),
h AS (SELECT vec_id, p, -list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * log2(x) ELSE 0 END)) / log2(8) AS entropy FROM q)
SELECT vec_id, round(entropy, 6) AS entropy, round(1 - entropy, 6) AS logic_depth, CAST(len(list_filter(p, lambda x: x > 0.05)) AS INT) AS dominant FROM h
""")
def energy_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cold-start basis is the identity's first eight axes with mean 0."""
    from sparkmere.operators.pyramid import entropy

    own = nodes(spark, sf_dir).select(F.col("node_id").alias("vec_id"), F.transform(F.slice("vector", 1, 8), lambda x: x * x).alias("energy"))
    total = F.aggregate("energy", F.lit(0.0), lambda s, x: s + x)
    own = own.withColumn("p", F.transform("energy", lambda x: x / total)).withColumn("h", entropy(F.col("p"), 8))
    return own.select("vec_id", F.round("h", 6).alias("entropy"), F.round(1 - F.col("h"), 6).alias("logic_depth"), F.size(F.filter("p", lambda x: x > 0.05)).alias("dominant"))


@query("SELECT vec_id AS node_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS length FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select("node_id", F.round(norm(F.col("vector")), 5).alias("length"))


HYBRID_STEPS = "".join(
    f"""
w{k} AS (SELECT query_id, node_id, max(a) AS a FROM (SELECT f.query_id, e.dst AS node_id, f.a * e.weight * 0.7::DOUBLE AS a FROM w{k - 1} f JOIN e ON e.src = f.node_id WHERE f.a >= 0.01) WHERE a >= 0.01 GROUP BY ALL),"""
    for k in (1, 2, 3)
)


@query(f"""
WITH {EDGES}, {TERMS}, {FIELDS},
lx AS (SELECT sc.query_id * 20 AS query_id, node_id, score FROM sc JOIN n USING (node_id) WHERE sc.query_id * 20 IN (SELECT node_id FROM n) QUALIFY row_number() OVER (PARTITION BY sc.query_id ORDER BY score DESC, node_id) <= 32),
s0 AS (SELECT query_id, node_id, sim FROM sims QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, node_id) <= 3),
s1 AS (SELECT query_id, node_id FROM lx ANTI JOIN s0 USING (query_id, node_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) <= 2),
w0 AS (SELECT query_id, node_id, greatest(sim, coalesce(score, 0), 0) AS a FROM (SELECT query_id, node_id FROM s0 UNION ALL FROM s1) JOIN sims USING (query_id, node_id) LEFT JOIN lx USING (query_id, node_id)),{HYBRID_STEPS}
amps AS (SELECT query_id, node_id, max(a) AS a FROM (FROM w0 UNION ALL FROM w1 UNION ALL FROM w2 UNION ALL FROM w3) GROUP BY ALL),
fs2 AS (SELECT query_id, node_id, round(a + CASE WHEN n.label = 1 THEN 0.05 ELSE 0 END + coalesce(lx.score, 0) + 1e-9, 6) AS score FROM amps JOIN n USING (node_id) LEFT JOIN lx USING (query_id, node_id))
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, node_id, score FROM fs2 WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, node_id) QUALIFY row_number() OVER w <= 5
""")
def wave_lexical_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and documents of one id are one node; a benchmark text is the text of the query of its id times 20. Nodes of label 1 are boosted."""
    own = nodes(spark, sf_dir)
    texts = chunks(spark, sf_dir).join(own.select("node_id"), "node_id", "left_semi")
    found = lexical.lexical_topk(queries(spark, sf_dir), texts, FIELD_COLUMNS)
    found = found.select((F.col("query_id") * 20).alias("query_id"), "node_id", "score")
    pairs = found.join(asked(spark, sf_dir).withColumnRenamed("vector", "asked"), "query_id").join(own.select("node_id", "vector"), "node_id")
    lexed = saved(pairs.select("query_id", "node_id", "score", dot(F.col("asked"), F.col("vector")).alias("sim")))
    sims = search.similarities(asked(spark, sf_dir), own, search.SOURCES)
    boosts = own.select("node_id", F.when(F.col("label") == 1, 0.05).otherwise(0.0).alias("boost"))
    found = vectorwave.hybrid_of_wave(sims, vectorwave.Near(own, THRESHOLD), 5, lexical=lexed, lexical_sources=2, boosts=boosts)
    return search.top_k(found, "score", 5).select("query_id", "rank", "node_id", "score")


KEPT = 37


def preselection(spark: SparkSession, sf_dir: str, label: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    own = nodes(spark, sf_dir)
    eligible = None if label is None else own.where(F.col("label") == label)
    anchors = own.where(F.col("node_id") % KEPT == 0).select(F.lit(None).cast("long").alias("query_id"), "node_id")
    return *preselect.preselected(asked(spark, sf_dir), own, preselect.coarse_index(own), eligible, anchors), eligible


@query()
def ann_preselect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node whose id is divisible by 37 is an anchor."""
    state, reach, _ = preselection(spark, sf_dir)
    sizes = reach.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_eligible"))
    return state.join(sizes, "query_id", "left")


@query()
def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest nodes of label 1."""
    state, reach, eligible = preselection(spark, sf_dir, 1)
    found = preselect.search_nodes(asked(spark, sf_dir), nodes(spark, sf_dir), state, reach, 10, eligible)
    return found.select("query_id", "rank", "node_id", F.round("sim", 6).alias("score"), "mode", "reason")


@query(f"""WITH {EDGES}, o AS (SELECT node_id AS anchor, label, v FROM n WHERE node_id % 10 = 0),
k AS (SELECT node_id, 'k' || (node_id // 40) AS anchor_key, v FROM n WHERE node_id % 40 >= 20),
a AS (SELECT anchor, 'k' || CASE WHEN label = 1 THEN anchor // 40 ELSE -1 END AS old_key, CASE WHEN label = 2 THEN NULL ELSE v END AS v FROM o),
f AS (SELECT a.*, m.node_id FROM a LEFT JOIN (SELECT anchor_key, max(node_id) AS node_id FROM k GROUP BY ALL) m ON m.anchor_key = old_key),
s AS (SELECT f.anchor, k.node_id AS other, k.anchor_key AS new_key, list_dot_product(f.v, k.v) AS sim FROM f, k WHERE f.node_id IS NULL AND f.v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY sim DESC, k.node_id) = 1)
SELECT f.anchor, old_key, CASE WHEN node_id IS NULL THEN coalesce(new_key, old_key) ELSE old_key END AS anchor_key, coalesce(node_id, other) AS node_id,
  CASE WHEN node_id IS NOT NULL THEN 'key' WHEN other IS NOT NULL THEN 'similar' ELSE 'unresolved' END AS how FROM f LEFT JOIN (FROM s WHERE sim >= 0.3) s USING (anchor)""")
def anchor_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth node is an anchor; the second twenty of each forty nodes are the rebuilt graph, with a key for each forty. Anchors of label 1 know their key,
    those of label 2 have no vector."""
    own = nodes(spark, sf_dir)
    key = F.concat(F.lit("k"), F.when(F.col("label") == 1, F.floor(F.col("node_id") / 40)).otherwise(-1).cast("string"))
    anchors = own.where("node_id % 10 = 0").select(F.col("node_id").alias("anchor"), key.alias("anchor_key"), F.when(F.col("label") != 2, F.col("vector")).alias("vector"))
    rebuilt = own.where("node_id % 40 >= 20").select("node_id", F.concat(F.lit("k"), F.floor(F.col("node_id") / 40).cast("string")).alias("anchor_key"), "vector")
    return graph.reconciled_anchors(anchors, rebuilt, 0.3)


def generations(spark: SparkSession, sf_dir: str) -> snapshots.Generations:
    """A base of two generations: the one that is served lacks every seventh node, its shadow has them all."""
    store, own = snapshots.Generations(spark, new_folder(spark)), nodes(spark, sf_dir)
    for part in (own.where("node_id % 7 <> 3"), own):
        graph_of = graph.consecutive_edges(part)
        store.build_shadow("base", {"nodes": part.select("node_id", "label"), "edges": graph_of, "vectors": part.select("node_id", "vector")}, f"of {sf_dir}")
        if store.resolve("base", "shadow") == 1:
            store.swap("base")
    return store


@query("""WITH g AS (SELECT 1 AS generation, vec_id FROM embeddings WHERE vec_id % 7 <> 3 UNION ALL SELECT 2, vec_id FROM embeddings)
SELECT 'base' AS kb, generation, 'ready' AS state, generation = 2 AS active, count(*) AS nodes, count(*) - 1 AS edges FROM g GROUP BY ALL""")
def generation_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both generations after the shadow has been swapped in."""
    store = generations(spark, sf_dir)
    _, active = store.swap("base")
    states = snapshots.generation_states(store.log)
    return states.select("kb", "generation", "state", (F.col("generation") == active).alias("active"), F.col("tables")["nodes"].alias("nodes"), F.col("tables")["edges"].alias("edges"))


@query(f"""WITH {EDGES}, a AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, node_id) AS r FROM sims WHERE node_id % 7 <> 3 QUALIFY r <= 10),
b AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, node_id) AS r FROM sims QUALIFY r <= 10)
SELECT query_id, count(a.r) AS n_before, count(b.r) AS n_after, count_if(a.r IS NOT NULL AND b.r IS NOT NULL) AS shared, round(count_if(a.r IS NOT NULL AND b.r IS NOT NULL) / count(*)::DOUBLE, 6) AS overlap,
  coalesce(bool_or(a.r = 1 AND b.r = 1), false) AS same_first FROM a FULL JOIN b USING (query_id, node_id) GROUP BY query_id""")
def replay_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest nodes of each query in the generation that is served and in its shadow."""
    store = generations(spark, sf_dir)
    before, after = (search.top_k(search.similarities(asked(spark, sf_dir), store.read("base", which)["vectors"], 10), "sim", 10) for which in ("active", "shadow"))
    return snapshots.replayed(before, after).withColumn("overlap", F.round("overlap", 6))


#: The vectors whose number is that of a node of the tree of brands, types and sizes, with the edges of that tree.
FULL_EDGES = """
p AS (SELECT DISTINCT unnest([p_brand, p_brand || '/' || p_type, p_brand || '/' || p_type || '/' || p_size]) AS path FROM part),
t AS (SELECT row_number() OVER (ORDER BY path) AS id, path, len(string_split(path, '/')) AS depth, CASE WHEN contains(path, '/') THEN left(path, length(path) - length(split_part(path, '/', -1)) - 1) ELSE '' END AS parent FROM p),
n AS (SELECT vec_id AS node_id, embedding::DOUBLE[] AS v, label, path, depth, parent FROM embeddings JOIN t ON id = vec_id),
sem AS (SELECT a.node_id AS src, b.node_id AS dst, list_dot_product(a.v, b.v) AS w FROM n a JOIN n b ON a.node_id < b.node_id WHERE list_dot_product(a.v, b.v) > 0.2),
cons AS (SELECT * FROM (SELECT node_id AS src, lead(node_id) OVER (ORDER BY node_id) AS dst FROM n) WHERE dst IS NOT NULL),
str AS (SELECT least(a.node_id, b.node_id) AS src, greatest(a.node_id, b.node_id) AS dst, 0.2::DOUBLE AS w, 'parent_child' AS kind FROM n a JOIN n b ON b.parent = a.path
  UNION ALL SELECT a.node_id, b.node_id, 0.1, 'sibling' FROM n a JOIN n b ON a.parent = b.parent AND a.depth = b.depth AND a.depth > 1 AND a.node_id < b.node_id),
un AS (SELECT src, dst, w AS s, NULL::DOUBLE AS c, NULL::DOUBLE AS t, NULL AS k FROM sem UNION ALL SELECT src, dst, NULL, 0.15, NULL, NULL FROM cons UNION ALL SELECT src, dst, NULL, NULL, w, kind FROM str),
un2 AS (SELECT src, dst, max(s) AS s, max(c) AS c, max(t) AS t, max(k) AS k FROM un GROUP BY ALL),
merged AS (SELECT src, dst, least(1.0::DOUBLE, least(1.0::DOUBLE, coalesce(s, 0) + coalesce(c, 0)) + coalesce(t, 0)) AS weight,
  CASE WHEN t IS NOT NULL AND ((s IS NULL AND c IS NULL) OR t >= least(1.0, coalesce(s, 0) + coalesce(c, 0))) THEN k WHEN c IS NOT NULL AND (s IS NULL OR c >= s) THEN 'consecutive' ELSE 'semantic' END AS kind FROM un2),
e AS (SELECT src, dst, weight FROM merged UNION ALL SELECT dst, src, weight FROM merged),
sims AS (SELECT q.node_id AS query_id, n.node_id, n.label, list_dot_product(q.v, n.v) AS sim FROM n q, n WHERE q.node_id % 20 = 0)
"""


def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkmere.catalogue.ingest import paths

    return saved(nodes(spark, sf_dir).join(paths(spark, sf_dir).select("node_id", "path"), "node_id"))


def full_edges(own: DataFrame) -> DataFrame:
    return graph.merged_edges(graph.semantic_edges(own, THRESHOLD), graph.consecutive_edges(own), graph.structural_edges(own))


@query(f"WITH {FULL_EDGES} SELECT src, dst, round(weight, 6) AS weight, kind FROM merged")
def full_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic, consecutive and structural edges together."""
    return full_edges(tree_nodes(spark, sf_dir)).select("src", "dst", F.round("weight", 6).alias("weight"), "kind")


@query(wave_sql("max", graph_sql=FULL_EDGES))
def wave_full_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tree_nodes(spark, sf_dir)
    queries_ = own.where("node_id % 20 = 0").select(F.col("node_id").alias("query_id"), "vector")
    found = search.wave(search.similarities(queries_, own, search.SOURCES), graph.both_ways(full_edges(own)))
    return search.top_k(found.withColumn("score", settled(F.col("amplitude"))), "score", 5).select("query_id", "rank", "node_id", "score")


@query()
def search_orchestrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and documents of one id are one node, a benchmark text is the text of the query of its id times 20; nodes of label 0 are filtered out, every
    37th node is an anchor, and nodes of label 1 are boosted."""
    own = nodes(spark, sf_dir)
    texts = chunks(spark, sf_dir).select("node_id", "heading", "body", "identity", F.col("source").alias("source_file"))
    every = own.join(texts, "node_id")
    asked_for = asked(spark, sf_dir).join(queries(spark, sf_dir).select((F.col("query_id") * 20).alias("query_id"), "text"), "query_id", "left").select("query_id", F.coalesce("text", F.lit("")).alias("text"), "vector")
    pins = own.where(F.col("node_id") % KEPT == 0).select("node_id", F.lit(2.0).alias("boost"), F.lit(1.5).alias("propagation_boost"))
    found = orchestrate.searched(
        asked_for, every, vectorwave.Near(own, THRESHOLD), 5, preselect.coarse_index(own), eligible=own.where("label <> 0"), anchors=pins, boost=F.when(F.col("label") == 1, 0.05).otherwise(0.0)
    )
    return found.withColumn("prior", F.round("prior", 6))
