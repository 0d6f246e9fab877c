from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmere.catalogue import ORACLES, query
from sparkmere.catalogue.vectors import EDGES, asked
from sparkmere.functions.vectors import settled
from sparkmere.operators import boost, pyramid, search, tags
from sparkmere.plans.saving import saved
from sparkmere.sources import parsers
from sparkmere.sources.tables import nodes, table, tag_positions

POSITIONS = """
pos AS (SELECT manual, tag, row_number() OVER (PARTITION BY manual ORDER BY line, tag) AS position FROM
  (SELECT l_orderkey AS manual, l_partkey AS tag, min(l_linenumber) AS line FROM lineitem GROUP BY ALL)),
phi AS (SELECT manual, tag, position, 0.9::DOUBLE - 0.4::DOUBLE * (position - 1) / greatest(1, n - 1) AS f FROM
  (SELECT *, count(*) OVER (PARTITION BY manual) AS n FROM pos) WHERE n BETWEEN 2 AND 100),
cooc AS (SELECT a.tag AS src, b.tag AS dst, sum(a.f * b.f) AS weight FROM phi a JOIN phi b ON a.manual = b.manual AND a.position < b.position GROUP BY ALL)
"""


def rounded_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights at 9 digits, so that ties between neighbours don't hang on the order of addition."""
    return tags.cooccurrence(tag_positions(spark, sf_dir)).withColumn("weight", settled(F.col("weight"), 9))


@query(f"WITH {POSITIONS} SELECT manual, tag, CAST(position AS INT) AS position FROM pos")
def tag_positions_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_positions(spark, sf_dir)


@query(f"WITH {POSITIONS} SELECT src, dst, round(weight + 1e-9, 6) AS weight FROM cooc")
def tag_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.cooccurrence(tag_positions(spark, sf_dir)).select("src", "dst", settled(F.col("weight")).alias("weight"))


LEGACY = """
lp AS (SELECT manual, tag, CASE WHEN tag % 10 = 0 THEN 0 ELSE position END AS position FROM pos),
ls AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY manual) AS n FROM lp) WHERE n BETWEEN 2 AND 100),
lc AS (SELECT a.tag AS t1, b.tag AS t2, count(*) * 0.49::DOUBLE AS weight FROM ls a JOIN ls b ON a.manual = b.manual AND a.tag < b.tag WHERE a.position = 0 OR b.position = 0 GROUP BY ALL)
"""


@query(f"WITH {POSITIONS}, {LEGACY} SELECT t1 AS src, t2 AS dst, round(weight, 6) AS weight FROM lc UNION ALL SELECT t2, t1, round(weight, 6) FROM lc")
def tag_cooccurrence_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags whose id ends in 0 stand for tags without a position."""
    old = tag_positions(spark, sf_dir).withColumn("position", F.when(F.col("tag") % 10 == 0, 0).otherwise(F.col("position")))
    return tags.legacy_cooccurrence(old).withColumn("weight", F.round("weight", 6))


NEIGHBOURS = """
c9 AS (SELECT src, dst, round(weight + 1e-9, 9) AS weight FROM cooc),
nb AS (SELECT tag, neighbour, max(weight) AS weight FROM (SELECT src AS tag, dst AS neighbour, weight FROM c9 UNION ALL SELECT dst, src, weight FROM c9) GROUP BY ALL)
"""


@query(f"WITH {POSITIONS}, {NEIGHBOURS} SELECT tag, neighbour, round(weight, 6) AS weight, CAST(row_number() OVER w AS INT) AS rank FROM nb WINDOW w AS (PARTITION BY tag ORDER BY weight DESC, neighbour) QUALIFY row_number() OVER w <= 10")
def tag_top_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.top_neighbours(rounded_cooccurrence(spark, sf_dir), 10).withColumn("weight", F.round("weight", 6))


@query("SELECT p_partkey AS tag, p_name AS name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 48)")
def orphan_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tag"), F.col("p_name").alias("name"))
    return tags.orphans(known, table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity >= 48").select(F.col("l_partkey").alias("tag")))


def _hops() -> str:
    return "".join(
        f"""
p{k} AS (SELECT query_id, tag, sum(energy) AS energy, max(momentum) AS momentum FROM (
  SELECT p.query_id, s.dst AS tag, p.energy * s.weight * CASE WHEN s.weight >= 1 THEN 0.7::DOUBLE ELSE 0.25::DOUBLE END AS energy,
         p.momentum - CASE WHEN s.weight >= 1 THEN 0 ELSE 1 END AS momentum, s.weight >= 1 AS hole
  FROM p{k - 1} p JOIN syn s ON s.src = p.tag WHERE p.energy >= 0.1 AND p.momentum >= 0)
  WHERE energy >= 0.01 AND (hole OR momentum >= 0) GROUP BY query_id, tag),"""
        for k in (1, 2, 3, 4)
    )


SPIKES = f"""
syn AS (SELECT src, dst, weight FROM c9 QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= 20),
p0 AS (SELECT DISTINCT p_size AS query_id, first_value(p_partkey) OVER (PARTITION BY p_size ORDER BY p_retailprice DESC, p_partkey) AS tag, 1.0::DOUBLE AS energy, 2.0::DOUBLE AS momentum FROM part),{_hops()}
energies AS (SELECT query_id, tag, sum(energy) AS energy FROM (SELECT query_id, tag, energy FROM p0 UNION ALL SELECT query_id, tag, energy FROM p1
  UNION ALL SELECT query_id, tag, energy FROM p2 UNION ALL SELECT query_id, tag, energy FROM p3 UNION ALL SELECT query_id, tag, energy FROM p4) GROUP BY ALL)
"""


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part size, a spike from its dearest part."""
    seeds = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("query_id")).agg(F.min_by("p_partkey", F.struct(-F.col("p_retailprice"), "p_partkey")).alias("tag")).withColumn("energy", F.lit(1.0))
    return tags.spike(seeds, rounded_cooccurrence(spark, sf_dir))


@query(f"WITH {POSITIONS}, {NEIGHBOURS}, {SPIKES} SELECT query_id, tag, round(energy + 1e-9, 5) AS energy FROM energies")
def spike_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes(spark, sf_dir).withColumn("energy", settled(F.col("energy"), 5))


@query(f"""WITH {EDGES},
res AS (SELECT query_id, node_id, round(sim, 6) AS score FROM sims QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 6) DESC, node_id) <= 20),
nt AS (SELECT node_id, unnest([label, 100 + node_id % 5, 200 + node_id % 7])::BIGINT AS tag FROM n),
en AS (SELECT query_id, tag, ((query_id * 31 + tag * 17) % 97) / 97.0::DOUBLE AS energy FROM (SELECT DISTINCT query_id FROM res), (SELECT DISTINCT tag FROM nt) WHERE (query_id + tag) % 3 <> 0),
g AS (SELECT r.query_id, r.node_id, avg(energy) AS mean, count(*) AS hits FROM res r JOIN nt USING (node_id) JOIN en USING (query_id, tag) GROUP BY ALL),
j AS (SELECT r.*, CASE WHEN hits >= 2 THEN mean ELSE 0 END AS geo FROM res r LEFT JOIN g USING (query_id, node_id)),
f AS (SELECT *, CASE WHEN max(geo) OVER (PARTITION BY query_id) > 0 THEN 0.7 * score + 0.3 * geo / max(geo) OVER (PARTITION BY query_id) ELSE score END AS final FROM j)
SELECT query_id, node_id, round(final, 5) AS final, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS INT) AS old_rank,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY final DESC, node_id) AS INT) AS new_rank FROM f""")
def geodesic_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = nodes(spark, sf_dir)
    scored = search.similarities(asked(spark, sf_dir), own, 20).withColumn("score", F.round("sim", 6))
    results = search.top_k(scored, "score", 20).select("query_id", "node_id", "score")
    node_tags = own.select("node_id", F.explode(F.array(F.col("label").cast("long"), 100 + F.col("node_id") % 5, 200 + F.col("node_id") % 7)).alias("tag"))
    pairs = asked(spark, sf_dir).select("query_id").join(node_tags.select("tag").distinct()).where("(query_id + tag) % 3 != 0")
    energies = pairs.withColumn("energy", (F.col("query_id") * 31 + F.col("tag") * 17) % 97 / 97.0)
    return tags.geodesic_rerank(results, node_tags, energies).select("query_id", "node_id", F.round("final", 5).alias("final"), "old_rank", "new_rank")


@query(f"""WITH g0 AS ({ORACLES['geodesic_rerank']}) SELECT query_id, count_if(old_rank <= 5 AND new_rank <= 5 AND old_rank <> new_rank) AS rank_changed, count_if(new_rank <= 5 AND old_rank > 5) AS new_entry,
  count_if(old_rank <= 5 AND new_rank > 5) AS lost_entry FROM g0 GROUP BY query_id""")
def geodesic_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.rerank_swaps(geodesic_rerank(spark, sf_dir), 5)


@query()
def intrinsic_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's energy outside the span of its ten nearest in the graph of similar vectors."""
    from sparkmere.catalogue.vectors import THRESHOLD

    own = nodes(spark, sf_dir)
    return pyramid.intrinsic_residuals(search.nearest_linked(own, THRESHOLD, 10), own)


@query()
def residual_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pyramid.residual_pyramid(asked(spark, sf_dir), nodes(spark, sf_dir))


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = nodes(spark, sf_dir)
    return search.top_k(search.similarities(asked(spark, sf_dir), own, 8), "sim", 8).join(own, "node_id").select("query_id", F.col("node_id").alias("tag"), F.col("sim").alias("weight"), "vector")


@query()
def semantic_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pyramid.merged_alike(_seeds(spark, sf_dir), least=0.5)


@query()
def tag_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries moved towards the weighted mean of their seed tags."""
    return pyramid.fused(asked(spark, sf_dir), _seeds(spark, sf_dir), 0.3)


AXES = """
ax AS (SELECT vec_id AS query_id, list_transform(embedding[1:8], lambda x: x::DOUBLE * x::DOUBLE) AS e FROM embeddings),
ap AS (SELECT query_id, list_reverse_sort(list_transform(e, lambda x: x / list_sum(e))) AS p FROM ax)"""


def _energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = nodes(spark, sf_dir).select(F.col("node_id").alias("query_id"), F.transform(F.slice("vector", 1, 8), lambda x: x * x).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda s, x: s + x)
    return own.select("query_id", F.transform("e", lambda x: x / total).alias("p"))


@query(f"WITH {AXES.strip()} SELECT query_id, round(list_sum(list_filter(list_transform(p[2:], lambda x: sqrt(p[1] * x)), lambda x: x > 0.15)), 5) AS resonance FROM ap WHERE len(list_filter(list_transform(p[2:], lambda x: sqrt(p[1] * x)), lambda x: x > 0.15)) > 0 UNION ALL SELECT query_id, 0.0 FROM ap WHERE len(list_filter(list_transform(p[2:], lambda x: sqrt(p[1] * x)), lambda x: x > 0.15)) = 0")
def tag_resonance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The energies of each vector on the first eight axes."""
    return _energies(spark, sf_dir).select("query_id", F.round(tags.resonance(F.col("p")), 5).alias("resonance"))


@query(f"""WITH {AXES.strip()}, h AS (SELECT query_id, p, 1 + list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * log2(x) ELSE 0 END)) / 3 AS depth FROM ap),
s AS (SELECT query_id, depth, coalesce(list_sum(list_filter(list_transform(p[2:], lambda x: sqrt(p[1] * x)), lambda x: x > 0.15)), 0) AS res FROM h)
SELECT query_id, round(least(2, greatest(0.3, depth * 1.5)), 5)::DOUBLE AS by_depth, round(least(2, greatest(0.3, depth * (1 + ln(1 + res)) / (1 + 0.5 * (1 - depth)) * 1.2)), 5)::DOUBLE AS by_pyramid FROM s""")
def dynamic_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    depth = 1 - pyramid.entropy(F.col("p"), 8)
    by_pyramid = pyramid.dynamic_boost(depth, "pyramid", residual=tags.resonance(F.col("p")), spread=1 - depth, activation=F.lit(1.2))
    return _energies(spark, sf_dir).select("query_id", F.round(pyramid.dynamic_boost(depth, "epa", 1.5), 5).alias("by_depth"), F.round(by_pyramid, 5).alias("by_pyramid"))


CORE = """
k AS (SELECT DISTINCT o_custkey AS query_id, 'p' || CASE WHEN l_partkey % 4 = 0 THEN l_partkey + 1 ELSE l_partkey END AS tag FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 5 = 0),
cd AS (SELECT o_custkey AS query_id, 'p' || l_partkey AS tag, max(l_quantity) AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 5 IN (0, 1) AND l_partkey % 4 <> 0 GROUP BY ALL),
fa AS (SELECT c_custkey AS query_id, (1.2::DOUBLE + least(1, 0.5 * (c_custkey % 10) / 10 + 0.5 * (1 - (c_custkey % 3) / 4)) * 0.2::DOUBLE) * (0.95::DOUBLE + 0.1::DOUBLE * (c_custkey % 7) / 10) AS factor FROM customer),
we AS (SELECT query_id, tag, CASE WHEN k.tag IS NULL THEN weight ELSE weight * factor END AS weight, k.tag IS NOT NULL AS core FROM cd LEFT JOIN k USING (query_id, tag) JOIN fa USING (query_id)),
mo AS (SELECT query_id, max(weight) AS most FROM we GROUP BY ALL),
al AS (SELECT * FROM we UNION ALL SELECT k.query_id, k.tag, coalesce(most, factor), true FROM k ANTI JOIN cd USING (query_id, tag) LEFT JOIN mo USING (query_id) JOIN fa USING (query_id))"""


def _core(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers stand for queries; the parts of some of their orders are candidates, those of others core tags; every fourth part is a synonym."""
    lines = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    asked_for = lines.where("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("query_id"), F.concat(F.lit(" P"), "l_partkey").alias("name"))
    policy = table(spark, sf_dir, "part").where("p_partkey % 4 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("name"), F.concat(F.lit("P"), F.col("p_partkey") + 1).alias("canonical"))
    held = lines.where("o_orderkey % 5 IN (0, 1) AND l_partkey % 4 != 0").groupBy(F.col("o_custkey").alias("query_id"), F.concat(F.lit("p"), "l_partkey").alias("tag")).agg(F.max("l_quantity").alias("weight"))
    key = F.col("c_custkey")
    factors = table(spark, sf_dir, "customer").select(key.alias("query_id"), tags.core_boost(key % 10 / 10, key % 3 / 4, key % 7 / 10).alias("factor"))
    return tags.core_tags(asked_for, policy), held, factors


@query(f"WITH {CORE.strip()} SELECT query_id, tag, round(weight, 5) AS weight, core FROM al")
def core_tag_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    core, held, factors = _core(spark, sf_dir)
    return tags.with_core(held, core, factors).withColumn("weight", F.round("weight", 5))


@query(f"""WITH {CORE.strip()}, ba AS (SELECT query_id, max(weight / factor) AS base FROM we JOIN fa USING (query_id) GROUP BY ALL), gh AS (SELECT vec_id AS query_id, unnest([1, 2]) AS i, vec_id % 3 AS r FROM embeddings)
SELECT query_id, CASE WHEN r = 0 THEN -1 ELSE -i END AS tag, round(coalesce(base, 1) * CASE WHEN i = 1 THEN coalesce(factor, 1) ELSE 1 END, 5) AS weight, i = 1 AS hard FROM gh LEFT JOIN ba USING (query_id) LEFT JOIN fa USING (query_id) WHERE NOT (r = 0 AND i = 1)""")
def ghost_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector brings a hard ghost, of a wrong dimension for every third, and a soft one."""
    core, held, factors = _core(spark, sf_dir)
    hard = F.struct(F.lit(True).alias("hard"), F.when(F.col("node_id") % 3 == 0, F.slice("vector", 1, 5)).otherwise(F.col("vector")).alias("vector"))
    own = nodes(spark, sf_dir).select(F.col("node_id").alias("query_id"), F.array(hard, F.struct(F.lit(False).alias("hard"), F.col("vector").alias("vector"))).alias("ghosts"))
    weighed = tags.with_core(held, core, factors).join(held.select("query_id", "tag"), ["query_id", "tag"], "left_semi")
    return tags.ghost_candidates(own, weighed, factors, 64).select("query_id", "tag", F.round("weight", 5).alias("weight"), "hard")


@query(r"""WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'abc' WHEN 1 THEN 'usb-c cable 2.0' WHEN 2 THEN '冰箱abc' ELSE event_type END AS tag, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Hardware' WHEN 2 THEN 'Politics & Society' WHEN 3 THEN ' Unknown ' ELSE 'home and garden' END AS world FROM events)
SELECT event_id, round(CASE WHEN world = 'Hardware' OR tag = 'abc' OR contains(tag, '冰箱') THEN 1.0 WHEN world IS NULL OR world = ' Unknown ' THEN 0.4 WHEN world LIKE 'Politics%' THEN sqrt(0.3) ELSE 0.3 END, 6)::DOUBLE AS penalty FROM t""")
def language_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    tag = F.when(key % 4 == 0, "abc").when(key % 4 == 1, "usb-c cable 2.0").when(key % 4 == 2, "冰箱abc").otherwise(F.col("event_type"))
    world = F.when(key % 5 == 1, "Hardware").when(key % 5 == 2, "Politics & Society").when(key % 5 == 3, " Unknown ").when(key % 5 == 4, "home and garden")
    return table(spark, sf_dir, "events").select("event_id", F.round(tags.language_penalty(tag, world), 6).alias("penalty"))


@query("""SELECT event_id, CASE WHEN event_id % 29 = 0 THEN 'spike_disabled' WHEN event_id % 23 = 0 THEN 'matrix_missing' WHEN event_type = 'signup' THEN 'no_tag_vectors' WHEN user_id % 8 = 0 THEN 'no_seeds' WHEN user_id % 6 = 0 THEN 'no_candidates'
WHEN value < 3 THEN 'degenerate_context' WHEN value < 6 THEN 'zero_alpha' END AS reason FROM events""")
def boost_skip_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = tags.skip_reason(F.col("event_id") % 29 != 0, F.col("event_id") % 23 != 0, F.when(F.col("event_type") == "signup", 0).otherwise(1), F.col("user_id") % 8, F.col("user_id") % 6, F.when(F.col("value") < 3, 0.0).otherwise(1.0), F.when(F.col("value") < 6, 0.0).otherwise(0.5))
    return table(spark, sf_dir, "events").select("event_id", reason.alias("reason"))


@query()
def epa_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each axis' share of the energy, and how far it turns away from every single dimension."""
    axes, _, energies = pyramid.energy_basis(nodes(spark, sf_dir).select("node_id", "vector"))
    total = float(energies.sum()) or 1.0
    return spark.createDataFrame([(k, round(float(energies[k]) / total, 6), round(float(abs(axes[k]).max()), 6)) for k in range(len(axes))], "axis int, share double, most double")


@query()
def energy_projection_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector on the learnt axes: entropy, depth, dominant axes and resonance."""
    axes, mean, _ = pyramid.energy_basis(nodes(spark, sf_dir).select("node_id", "vector"))
    found = pyramid.projection(nodes(spark, sf_dir).select(F.col("node_id").alias("query_id"), "vector"), axes, mean)
    h = pyramid.entropy(F.col("p"), len(axes))
    return found.select("query_id", F.round(h, 6).alias("entropy"), F.round(1 - h, 6).alias("logic_depth"), F.size(F.filter("p", lambda x: x > 0.05)).alias("dominant"), F.round(tags.resonance(F.col("p")), 6).alias("resonance"))


@query()
def pyramid_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth, coverage, novelty, coherence and activation of each query among all vectors, those of the tag graph weighed by their residuals."""
    own = nodes(spark, sf_dir)
    residuals = pyramid.intrinsic_residuals(tags.top_neighbours(rounded_cooccurrence(spark, sf_dir), 10), own)
    found = pyramid.pyramid_features(pyramid.pyramid_levels(asked(spark, sf_dir), own, residuals.select("tag", "residual")))
    return found.select("query_id", "depth", *(F.round(c, 5).alias(c) for c in ("coverage", "novelty", "coherence", "activation")))


@query()
def tag_boost_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as tags under the names of parts, the parts of orders as their graph. Each query names its next two tags as core tags and brings a ghost, its own
    vector turned around."""
    own = nodes(spark, sf_dir)
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tag"), F.col("p_name").alias("name"))
    rows = saved(own.select(F.col("node_id").alias("tag"), "vector").join(parts, "tag", "left").select("tag", F.coalesce("name", F.lit("")).alias("name"), "vector"))
    cooc = saved(rounded_cooccurrence(spark, sf_dir))
    axes, mean, _ = pyramid.energy_basis(own)
    labels = pyramid.axis_labels(axes, rows.withColumnRenamed("tag", "node_id"))
    queries = asked(spark, sf_dir)
    named = queries.select("query_id", F.explode(F.array(F.col("query_id") + 1, F.col("query_id") + 2)).alias("tag")).join(parts, "tag")
    core = tags.core_tags(named.select("query_id", "name"), spark.createDataFrame([], "name string, canonical string"))
    ghosts = queries.select("query_id", F.array(F.struct((F.col("query_id") % 40 == 0).alias("hard"), F.reverse("vector").alias("vector"))).alias("ghosts"))
    residuals = pyramid.intrinsic_residuals(tags.top_neighbours(cooc, 10), own).select("tag", "residual")
    found = boost.apply_tag_boost(queries, rows, cooc, (axes, mean), labels, 0.5, core, ghosts, saved(residuals), resonant=True)
    digest = F.array_join(F.transform("vector", lambda x: F.format_number(x + 0.0, 4)), ",")
    return found.select("query_id", digest.alias("vector"), "reason", F.round("alpha", 5).alias("alpha"), "seeds", "emergent", "core_added", "ghosts", F.size("matched").alias("matched"), F.round("activation", 5).alias("activation"), "world")


@query()
def dirty_tags_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as tags; those of an odd number have a vector, the others get the hashing embedder's."""
    part = table(spark, sf_dir, "part")
    known = parsers.hash_embedding(part.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("doc_id"), F.col("p_type").alias("text"))).select(F.col("doc_id").alias("tag"), "vector")
    rows = part.select(F.col("p_partkey").alias("tag"), F.col("p_name").alias("name")).join(known, "tag", "left")
    found = tags.embedded(rows, parsers.hash_embedding, 64)
    return found.select("tag", "name", "added", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 5).alias("sum"), F.array_position("vector", F.array_max("vector")).alias("most"))
