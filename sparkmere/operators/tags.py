"""The tag graph: positions, cooccurrence, neighbours, spike propagation and rerank by tag energy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmere.plans.saving import saved

# Fixed values of the tag graph's behaviour.
FIRST_WEIGHT, WEIGHT_RANGE = 0.9, 0.4
MIN_TAGS, MAX_TAGS = 2, 100
LEGACY_WEIGHT = 0.49
HOPS, FIRING, SYNAPSES = 4, 0.10, 20
WORMHOLE, WORMHOLE_DECAY, DECAY, LEAST = 1.0, 0.70, 0.25, 0.01


def position_weight(position: Column, n: Column) -> Column:
    """0.9 for the first of n tags falling to 0.5 for the last."""
    return FIRST_WEIGHT - WEIGHT_RANGE * (position - 1) / F.greatest(F.lit(1), n - 1)


def cooccurrence(positions: DataFrame) -> DataFrame:
    """src, dst, weight of the directed graph from earlier to later tags of a manual; manuals of 2 to 100 tags count.

    A manual's pairs are bounded by MAX_TAGS; they are summed before they are shuffled.
    """
    counted = positions.where("position > 0").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("manual"))).where(F.col("n").between(MIN_TAGS, MAX_TAGS))
    weighted = counted.select("manual", "tag", "position", position_weight(F.col("position"), F.col("n")).alias("phi"))
    a = weighted.select("manual", F.col("tag").alias("src"), F.col("position").alias("p1"), F.col("phi").alias("phi1"))
    b = weighted.select("manual", F.col("tag").alias("dst"), F.col("position").alias("p2"), F.col("phi").alias("phi2"))
    pairs = a.join(b, "manual").where("p1 < p2")
    return pairs.groupBy("src", "dst").agg(F.sum(F.col("phi1") * F.col("phi2")).alias("weight"))


def legacy_cooccurrence(positions: DataFrame) -> DataFrame:
    """src, dst, weight in both directions for tags of a manual of which one has no position (0)."""
    sized = positions.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("manual"))).where(F.col("n").between(MIN_TAGS, MAX_TAGS))
    a = sized.select("manual", F.col("tag").alias("t1"), F.col("position").alias("p1"))
    b = sized.select("manual", F.col("tag").alias("t2"), F.col("position").alias("p2"))
    counts = a.join(b, "manual").where("t1 < t2 and (p1 = 0 or p2 = 0)").groupBy("t1", "t2").agg((F.count(F.lit(1)) * LEGACY_WEIGHT).alias("weight"))
    return counts.select(F.col("t1").alias("src"), F.col("t2").alias("dst"), "weight").unionByName(counts.select(F.col("t2").alias("src"), F.col("t1").alias("dst"), "weight"))


def top_neighbours(cooc: DataFrame, n: int) -> DataFrame:
    """tag, neighbour, weight, rank: each tag's strongest neighbours by the greater of both directions."""
    both = cooc.where("src != dst").select(F.col("src").alias("tag"), F.col("dst").alias("neighbour"), "weight")
    both = both.unionByName(both.select(F.col("neighbour").alias("tag"), F.col("tag").alias("neighbour"), "weight"))
    best = both.groupBy("tag", "neighbour").agg(F.max("weight").alias("weight"))
    rank = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("weight"), "neighbour"))
    return best.withColumn("rank", rank).where(F.col("rank") <= n)


def orphans(tags: DataFrame, used: DataFrame) -> DataFrame:
    """The tags (tag, ...) that no manual uses."""
    return tags.join(used.select("tag"), "tag", "left_anti")


def spike(seeds: DataFrame, cooc: DataFrame, residuals: DataFrame | None = None, hops: int = HOPS, momentum: float = 2.0) -> DataFrame:
    """query_id, tag, energy after spikes from seeds (query_id, tag, energy) through the cooccurrence graph.

    A tag fires with energy FIRING and no negative momentum, along its SYNAPSES strongest edges. An edge whose weight times the target's residual reaches
    WORMHOLE keeps more energy and costs no momentum. Energies of a target add up, of its momenta the greatest counts; seeds keep their own energy. Each hop is written once.
    """
    order = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    synapses = cooc.withColumn("k", order).where(F.col("k") <= SYNAPSES).drop("k")
    if residuals is not None:
        synapses = synapses.join(residuals.select(F.col("tag").alias("dst"), "residual"), "dst", "left")
    else:
        synapses = synapses.withColumn("residual", F.lit(1.0))
    synapses = saved(synapses.select("src", "dst", "weight", (F.col("weight") * F.coalesce("residual", F.lit(1.0)) >= WORMHOLE).alias("wormhole")))
    pulse = saved(seeds.select("query_id", "tag", "energy", F.lit(momentum).alias("momentum")).where("energy > 0"))
    every = pulse.select("query_id", "tag", "energy")
    for _ in range(hops):
        firing = pulse.where((F.col("energy") >= FIRING) & (F.col("momentum") >= 0)).withColumnRenamed("tag", "src")
        sent = firing.join(synapses, "src").select(
            "query_id", F.col("dst").alias("tag"),
            (F.col("energy") * F.col("weight") * F.when(F.col("wormhole"), WORMHOLE_DECAY).otherwise(DECAY)).alias("energy"),
            (F.col("momentum") - F.when(F.col("wormhole"), 0.0).otherwise(1.0)).alias("momentum"), "wormhole",
        ).where((F.col("energy") >= LEAST) & (F.col("wormhole") | (F.col("momentum") >= 0)))
        pulse = saved(sent.groupBy("query_id", "tag").agg(F.sum("energy").alias("energy"), F.max("momentum").alias("momentum")))
        every = every.unionByName(pulse.select("query_id", "tag", "energy"))
    return every.groupBy("query_id", "tag").agg(F.sum("energy").alias("energy"))


def geodesic_rerank(results: DataFrame, node_tags: DataFrame, energies: DataFrame, share: float = 0.3, least_hits: int = 2) -> DataFrame:
    """query_id, node_id, score, geo, final, old_rank, new_rank: results (query_id, node_id, score) reranked by the mean energy of their tags.

    Fewer hit tags than least_hits give 0; without any energy a query keeps its order.
    """
    hits = results.join(node_tags, "node_id").join(energies, ["query_id", "tag"])
    geo = hits.groupBy("query_id", "node_id").agg(F.avg("energy").alias("mean"), F.count(F.lit(1)).alias("hits"))
    own = Window.partitionBy("query_id")
    joined = results.join(geo, ["query_id", "node_id"], "left").withColumn("geo", F.when(F.col("hits") >= least_hits, F.col("mean")).otherwise(0.0))
    most = F.max("geo").over(own)
    final = F.when(most > 0, (1 - share) * F.col("score") + share * F.col("geo") / most).otherwise(F.col("score"))
    joined = joined.withColumn("final", final)
    rank = [F.row_number().over(own.orderBy(F.desc(c), "node_id")).alias(n) for c, n in (("score", "old_rank"), ("final", "new_rank"))]
    return joined.select("query_id", "node_id", "score", "geo", "final", *rank)


def rerank_swaps(reranked: DataFrame, k: int) -> DataFrame:
    """query_id, rank_changed, new_entry, lost_entry: how the first k rows of each query differ before and after (old_rank, new_rank)."""
    before, after = F.col("old_rank") <= k, F.col("new_rank") <= k
    kinds = {"rank_changed": before & after & (F.col("old_rank") != F.col("new_rank")), "new_entry": after & ~before, "lost_entry": before & ~after}
    return reranked.groupBy("query_id").agg(*(F.count_if(c).alias(n) for n, c in kinds.items()))


# Fixed values of the boost's modulators.
BRIDGE = 0.15
CORE_BOOST = (1.20, 1.40)
TECH_TAG, TECH_WORLD, SOCIAL_WORLD = r"^[A-Za-z0-9\-_.\s]+$", r"^[A-Za-z0-9\-_.]+$", r"(?i)politics|society|history|economics|culture"
UNKNOWN_PENALTY, OTHER_PENALTY = 0.4, 0.3


def resonance(energies: Column) -> Column:
    """The sum of the bridges between the strongest axis and the others: geometric means of their energies above BRIDGE."""
    ordered = F.sort_array(energies, asc=False)
    bridges = F.filter(F.transform(F.slice(ordered, 2, F.greatest(F.size(ordered), F.lit(1))), lambda e: F.sqrt(F.greatest(F.lit(0.0), F.get(ordered, 0) * e))), lambda x: x > BRIDGE)
    return F.aggregate(bridges, F.lit(0.0), lambda s, x: s + x)


def core_tags(asked: DataFrame, policy: DataFrame) -> DataFrame:
    """query_id, tag: the core tags (query_id, name) that a caller names, in lower case, as canonical tags by policy (name, canonical), each once."""
    own = asked.select("query_id", F.lower(F.trim("name")).alias("name")).where("name <> ''").distinct()
    return own.join(policy, "name", "left").select("query_id", F.coalesce(F.lower(F.trim("canonical")), "name").alias("tag")).distinct()


def core_boost(depth: Column, coverage: Column, relevance: Column) -> Column:
    """A core tag's factor, from the query's depth, the pyramid's coverage and the tag's own relevance, each clipped to 0 .. 1."""

    def clip(x: Column) -> Column:
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))

    metric = clip(0.5 * F.greatest(F.lit(0.0), depth) + 0.5 * (1 - clip(coverage)))
    return (CORE_BOOST[0] + metric * (CORE_BOOST[1] - CORE_BOOST[0])) * (0.95 + 0.10 * clip(relevance))


def with_core(candidates: DataFrame, core: DataFrame, factors: DataFrame) -> DataFrame:
    """query_id, tag, weight, core: candidates whose core tags weigh more by their query's factor (query_id, factor), and the core tags that are missing,
    with the query's greatest weight, or its factor if it has no candidate."""
    marked = candidates.join(core.withColumn("core", F.lit(True)), ["query_id", "tag"], "left").join(factors, "query_id", "left")
    weighed = marked.select("query_id", "tag", F.when(F.col("core").isNotNull(), F.col("weight") * F.coalesce("factor", F.lit(1.0))).otherwise(F.col("weight")).alias("weight"), F.col("core").isNotNull().alias("core"))
    most = weighed.groupBy("query_id").agg(F.max("weight").alias("most"))
    missing = core.join(candidates, ["query_id", "tag"], "left_anti").join(most, "query_id", "left").join(factors, "query_id", "left")
    return weighed.unionByName(missing.select("query_id", "tag", F.coalesce("most", "factor", F.lit(1.0)).alias("weight"), F.lit(True).alias("core")))


def ghost_candidates(ghosts: DataFrame, weighed: DataFrame, factors: DataFrame, dims: int) -> DataFrame:
    """query_id, tag, weight, hard, vector of ghost tags (query_id, ghosts: array of hard boolean and vector): ids -1, -2, ... in their order.

    Those of another dimension are skipped. A soft ghost weighs as much as the greatest candidate before the query's factor, a hard one the factor more.
    """
    base = weighed.join(factors, "query_id", "left").groupBy("query_id").agg(F.max(F.col("weight") / F.coalesce("factor", F.lit(1.0))).alias("base"))
    fitting = ghosts.select("query_id", F.posexplode(F.filter("ghosts", lambda g: F.size(g["vector"]) == dims)).alias("place", "ghost"))
    joined = fitting.join(base, "query_id", "left").join(factors, "query_id", "left")
    weight = F.coalesce("base", F.lit(1.0)) * F.when(F.col("ghost.hard"), F.coalesce("factor", F.lit(1.0))).otherwise(1.0)
    return joined.select("query_id", (-1 - F.col("place")).cast("long").alias("tag"), weight.alias("weight"), F.col("ghost.hard").alias("hard"), F.col("ghost.vector").alias("vector"))


def language_penalty(tag: Column, world: Column) -> Column:
    """The factor of a tag that is technical noise (ASCII, longer than three) for the query's world: none in a technical world."""
    noise = tag.rlike(TECH_TAG) & (F.length(tag) > 3)
    known = F.coalesce(F.trim(world), F.lit("Unknown"))
    unknown = known.isin("", "Unknown")
    return (
        F.when(~unknown & known.rlike(TECH_WORLD), 1.0).when(~noise, 1.0).when(unknown, UNKNOWN_PENALTY)
        .when(known.rlike(SOCIAL_WORLD), OTHER_PENALTY**0.5).otherwise(OTHER_PENALTY)
    )


def skip_reason(enabled: Column, has_matrix: Column, tag_vectors: Column, seeds: Column, candidates: Column, context: Column, alpha: Column) -> Column:
    """Why a query's boost is left out: the first stage that has nothing to go on; null if it applies."""
    return (
        F.when(~enabled, "spike_disabled").when(~has_matrix, "matrix_missing").when(tag_vectors == 0, "no_tag_vectors").when(seeds == 0, "no_seeds")
        .when(candidates == 0, "no_candidates").when(context <= 0, "degenerate_context").when(alpha <= 0, "zero_alpha")
    )


def embedded(tags: DataFrame, embed: Callable[[DataFrame], DataFrame], dims: int) -> DataFrame:
    """tag, name, vector, added: tags (tag, name, vector) whose vector is missing get one of their name; the others are left alone.

    embed makes vectors (doc_id, vector) of texts (doc_id, text); one of another dimension than dims fails the task rather than being kept.
    """
    missing = tags.where("vector IS NULL").select(F.col("tag").alias("doc_id"), F.col("name").alias("text"))
    made = embed(missing).select(F.col("doc_id").alias("tag"), F.when(F.size("vector") == dims, F.col("vector")).otherwise(F.raise_error(F.lit("a vector of another dimension"))).alias("made"))
    joined = tags.join(made, "tag", "left")
    return joined.select("tag", "name", F.coalesce("vector", "made").alias("vector"), (F.col("vector").isNull() & F.col("made").isNotNull()).alias("added"))
