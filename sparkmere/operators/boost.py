"""A query's vector moved towards its tags, as one staged plan: each stage adds its rows, and a query that has left takes no part in the stages that follow.

Pyramid levels give seeds, spikes through the cooccurrence graph give energies and emergent tags, core tags that are missing and ghost tags join, near-equal
tags are merged, and their weighted mean is fused with the query. A query that leaves keeps its vector and the reason.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmere.functions.vectors import of_one_length
from sparkmere.operators import pyramid, tags
from sparkmere.plans.saving import saved

# Fixed values of the boost.
LEVEL_DECAY = 0.7
EMERGENT = 50
ACTIVATION = (0.5, 1.5)
DEDUP, TRANSFER = 0.88, 0.2
FACTOR = (0.3, 2.0)
SEEDS, LEAST_SIM = 8, 0.3
#: Why a query's vector stays as it is.
MATRIX, VECTORS, NO_SEEDS, CONTEXT, ALPHA, FUSED = "matrix_missing", "no_tag_vectors", "no_seeds", "degenerate_context", "zero_alpha", "degenerate_fused"


def _fused(base: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["weight", "tag"], ascending=[False, True])
        query, kept = np.asarray(rows["query"].iloc[0], float), []
        for tag, weight, vector in zip(rows["tag"], rows["weight"], rows["vector"], strict=True):
            vector = np.asarray(vector, float)
            length = np.linalg.norm(vector)
            unit = vector / length if length >= 1e-9 else np.zeros_like(vector)
            into = next((k for k in kept if k[2] @ unit > DEDUP), None)
            if into is None:
                kept.append([tag, weight, unit, vector])
            else:
                into[1] += TRANSFER * weight
        total = sum(max(k[1], 0.0) for k in kept)
        context = sum((k[3] * (k[1] / total) for k in kept if k[1] > 0), np.zeros_like(query)) if total > 0 else np.zeros_like(query)
        length, reason, moved = np.linalg.norm(context), None, query
        alpha = min(1.0, max(0.0, base * min(FACTOR[1], max(FACTOR[0], rows["dynamic"].iloc[0]))))
        if length < 1e-9:
            reason = CONTEXT
        elif alpha <= 0:
            reason = ALPHA
        else:
            mixed = (1 - alpha) * query + alpha * context / length
            if np.linalg.norm(mixed) < 1e-9:
                reason = FUSED
            else:
                moved = mixed / np.linalg.norm(mixed)
        own = {"query_id": rows["query_id"].iloc[0], "boosted": moved.tolist(), "reason": reason, "alpha": 0.0 if reason else alpha, "matched": [k[0] for k in kept]}
        return pd.DataFrame([own])

    return run


def worlds(queries: DataFrame, axes: np.ndarray, mean: np.ndarray, labels: list[str]) -> DataFrame:
    """query_id, entropy, logic_depth, resonance, world: where each query's energy lies on the axes; the world is the strongest axis' label."""
    p = pyramid.projection(queries, axes, mean)
    h = pyramid.entropy(F.col("p"), len(axes))
    best = F.array_position("p", F.array_max("p")).cast("int")
    return p.select("query_id", h.alias("entropy"), F.greatest(F.lit(0.0), 1 - h).alias("logic_depth"), tags.resonance(F.col("p")).alias("resonance"), F.element_at(F.array(*map(F.lit, labels)), best).alias("world"))


def _skipped(queries: DataFrame, reason: str) -> DataFrame:
    none = F.lit(None)
    return queries.select(
        "query_id", "vector", F.lit(reason).alias("reason"), F.lit(0.0).alias("alpha"), F.lit(0).cast("long").alias("seeds"), F.lit(0).cast("long").alias("emergent"),
        F.lit(0).cast("long").alias("core_added"), F.lit(0).cast("long").alias("ghosts"), F.array().cast("array<long>").alias("matched"), none.cast("double").alias("activation"), none.cast("string").alias("world"),
    )


def apply_tag_boost(queries: DataFrame, tag_rows: DataFrame, cooc: DataFrame, basis: tuple[np.ndarray, np.ndarray], labels: list[str], base: float = 0.5, core: DataFrame | None = None, ghosts: DataFrame | None = None, residuals: DataFrame | None = None, resonant: bool = False, scale: float = 1.0, floor: float = 0.0) -> DataFrame:
    """query_id, vector, reason, alpha, seeds, emergent, core_added, ghosts, matched, activation, world of every query (query_id, vector).

    tag_rows: tag, name, vector; cooc: src, dst, weight; basis: axes and mean of the energy basis, with a label for each axis; core: query_id, tag (name in lower
    case), see tags.core_tags; ghosts: query_id, ghosts (array of hard, vector); residuals: tag, residual. reason is null where the vector moved. A query
    has a bounded number of tags: those of its levels, EMERGENT further ones, its core tags and its ghosts.
    """
    queries = saved(queries.select("query_id", "vector"))
    if cooc.isEmpty():
        return _skipped(queries, MATRIX)
    if tag_rows.isEmpty():
        return _skipped(queries, VECTORS)
    spark = queries.sparkSession
    named = tag_rows.select("tag", F.lower(F.trim("name")).alias("key"), "name", "vector")
    core = spark.createDataFrame([], "query_id long, tag string") if core is None else core
    usable = of_one_length(queries, len(basis[1]))
    levels = saved(pyramid.pyramid_levels(usable, tag_rows.select(F.col("tag").alias("node_id"), "vector"), residuals))
    features = pyramid.pyramid_features(levels)
    state = saved(worlds(usable, *basis, labels).join(features, "query_id", "left"))
    factor = tags.core_boost(F.col("logic_depth"), F.coalesce("coverage", F.lit(0.0)), F.lit(0.5))  # a relevance of one half is a factor of 1
    state = saved(state.withColumn("factor", factor))
    core_rows = core.select("query_id", F.col("tag").alias("key"), F.lit(True).alias("core")).distinct()
    # Stage 1: the tags of the levels, weighed.
    each = levels.select("query_id", "level", F.explode(F.arrays_zip("tags", "sims", "coefficients")).alias("x")).select("query_id", "level", F.col("x.tags").alias("tag"), F.col("x.sims").alias("sim"), F.col("x.coefficients").alias("coefficient"))
    each = each.join(named.select("tag", "key", "name"), "tag").join(state.select("query_id", "logic_depth", "coverage", "world"), "query_id").join(core_rows, ["query_id", "key"], "left")
    own = F.when(F.col("core"), tags.core_boost(F.col("logic_depth"), F.col("coverage"), F.col("sim"))).otherwise(1.0)
    weight = F.col("coefficient") * F.pow(F.lit(LEVEL_DECAY), F.col("level")) * tags.language_penalty(F.col("name"), F.col("world")) * own
    seeds = saved(each.select("query_id", "tag", weight.alias("energy")).where("energy > 0"))
    # Stage 2: energies of all tags with a vector; seeds, and the strongest of the others.
    energies = tags.spike(seeds, cooc, residuals).join(named.select("tag"), "tag", "left_semi").join(seeds.select("query_id", "tag", F.col("energy").alias("own")), ["query_id", "tag"], "left")
    energies = energies.select("query_id", "tag", F.greatest("energy", F.coalesce("own", F.lit(0.0))).alias("weight"), F.col("own").isNotNull().alias("seed"))
    order = F.row_number().over(Window.partitionBy("query_id", "seed").orderBy(F.desc("weight"), "tag"))
    held = saved(energies.withColumn("k", order).where(F.col("seed") | (F.col("k") <= EMERGENT)).drop("k"))
    counts = held.groupBy("query_id").agg(F.count_if("seed").alias("seeds"), F.count_if(~F.col("seed")).alias("emergent"), F.max("weight").alias("most"))
    # Stage 3: core tags that are missing, and ghosts, at the weight of the strongest.
    present = held.select("query_id", "tag").join(named.select("tag", "key"), "tag").select("query_id", "key")
    missing = core_rows.select("query_id", "key").join(present, ["query_id", "key"], "left_anti").join(named.groupBy("key").agg(F.max("tag").alias("tag")), "key").join(counts.select("query_id", F.col("most").alias("weight")), "query_id")
    added = saved(missing.select("query_id", "tag", "weight"))
    vectors = held.select("query_id", "tag", "weight").unionByName(added).join(named.select("tag", "vector"), "tag").select("query_id", "tag", "weight", "vector")
    n_ghosts = spark.createDataFrame([], "query_id long, ghosts long")
    if ghosts is not None:
        haunting = ghosts.join(counts.select("query_id"), "query_id", "left_semi")
        haunting = tags.ghost_candidates(haunting, vectors.select("query_id", "weight"), state.select("query_id", "factor"), len(basis[1]))
        haunting = saved(haunting.select("query_id", "tag", "weight", "vector"))
        vectors = vectors.unionByName(haunting)
        n_ghosts = haunting.groupBy("query_id").agg(F.count(F.lit(1)).alias("ghosts"))
    # Stage 4: merge, mean, fuse.
    mult = ACTIVATION[0] + F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("activation", F.lit(0.0)))) * (ACTIVATION[1] - ACTIVATION[0])
    jumps = F.log(1 + F.greatest(F.lit(0.0), F.col("resonance"))) if resonant else F.lit(0.0)
    dynamic = F.greatest(F.lit(floor), F.col("logic_depth") * (1 + jumps) / (1 + 0.5 * F.col("entropy")) * mult * scale)
    asked = queries.select("query_id", F.col("vector").alias("query")).join(state.select("query_id", dynamic.alias("dynamic")), "query_id")
    moved = vectors.join(asked, "query_id").groupBy("query_id").applyInPandas(_fused(base), "query_id long, boosted array<double>, reason string, alpha double, matched array<long>")
    found = queries.join(moved, "query_id", "left").join(counts.drop("most"), "query_id", "left").join(added.groupBy("query_id").agg(F.count(F.lit(1)).alias("core_added")), "query_id", "left")
    found = found.join(n_ghosts, "query_id", "left").join(state.select("query_id", "activation", "world"), "query_id", "left")
    left = F.col("boosted").isNull()
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("seeds", "emergent", "core_added", "ghosts")]
    return found.select("query_id", F.coalesce("boosted", "vector").alias("vector"), F.when(left, NO_SEEDS).otherwise(F.col("reason")).alias("reason"), F.coalesce("alpha", F.lit(0.0)).alias("alpha"), *numbers, F.coalesce("matched", F.array().cast("array<long>")).alias("matched"), "activation", "world")
