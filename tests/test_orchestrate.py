"""The whole search: exact and preselected runs agree where the preselection reaches all, and stay within their reach where it doesn't."""

import numpy as np
from pyspark.sql import functions as F

from sparkmere.operators import graph, orchestrate, preselect, tags
from sparkmere.sources import parsers

WORDS = "pump filter water tank steam hose coffee lid clean error wm-8000 e05 machine".split()


def world(spark, n=120):
    rng = np.random.default_rng(17)
    vectors = rng.normal(size=(n, 10))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = [(k, v.tolist(), " ".join(rng.choice(WORDS, 3)), " ".join(rng.choice(WORDS, 25)), "x" if k % 2 else "wm-8000", "f.pdf", k % 4) for k, v in enumerate(vectors)]
    nodes = spark.createDataFrame(rows, "node_id long, vector array<double>, heading string, body string, identity string, source_file string, label int")
    asked = [(q, " ".join(rng.choice(WORDS, 4)) if q else "", (vectors[q * 3] + 0.2 * rng.normal(size=10)).tolist()) for q in range(6)]
    queries = spark.createDataFrame(asked, "query_id long, text string, vector array<double>")
    edges = graph.both_ways(graph.merged_edges(graph.semantic_edges(nodes, 0.4), graph.consecutive_edges(nodes)))
    return nodes, queries, edges


def ranks(df):
    return sorted((r.query_id, r["rank"], r.node_id, r.score, round(r.prior, 9)) for r in df.collect())


def test_preselection_that_reaches_all_changes_nothing(spark):
    nodes, queries, edges = world(spark)
    index = preselect.coarse_index(nodes, 6)
    anchors = nodes.where("node_id % 10 = 0").select("node_id", F.lit(2.0).alias("boost"), F.lit(1.5).alias("propagation_boost"))
    boost = F.when(F.col("label") == 1, 0.05).otherwise(0.0)
    exact = orchestrate.searched(queries, nodes, edges, 6, approximate=False, anchors=anchors, boost=boost)
    wide = orchestrate.searched(queries, nodes, edges, 6, index, anchors=anchors, boost=boost, candidates=500, probes=6)
    assert ranks(exact) == ranks(wide) and {r["mode"] for r in wide.collect()} == {"ann_preselect_then_wave"} and {r["mode"] for r in exact.collect()} == {"exact_local"}
    some = nodes.where("label <> 0")
    forced = orchestrate.searched(queries, nodes, edges, 6, index, eligible=some, force_exact=True)
    assert {r.reason for r in forced.collect()} == {"filters_force_exact"} and forced.join(nodes.where("label = 0"), "node_id").count() == 0
    assert ranks(forced) == ranks(orchestrate.searched(queries, nodes, edges, 6, approximate=False, eligible=some))
    assert any(r.lexical for r in exact.collect()) and len({r.query_id for r in exact.collect()}) == 6


def test_waves_stay_within_reach(spark):
    nodes, queries, edges = world(spark)
    index = preselect.coarse_index(nodes, 12)
    few = orchestrate.searched(queries, nodes, edges, 40, index, candidates=4, probes=1)
    state, reach = preselect.preselected(queries, nodes, index, k=4, probes=1)
    held = {(r.query_id, r.node_id) for r in reach.collect()}
    assert all((r.query_id, r.node_id) in held or r.lexical for r in few.collect())
    boosted = queries.select("query_id", F.transform("vector", lambda x: -x).alias("vector"))
    assert ranks(orchestrate.searched(queries, nodes, edges, 5, approximate=False, boosted=boosted)) == ranks(orchestrate.searched(queries.drop("vector").join(boosted, "query_id"), nodes, edges, 5, approximate=False))


def test_only_missing_tags_are_embedded(spark):
    rows = spark.createDataFrame([(1, "pump", None), (2, "tank", [1.0] + [0.0] * 63), (3, None, None)], "tag long, name string, vector array<double>")
    found = {r.tag: (r.vector, r.added) for r in tags.embedded(rows, parsers.hash_embedding, 64).collect()}
    want = parsers.hash_embedding(spark.createDataFrame([(1, "pump")], "doc_id long, text string")).head().vector
    assert found[1] == (want, True) and found[2] == ([1.0] + [0.0] * 63, False) and found[3] == ([0.0] * 64, True)


def test_bulk_files(spark):
    from sparkmere.operators import upkeep

    files = spark.createDataFrame([("a", '[{"manual": "m1", "tags": ["X", "y "]}, {"tags": "a;b"}, 7]'), ("b", "{}"), ("c", None), ("d", "[]")], "file string, text string")
    found = [(r.file, r.row, r.manual, r.tags, r.error) for r in upkeep.bulk_array_rows(files).orderBy("file", "row").collect()]
    assert found == [("a", 0, "m1", ["x", "y"], None), ("a", 1, None, ["a", "b"], "MISSING_MANUAL_ID"), ("a", 2, None, [], "INVALID_ROW"), ("b", 0, None, [], "INVALID_ROW"), ("c", 0, None, [], "INVALID_ROW"), ("d", 0, None, [], "INVALID_ROW")]
    lines = spark.createDataFrame([(1, 'm1,"A;b",x'), (2, "m2,a"), (3, "m3,a,x,y"), (4, ",a,x"), (5, None), (6, " ")], "row long, line string")
    found = {r.row: (r.manual, r.tags, r.error) for r in upkeep.bulk_csv_rows(lines, ["manual", "tags", "other"]).collect()}
    assert found[1] == ("m1", ["a", "b"], None) and found[4][2] == "MISSING_MANUAL_ID" and {found[k][2] for k in (2, 3, 5, 6)} == {"INVALID_ROW"}
    cases = spark.createDataFrame([(k, "{broken") for k in range(50)] + [(60, '{"id": "a", "query": "q"}'), (61, '{"id": "a", "query": "q"}'), (62, '{"id": "b", "query": " "}'), (63, '{"query": "q"}')], "row long, line string")
    told = {r.row: r.error for r in upkeep.suite_cases(cases, "id string, query string").collect()}
    assert len(told) == 54 and {told[k] for k in (*range(50), 63)} == {"malformed"} and (told[60], told[61], told[62]) == ("duplicate_id", "duplicate_id", "query")
