"""Small cases of what reviews found, one by one."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkmere import catalogue
from sparkmere.functions.vectors import settled
from sparkmere.operators import bitmaps, graph, lexical, matching, narrowing, orchestrate, search, tags, vectorwave
from sparkmere.sources import parsers
from tests.compare import of_duckdb, of_spark

SF = "/root/testdata/sf0.001"
catalogue.load_all()


def views(folder, **tables):
    """The tables as Parquet files in folder, and DuckDB's views of them."""
    db = duckdb.connect()
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return db


def same(spark, folder, db, name):
    assert of_spark(catalogue.QUERIES[name](spark, str(folder))) == of_duckdb(db, catalogue.ORACLES[name])


def test_pieces_that_end_in_line_ends(spark, tmp_path):
    texts = ["ab " * 166 + "a\n" + "tail", "x" * 499 + " " + "\n" + "y" * 498 + " " + "z" * 30, "\t" + "w " * 400, "one. two"]
    db = views(tmp_path, documents=spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    same(spark, tmp_path, db, "chunk_sentences")


def test_parts_that_share_a_node(spark, tmp_path):
    lines = spark.createDataFrame([(50, 50001), (100, 1), (50, 50001), (150, 2), (100, 50002), (7, 3), (200, 5)], "l_orderkey long, l_partkey long")
    vectors = spark.createDataFrame([(150002, [1.0], 0), (9, [0.5], 1)], "vec_id long, embedding array<float>, label int")
    db = views(tmp_path, lineitem=lines, embeddings=vectors)
    same(spark, tmp_path, db, "vector_load")


def test_vectors_of_every_order_are_loaded(spark, tmp_path):
    lines = spark.createDataFrame([(7, 3), (7, 3), (50, 1), (1, 4), (None, 4), (8, None)], "l_orderkey long, l_partkey long")
    vectors = spark.createDataFrame([(1004, [1.0], 0), (9, [0.5], 1)], "vec_id long, embedding array<float>, label int")
    db = views(tmp_path, lineitem=lines, embeddings=vectors)
    found = catalogue.QUERIES["vector_load"](spark, str(tmp_path)).collect()
    assert sorted((r["node_id"], r["problem"]) for r in found) == [(1004, "loaded"), (7003, "missing"), (50001, "missing")]
    same(spark, tmp_path, db, "vector_load")


def test_keys_meet_the_bases_of_their_realm(spark, tmp_path, monkeypatch):
    """Rows grow with the product of both tables: keys of one file are dealt into tasks by the rows that they make, and decided on once for a name."""
    customers = [(k, k % 3 if k % 10 else None) for k in range(1, 90)] + [(13, 1), (26, 2)]
    suppliers = [(k, k % 4 or None) for k in range(60)] + [(7, 3), (None, 2), (None, 1)]
    tables = {"customer": spark.createDataFrame(customers, "c_custkey long, c_nationkey long"), "supplier": spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey long")}
    db = views(tmp_path, **{name: df.coalesce(1) for name, df in tables.items()})
    monkeypatch.setattr(narrowing, "PAIRS_OF_TASK", 40)
    monkeypatch.setattr(narrowing, "LISTED", 4)
    same(spark, tmp_path, db, "acl_decision")
    found = catalogue.QUERIES["acl_decision"](spark, str(tmp_path))
    made = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(made) > 8 and max(r["count"] for r in made) < found.count() / 4


def test_equal_filters_are_counted_once(spark):
    index = bitmaps.bitmap_index(spark.createDataFrame([(k, "f", "ab"[k % 2]) for k in range(60)] + [(k, "g", "x") for k in range(0, 60, 3)], "node_id long, field string, normal string"))
    wanted = [(q, f, v) for q in range(400) for f, v in ((("f", "a"), ("g", "x")) if q % 2 else (("g", "x"), ("f", "a"), ("f", "b")))]
    seen = []
    plain, bitmaps.as_bitmaps = bitmaps.as_bitmaps, lambda rows, *keys: seen.append(rows.count()) or plain(rows, *keys)
    try:
        found = bitmaps.count_under(spark.createDataFrame(wanted, "key long, field string, normal string"), index).collect()
    finally:
        bitmaps.as_bitmaps = plain
    assert {r["key"]: r["n"] for r in found} == {q: 10 if q % 2 else 20 for q in range(400)}
    assert seen[0] < 20


def vectors_with_odd_ones(spark, n=160):
    rng = np.random.default_rng(5)
    rows = [(k * 3, [float(x) for x in v / np.linalg.norm(v)]) for k, v in enumerate(rng.normal(size=(n, 12)))]
    rows[7] = (21, rows[3][1])
    rows[8], rows[9], rows[10] = (24, None), (27, [1.0] * 5), (30, [float("nan")] * 12)
    return spark.createDataFrame(rows, "node_id long, vector array<double>").repartition(3)


def by_edges(nodes, sims, combine, k, eligible=None, anchors=None):
    ways = graph.both_ways(graph.merged_edges(graph.semantic_edges(nodes, 0.2), graph.consecutive_edges(nodes)))
    if eligible is not None:
        ways = ways.join(eligible.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    found = search.wave(sims, ways, combine, anchors=anchors)
    return search.top_k(found.withColumn("score", settled(F.col("amplitude"))), "score", k).select("query_id", "rank", "node_id", "score")


@pytest.mark.parametrize("case", ["plain", "anchors", "filtered"])
def test_pruned_waves_keep_the_best(spark, case):
    nodes = vectors_with_odd_ones(spark)
    eligible = nodes.where("node_id % 7 < 3") if case == "filtered" else None
    anchors = nodes.where("node_id % 37 = 0").select("node_id", F.lit(2.0).alias("boost"), F.lit(1.9).alias("propagation_boost")) if case == "anchors" else None
    asked = nodes.where("node_id % 12 = 0").select(F.col("node_id").alias("query_id"), "vector")
    sims = search.similarities(asked, nodes if eligible is None else eligible, search.SOURCES)
    found = vectorwave.best_of_wave(sims, nodes, 0.2, 9, eligible, anchors)
    assert of_spark(found) == of_spark(by_edges(nodes, sims, "max", 9, eligible, anchors))


@pytest.mark.parametrize("name", ["wave_search_max", "wave_anchors", "wave_filtered", "wave_search_sum"])
def test_waves_make_no_table_of_edges(spark, monkeypatch, name):
    def refuse(*_):
        raise AssertionError("all edges")

    monkeypatch.setattr(graph, "semantic_edges", refuse)
    assert catalogue.QUERIES[name](spark, SF).count()


def test_edges_are_merged_where_nodes_meet(spark):
    nodes = vectors_with_odd_ones(spark)
    whole = graph.merged_edges(graph.semantic_edges(nodes, 0.2), graph.consecutive_edges(nodes))
    assert of_spark(graph.chunk_edges(nodes, 0.2, block=30)) == of_spark(whole)
    assert of_spark(graph.semantic_edges(nodes, 0.2, block=30)) == of_spark(graph.semantic_edges(nodes, 0.2))


def test_nodes_go_to_few_blocks(spark):
    """Each node goes to as many tasks as there are blocks; 2048 rows a block were too few for large tables."""
    for n, most in ((10_000, 8), (100_000, 8), (600_000, 40)):
        assert -(-n // graph.rows_of_block(n)) <= most


def test_nearest_linked_are_the_best_edges(spark):
    nodes = vectors_with_odd_ones(spark)
    expected = tags.top_neighbours(graph.semantic_edges(nodes, 0.2), 10)
    assert of_spark(search.nearest_linked(nodes, 0.2, 10)) == of_spark(expected.select("tag", "neighbour", "weight", "rank"))


def test_residuals_make_no_table_of_edges(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("all edges")

    monkeypatch.setattr(graph, "semantic_edges", refuse)
    assert catalogue.QUERIES["intrinsic_residuals"](spark, SF).count()


def test_summed_waves(spark):
    nodes = vectors_with_odd_ones(spark)
    asked = nodes.where("node_id % 12 = 0").select(F.col("node_id").alias("query_id"), "vector")
    sims = search.similarities(asked, nodes, search.SOURCES).withColumn("sim", F.col("sim") / 4)  # so that contributions are dropped
    assert of_spark(vectorwave.sum_of_wave(sims, nodes, 0.2, 9)) == of_spark(by_edges(nodes, sims, "sum", 9))


def test_summed_waves_write_no_amplitudes(spark, monkeypatch):
    """Rows of (query, node) and block of sources filled the disk: only seeds are written."""
    nodes, written, plain = vectors_with_odd_ones(spark), [], vectorwave.saved
    monkeypatch.setattr(vectorwave, "saved", lambda df: written.append(df.count()) or plain(df))
    asked = nodes.where("node_id % 12 = 0").select(F.col("node_id").alias("query_id"), "vector")
    found = vectorwave.sum_of_wave(search.similarities(asked, nodes, search.SOURCES), nodes, 0.2, 9)
    assert found.count() and max(written) <= asked.count() * search.SOURCES


@pytest.mark.parametrize("threshold", [0.2, 0.02, -0.1])
def test_steps_of_summed_waves(monkeypatch, threshold):
    monkeypatch.setattr(vectorwave, "SUMMED_TILE", 30)
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(100, 12))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    vectors[13], vectors[14], ids = np.nan, vectors[50], np.arange(100) * 2
    after = np.append(ids[1:], np.iinfo(np.int64).min)
    weights = np.nan_to_num(vectors) @ np.nan_to_num(vectors).T
    weights[~(weights > threshold)] = weights[13] = weights[:, 13] = 0
    weights += graph.CONSECUTIVE * (np.abs(np.subtract.outer(ids, ids)) == 2)
    np.fill_diagonal(weights, 0)
    amplitudes = np.where(rng.random((5, 100)) < 0.3, rng.random((5, 100)) * 0.2, 0)
    more = amplitudes[:, :, None] * np.minimum(weights, 1.0) * search.DECAY
    assert np.allclose(vectorwave._SummedStep(ids, vectors, after, threshold)(amplitudes), np.where(more >= search.CUTOFF, more, 0.0).sum(axis=1), atol=1e-12, rtol=0)


@pytest.mark.parametrize("name", ["wave_lexical_hybrid", "search_orchestrated"])
def test_searches_make_no_table_of_edges(spark, monkeypatch, name):
    def refuse(*_):
        raise AssertionError("all edges")

    monkeypatch.setattr(graph, "chunk_edges", refuse)
    assert catalogue.QUERIES[name](spark, SF).count()


@pytest.mark.parametrize("anchored", [False, True])
def test_lexical_hits_are_reached_by_long_ways(spark, anchored):
    """Hits with high scores count though waves that reach them are weak, and so nothing on their way may be pruned."""
    nodes = vectors_with_odd_ones(spark)
    rng = np.random.default_rng(8)
    anchors = nodes.where("node_id % 15 = 0").select("node_id", F.lit(2.0).alias("boost"), F.lit(1.9).alias("propagation_boost")) if anchored else None
    asked = nodes.where("node_id % 12 = 0 AND node_id <> 24").select(F.col("node_id").alias("query_id"), "vector")
    sims = search.similarities(asked, nodes, search.SOURCES)
    sims = sims.withColumn("sim", F.when(F.col("query_id") % 24 == 0, F.col("sim")).otherwise(F.col("sim") / 6))
    hits = [(q * 12, int(n) * 3, float(rng.choice([0.02, 0.4, 0.9, 1.6])), float(rng.uniform(-0.3, 0.3))) for q in range(1, 9) for n in rng.choice(160, 30, replace=False)]
    lexed = spark.createDataFrame(hits, "query_id long, node_id long, score double, sim double")
    boosts = nodes.select("node_id", F.when(F.col("node_id") % 5 == 0, 0.05).otherwise(0.0).alias("boost"))
    ways = graph.both_ways(graph.merged_edges(graph.semantic_edges(nodes, 0.3), graph.consecutive_edges(nodes)))
    whole = search.hybrid_scores(search.wave(sims, ways, anchors=anchors, lexical=lexed, lexical_sources=2), boosts, lexed, F.col("boost")).withColumn("score", settled(F.col("score")))
    for k in (3, 20, 60):
        found = vectorwave.hybrid_of_wave(sims, vectorwave.Near(nodes, 0.3), k, None, anchors, lexed, 2, boosts)
        assert of_spark(found) == of_spark(vectorwave.with_ties(whole, k).select("query_id", "node_id", "score"))


def test_waves_within_reach_need_no_edges(spark):
    from tests.test_orchestrate import ranks, world

    nodes, queries, edges = world(spark)
    index = orchestrate.preselect.coarse_index(nodes, 12)
    anchors = nodes.where("node_id % 10 = 0").select("node_id", F.lit(2.0).alias("boost"), F.lit(1.5).alias("propagation_boost"))
    for more in ({"index": index, "candidates": 8, "probes": 2, "anchors": anchors}, {"approximate": False, "anchors": anchors}):
        found = [ranks(orchestrate.searched(queries, nodes, e, 6, eligible=nodes.where("label <> 0"), boost=F.when(F.col("label") == 1, 0.05).otherwise(0.0), **more)) for e in (edges, vectorwave.Near(nodes, 0.4))]
        assert found[0] == found[1] and found[0]


def test_best_covered_without_pairs(spark, monkeypatch, tmp_path):
    """Null ids and texts, ids that occur twice, and a join of tokens for the other nodes refused."""
    rows = [(k, f"Pump {k % 7} filter-{k % 5} Tank {'steam ' * (k % 3)}") for k in range(60)] + [(70, None), (None, "pump tank"), (None, "steam"), (5, "tank 3"), (71, "İ \u212aelvin kelvin")]
    nodes = spark.createDataFrame(rows, "node_id long, text string").repartition(3)
    queries = spark.createDataFrame([(1, "pump 3 tank steam"), (2, "Filter-2 kelvin"), (3, None), (4, "nothing"), (5, "tank")], "query_id long, text string")
    monkeypatch.setattr(lexical, "NODES", 16)
    monkeypatch.setattr(lexical, "QUERIES", 2)
    best = lexical.query_coverage(queries, nodes).withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY coverage DESC, node_id)")).where("rank <= 5")
    assert of_spark(lexical.covered_topk(queries, nodes, 5)) == of_spark(best)
    seen = []
    plain = lexical.query_coverage
    monkeypatch.setattr(lexical, "query_coverage", lambda q, n: seen.append(n.count()) or plain(q, n))
    assert lexical.covered_topk(queries, nodes, 5).count() and seen == [4]


class Rows:
    """A batch that can't be made into Python's objects as a whole."""

    def __init__(self, rows):
        self.rows, self.num_rows = rows, len(rows)

    def slice(self, low, n):
        return Rows(self.rows[low : low + n])

    def to_pylist(self):
        assert self.num_rows <= lexical.NODES
        return self.rows


def test_nodes_are_scored_some_at_a_time(monkeypatch):
    held = type("Held", (), {"value": type("Some", (), {"ids": [7]})})
    monkeypatch.setattr(lexical, "_scores", lambda *_: np.array([1.0]))
    monkeypatch.setattr(lexical, "_counts", lambda *_: {"body": (np.zeros(1, int), np.zeros(1, int), np.ones(1, int))})
    batch = Rows([{"node_id": k} for k in range(2000)])
    assert sum(b.num_rows for b in lexical._ranked(held, 0.2, 2)([batch])) == 8
    assert sum(b.num_rows for b in lexical._counted(held)([batch])) == 2000


def test_texts_are_hashed_some_at_a_time():
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "text": [f"pump {k} tank" for k in range(300)]})
    found = list(parsers._hashed(16)([batch]))
    assert max(b.num_rows for b in found) <= parsers.TEXTS < 300 and sum(b.num_rows for b in found) == 300


def test_matches_leave_results_where_they_are(spark):
    """Files of a name are told by a window within the case: results dealt by case are not joined with them by case and name."""
    rows = [(1, 1, "a/x.md"), (1, 2, "b/x.md"), (1, 3, "a/y.md"), (1, 4, "a/y.md"), (2, 1, "b/x.md")]
    results = spark.createDataFrame(rows, "case_id long, rank int, source_file string").selectExpr("*", "'' AS header", "'' AS anchor_key", "'' AS text", "cast(null AS map<string,array<string>>) AS metadata")
    kind = "case_id long, expectation int, source_file string, header string, anchor_key string, needles array<string>, wanted map<string,array<string>>"
    asked = spark.createDataFrame([(c, e, n, None, None, None, None) for c in (1, 2) for e, n in ((1, "x.md"), (2, "y.md"))], kind)
    found = matching.matches(results, asked)
    told = sorted((r.case_id, r.rank, r.expectation, r.matched, r.ambiguous) for r in found.collect() if r.matched or r.ambiguous)
    assert told == [(1, 1, 1, False, True), (1, 2, 1, False, True), (1, 3, 2, True, False), (1, 4, 2, True, False), (2, 1, 1, True, False)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "name#" in plan and not any("hashpartitioning" in line and "name#" in line for line in plan.splitlines())
