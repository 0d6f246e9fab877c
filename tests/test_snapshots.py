"""Generations: builds that fail, swaps, retirements, and reads that don't follow a swap."""

import datetime

import pytest
from pyspark.sql import functions as F

from sparkmere.plans import snapshots

DAY = datetime.datetime(2024, 1, 1)


def tables(spark, n):
    nodes = spark.range(n).withColumnRenamed("id", "node_id")
    return {"nodes": nodes, "edges": nodes.selectExpr("node_id AS src", "node_id + 1 AS dst"), "vectors": nodes.withColumn("vector", F.array(F.lit(1.0)))}


def refused(reason, step, *given, **named):
    with pytest.raises(snapshots.Refused) as told:
        step(*given, **named)
    assert told.value.reason == reason


def test_generations(spark, tmp_path):
    store = snapshots.Generations(spark, str(tmp_path))
    refused("no_such_kb", store.swap, "a")
    refused("no_such_kb", store.read, "a")
    refused("missing_table:vectors", store.build_shadow, "a", {"nodes": spark.range(1), "edges": spark.range(1)}, "b0")
    assert store.build_shadow("a", tables(spark, 5), "b1", DAY) == 1
    refused("no_active_generation", store.resolve, "a")
    refused("shadow_exists", store.build_shadow, "a", tables(spark, 5), "b2")
    assert store.swap("a", DAY) == (None, 1) and store.resolve("a") == 1
    refused("no_shadow", store.swap, "a")
    refused("no_shadow", store.resolve, "a", "shadow")
    bad = tables(spark, 7) | {"vectors": spark.range(3).select(F.raise_error(F.lit("no disk")).cast("string").alias("x"))}
    with pytest.raises(Exception, match="no disk"):
        store.build_shadow("a", bad, "b3", DAY)
    refused("no_ready_shadow", store.swap, "a")
    refused("not_ready", store.read, "a", "shadow")
    assert store.resolve("a", "active") == 1 and store.read("a")["nodes"].count() == 5  # the failed build left it alone
    refused("is_shadow", store.retire, "a", 2)
    assert store.cancel("a") == 2
    refused("no_such_generation", store.resolve, "a", "g2")
    assert store.build_shadow("a", tables(spark, 9), "b4", DAY) == 3
    held = store.read("a")
    assert store.read("a", "shadow")["nodes"].count() == 9 and store.resolve("a", "G3") == 3
    assert store.swap("a", DAY + datetime.timedelta(hours=30)) == (1, 3)
    assert held["nodes"].count() == 5 and store.read("a")["nodes"].count() == 9  # a reader keeps what it resolved
    assert store.read("a", 1)["edges"].count() == 5
    refused("is_active", store.retire, "a", 3)
    refused("no_such_generation", store.retire, "a", 8)
    refused("too_young", store.retire, "a", 1, now=DAY + datetime.timedelta(hours=23))
    store.retire("a", 1, now=DAY + datetime.timedelta(hours=25))
    refused("retired", store.read, "a", 1)
    refused("not_ready", store.retire, "a", 1)
    refused("invalid_selector", store.resolve, "a", "newest")
    refused("invalid_selector", store.resolve, "a", 0)
    assert store.build_shadow("b", tables(spark, 2), "b5", DAY) == 1 and store.resolve("a") == 3
    told = {r.kb: (r.active, r.shadow) for r in snapshots.pointers(store.log).collect()}
    assert told == {"a": (3, None), "b": (None, 1)}
    assert [r.event for r in snapshots.ordered_log(store.log).where("kb = 'a'").orderBy("step").collect()] == ["shadow_started", "shadow_ready", "swapped", "shadow_started", "shadow_failed", "cancelled", "shadow_started", "shadow_ready", "swapped", "retired"]


def test_incomplete_tables_are_refused(spark, tmp_path):
    store = snapshots.Generations(spark, str(tmp_path))
    store.build_shadow("a", tables(spark, 5), "b1")
    spark.range(2).withColumnRenamed("id", "node_id").write.mode("append").parquet(store.path("a", 1, "nodes"))
    refused("incomplete_table:nodes", store.read, "a", "shadow")


def test_replayed(spark):
    schema = "query_id long, rank int, node_id long"
    before = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 7)], schema)
    after = spark.createDataFrame([(1, 1, 5), (1, 2, 8), (3, 1, 9)], schema)
    assert sorted(tuple(r) for r in snapshots.replayed(before, after).collect()) == [(1, 2, 2, 1, 1 / 3, True), (2, 1, 0, 0, 0.0, False), (3, 0, 1, 0, 0.0, False)]
