"""Folds on a stream against the same folds on the whole table."""

import datetime

import pytest
from pyspark.sql import functions as F

from sparkmere.operators import rerank, serving
from sparkmere.streaming import folding

SOURCE = "/root/testdata/sf0.001/events.parquet"
LAST = datetime.datetime(2100, 1, 1)


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", folding.STORE)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def streamed(spark, tmp_path, rows, make):
    """The rows that a stream gives for several files, read one at a time, and a last row that lets the watermark pass all others."""
    parts = 4
    for k in range(parts):
        rows.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows.drop("part").limit(1).withColumns({"ts": F.lit(LAST), "key": F.lit(-1).cast("long")}).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running = make(source).writeStream.format("memory").queryName("folds").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    running.processAllAvailable()
    running.stop()
    return spark.sql("SELECT * FROM folds WHERE key >= 0")


def events(spark):
    """Calls of the events table, dealt into four files within an hour of their time; every ninth call comes twice."""
    own = spark.read.parquet(SOURCE).select(F.col("user_id").alias("key"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").cast("long").alias("event_id"), (F.col("event_type") == "error").alias("failed"))
    own = own.withColumn("key", (F.col("key") % 20).cast("long"))
    span = own.agg(F.min(F.unix_timestamp("ts")).alias("a"), F.max(F.unix_timestamp("ts")).alias("b")).head()
    moved = F.unix_timestamp("ts") - span.a + F.pmod(F.xxhash64("event_id"), F.lit(3600)) - 1800
    part = F.least(F.lit(3), F.greatest(F.lit(0), F.floor(moved * 4 / (span.b - span.a + 1)))).cast("int")
    return own.unionByName(own.where("event_id % 9 = 0")).withColumn("part", part)


def test_limiter_on_a_stream(spark, tmp_path, rocks):
    rows = events(spark).drop("failed")
    found = streamed(spark, tmp_path, rows, lambda s: folding.limited_stream(s, 172_800, 3, "2 hours"))
    want = rerank.limited(rows, 172_800, 3)
    got = sorted((r.key, r.event_id, r.allowed) for r in found.collect())
    assert got == sorted((r.key, r.event_id, r.allowed) for r in want.collect()) and {r[2] for r in got} == {True, False}


def test_breaker_on_a_stream(spark, tmp_path, rocks):
    rows = events(spark).drop("event_id")
    found = streamed(spark, tmp_path, rows, lambda s: folding.breaker_stream(s, "2 hours", 2, 200_000.0))
    want = serving.breaker(rows.select("key", F.unix_timestamp("ts").cast("double").alias("at"), "failed"), 2, 200_000.0)
    got = sorted((r.key, r.at, r.failed, r.state) for r in found.collect())
    assert got == sorted((r.key, r.at, r.failed, r.state) for r in want.collect()) and {r[3] for r in got} >= {"ok", "failed"}
