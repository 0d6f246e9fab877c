"""Readers of the driver's tables and the views of them that stand for knowledge-base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, vector (double), label: one node for each embedding."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


def tag_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """manual, tag, position: the parts of an order as its tags, each once, in order of first line; positions count from 1."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("manual"), F.col("l_partkey").alias("tag")).agg(F.min("l_linenumber").alias("line"))
    place = F.row_number().over(Window.partitionBy("manual").orderBy("line", "tag"))
    return lines.select("manual", "tag", place.alias("position"))


def manuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """manual, status, category, brand, nation: orders with their customers as manual records."""
    orders, customer, nation = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(F.col("o_orderkey").alias("manual"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("category"), F.col("c_mktsegment").alias("brand"), F.col("n_name").alias("nation"))
