"""Tables that cut lineage: written to the folder that all executors share, and read from there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def _new_path(spark: SparkSession) -> str:
    """A new place in the folder that spark.checkpoint.dir names.

    Where that is unset, a folder is made for a driver whose executors run within it (tests, a laptop); a cluster's executors wouldn't see it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def new_folder(spark: SparkSession) -> str:
    """A new place in the shared folder, for tables that are kept together."""
    return _new_path(spark)


def saved(df: DataFrame, by: str | None = None) -> DataFrame:
    """Compute df once and cut its lineage by a table in the shared checkpoint folder.

    Any executor reads the table, so losing executors costs no rows. A written table also resets size estimates: those of checkpoint() are inherited, and
    over rounds of joins they grow into numbers that take longer to multiply than the joins take. Tables lie in a folder of the application, which can go
    when it ends. With by, rows lie in a folder for each value of that column.
    """
    path = _new_path(df.sparkSession)
    df.write.partitionBy(*([by] if by else [])).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved_one_by_one(parts: Iterable[DataFrame]) -> DataFrame:
    """One saved table of the rows of all parts, which are computed one after the other."""
    path = None
    for df in parts:
        path = path or _new_path(df.sparkSession)
        df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved_in_buckets(df: DataFrame, key: str) -> DataFrame:
    """As saved, in buckets by key: what is grouped or joined by key later leaves these rows where they are. Rows are not shuffled for it."""
    spark = df.sparkSession
    buckets = min(100_000, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"buckets_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", _new_path(spark)).bucketBy(buckets, key).saveAsTable(name)
    return spark.table(name)
