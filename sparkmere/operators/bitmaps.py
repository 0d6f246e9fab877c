"""A bitmap index of node metadata: which nodes have which value of which field, and how many have several at once.

Node ids are dealt into buckets of 32,768 (Spark's bitmap functions). Of a value's nodes in a bucket the index keeps the places, or, from DENSE nodes on, a
bitmap of 4 KB, whichever is smaller: a value of its own for every node takes a few bytes a node. Counting the nodes under a set of filters is a bitwise
"and" by bucket; nodes and filters aren't joined row by row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmere.plans.saving import saved

#: From so many nodes on a bitmap is smaller than a list of places.
DENSE = 1024


def metadata_pairs(nodes: DataFrame, normal, scalars: Sequence[str] = (), lists: Mapping[str, str] | None = None, attributes: str | None = None) -> DataFrame:
    """node_id, field, value, normal: every value that a node has, once.

    scalars are columns, lists maps a field to an array column (tags), attributes names a map column from names to arrays, whose values count under their name
    and under ``attributes.`` and their name. normal makes a value's normal form. Null and blank values don't count.
    """

    def pair(field: Column, value: Column) -> Column:
        return F.struct(field.cast("string").alias("field"), value.cast("string").alias("value"))

    def listed(field: str, column: str) -> Column:
        return F.transform(F.coalesce(F.col(column).cast("array<string>"), F.array().cast("array<string>")), lambda v: pair(F.lit(field), v))

    parts = [F.array(*(pair(F.lit(c), F.col(c)) for c in scalars))] if scalars else []
    parts += [listed(field, column) for field, column in (lists or {}).items()]
    if attributes:
        entries = F.coalesce(F.map_entries(attributes), F.array().cast("array<struct<key: string, value: array<string>>>"))
        parts.append(F.flatten(F.transform(entries, lambda e: F.flatten(F.transform(F.coalesce(e["value"], F.array().cast("array<string>")), lambda v: F.array(pair(e["key"], v), pair(F.concat(F.lit("attributes."), e["key"]), v)))))))
    rows = nodes.select("node_id", F.explode(F.concat(*parts)).alias("x")).select("node_id", "x.field", "x.value").where("node_id IS NOT NULL AND value IS NOT NULL AND trim(value) <> ''")
    return rows.withColumn("normal", normal(F.col("value"))).where("normal <> ''").groupBy("node_id", "field", "normal").agg(F.min("value").alias("value"))


def bitmap_index(pairs: DataFrame) -> DataFrame:
    """field, normal, bucket, n, places, bits of pairs (node_id, field, normal), saved; either places or bits is null."""
    keys = ["field", "normal", "bucket"]
    placed = pairs.select("field", "normal", F.bitmap_bucket_number("node_id").alias("bucket"), F.bitmap_bit_position("node_id").cast("int").alias("place"))
    placed = saved(placed)
    dense = saved(placed.groupBy(*keys).agg(F.bitmap_construct_agg("place").alias("bits")).withColumn("n", F.bitmap_count("bits")).where(F.col("n") >= DENSE))
    sparse = placed.join(dense.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.array_sort(F.collect_set("place")).alias("places"))  # fewer than DENSE
    nothing = F.lit(None)
    sparse = sparse.select(*keys, F.size("places").cast("long").alias("n"), "places", nothing.cast("binary").alias("bits"))
    return saved(sparse.unionByName(dense.select(*keys, "n", nothing.cast("array<int>").alias("places"), "bits")))


def as_bitmaps(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, bits: the union of the bitmaps of rows of an index with equal keys."""
    lists = rows.where("places IS NOT NULL").select(*keys, F.explode("places").alias("place")).groupBy(*keys).agg(F.bitmap_construct_agg("place").alias("bits"))
    return rows.where("bits IS NOT NULL").select(*keys, "bits").unionByName(lists).groupBy(*keys).agg(F.bitmap_or_agg("bits").alias("bits"))


def count_under(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """key, n: how many nodes have, of each field that a key asks for, one of the values (wanted: key, field, normal). Keys without a node are left out.

    Keys that ask for the same values are counted once, so that bitmaps are handed on for each different set of values, not for each key.
    """
    sets = saved(wanted.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("field", "normal"))).alias("values")))
    asked = saved(sets.groupBy("values").agg(F.min("key").alias("first")))
    one = asked.select("first", F.explode("values").alias("v")).select("first", "v.field", "v.normal")
    fields = asked.select("first", F.size(F.array_distinct(F.col("values.field"))).alias("fields"))
    each = as_bitmaps(index.join(one, ["field", "normal"]), "first", "field", "bucket")
    both = each.groupBy("first", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("met")).join(fields, "first").where("met = fields")
    counts = both.groupBy("first").agg(F.sum(F.bitmap_count("bits")).alias("n")).where("n > 0")
    return sets.join(asked.join(counts, "first"), "values").select("key", "n")
