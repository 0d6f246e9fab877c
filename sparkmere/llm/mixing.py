"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are dealt, by hash, into blocks. A source whose target is t times its size takes every block floor(t) times, and
further blocks in a permuted order until its target is met; of the block at the border single documents are taken, the largest that still fit first.
Documents longer than the words still wanted are passed over; while words are wanted after the border, the blocks behind it are drawn likewise, ROUNDS
times at most, each time without the documents that don't fit any more.
The splitting tree deals these draws among output shards: at each node the exact block quotas of all sources are split between two halves by a
multivariate hypergeometric draw, so that every leaf has its number of blocks and, over all leaves, every source has exactly its quota. Draws are numbered
in permuted order, and a shard's quota is a range of numbers, so that shards are disjoint. Within a shard rows are in hash order.

The driver holds numbers per source and per (source, shard), no documents. A source of n rows has about sqrt(n) / 8 blocks of 8 sqrt(n) rows, so that
neither the window over its blocks nor the rows of the one block at its border, which are settled in one task, are many.

Cases: null texts have size 0 and are taken 0 words; a null source is a source, the last; null doc_ids are dealt by their text; repeated rows
are dealt like any; sources of size 0 have target 0; an empty table gives no rows; other columns are left aside.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmere.llm.common import free_names, saved, word_count

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_REPEATS = 2.0
ROUNDS = 6
#: Words wanted that are left so, as a share of the target.
NEAR = 0.002
SHARDS = 16
#: A shard is written by several tasks, each of which holds a part of its hashes: about so many rows.
PART_ROWS = 50_000


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, most: float = MOST_REPEATS) -> list[float]:
    """share of all sizes by weight; none above most times its size, the excess going to the others by weight."""
    left, open_, found = share * sum(sizes), list(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        whole = sum(weights[k] for k in open_)
        full = [k for k in open_ if left * weights[k] / whole > most * sizes[k]]
        if not full:
            for k in open_:
                found[k] = left * weights[k] / whole
            break
        for k in full:
            found[k] = most * sizes[k]
        left -= sum(found[k] for k in full)
        open_ = [k for k in open_ if k not in full]
    return found


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """shards x sources: the block quotas dealt by the splitting tree; columns sum to quotas, rows differ by one at most in their sums."""
    random = np.random.default_rng(seed)
    total = int(quotas.sum())
    leaf = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(low: int, high: int, own: np.ndarray) -> None:
        if high - low == 1:
            out[low] = own
            return
        middle = (low + high) // 2
        want = int(leaf[low:middle].sum())
        first = random.multivariate_hypergeometric(own, want, method="marginals") if len(own) else own
        split(low, middle, first)
        split(middle, high, own - first)

    split(0, shards, quotas.astype(np.int64))
    return out


def _fitting(rows: pa.Table) -> pa.Table:
    """row, size of one source's block at the border that are taken: the largest documents first, as long as they fit into the words still wanted."""
    rows = rows.sort_by([("size", "descending"), ("hash", "ascending"), ("row", "ascending")])
    left, taken = rows["left"][0].as_py(), []
    for k, size in enumerate(rows["size"].to_pylist()):
        if size <= left:
            taken.append(k)
            left -= size
    return rows.select(["source_no", "row", "size"]).take(pa.array(taken, pa.int64()))


def _table(spark, rows: list, schema: str) -> DataFrame:
    """A table with a row for each source; broadcast if small."""
    found = spark.createDataFrame(rows, schema)
    return F.broadcast(found) if len(rows) <= 100_000 else found


def _extra(dealt: DataFrame, blocks: DataFrame, wanted: dict[int, float]) -> tuple[list[DataFrame], list[DataFrame], dict[int, int]]:
    """The extra draws of the sources (source_no -> words wanted): wholly drawn blocks (source_no, block, most: the largest document), rows of border
    blocks (row), and for each source the place of its last block that is drawn from."""
    spark = dealt.sparkSession
    state = {k: (left, 0) for k, left in wanted.items() if left > 0}  # words wanted, place of the last border
    near = {k: NEAR * left for k, left in wanted.items()}
    whole, single, last = [], [], {}
    for _ in range(ROUNDS):
        if not state:
            break
        about = _table(spark, [(k, left, place) for k, (left, place) in state.items()], "source_no int, left double, past long")
        open_ = dealt.join(blocks, ["source_no", "block"]).join(about, "source_no").where("place > past AND size > 0 AND size <= left")
        sums = open_.groupBy("source_no", "block", "place", "left").agg(F.sum("size").alias("block_size"))
        before = F.coalesce(F.sum("block_size").over(Window.partitionBy("source_no").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sums = saved(sums.withColumn("before", before).where("before < left").withColumn("border", F.col("before") + F.col("block_size") > F.col("left")))
        border = sums.where("border").select("source_no", "block", (F.col("left") - F.col("before")).alias("left"))  # one row a source at most
        rows = dealt.select("row", "source_no", "block", "size", "hash").where("size > 0").join(border.hint("broadcast") if len(state) <= 100_000 else border, ["source_no", "block"])
        fitted = saved(rows.where("size <= left").select("source_no", "row", "size", "hash", "left").groupBy("source_no").applyInArrow(_fitting, "source_no int, row long, size long"))
        whole.append(sums.where("NOT border").select("source_no", "block", F.col("left").alias("most")))
        single.append(fitted.select("row"))
        fits = {r["source_no"]: r["size"] for r in fitted.groupBy("source_no").agg(F.sum("size").alias("size")).collect()}
        ends = F.max(F.when(F.col("border"), F.col("place"))).alias("border"), F.max("place").alias("last"), F.sum(F.when(~F.col("border"), F.col("block_size"))).alias("size")
        before_, state = state, {}
        for r in sums.groupBy("source_no").agg(*ends).collect():
            k = r["source_no"]
            last[k] = r["last"]
            left = before_[k][0] - (r["size"] or 0) - fits.get(k, 0)
            if r["border"] and left > near[k]:
                state[k] = (left, r["border"])
    return whole, single, last


def whole_hash(docs: DataFrame, seed: int) -> Column:
    """A hash of all columns of a row."""
    maps = {f.name for f in docs.schema.fields if "map<" in f.dataType.simpleString()}  # which can't be hashed themselves
    parts = [F.to_json(F.struct(F.col(f"`{c}`"))) if c in maps else F.col(f"`{c}`") for c in docs.columns]
    return F.xxhash64(F.lit(seed), *parts)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, shards: int = SHARDS, seed: int = 7, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, hash, size, source_size, target, copies, taken, shards and the columns keep: the decision about every row."""
    spark = docs.sparkSession
    mixed = F.xxhash64(F.lit(seed), "doc_id", "text")
    rows = saved(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"), mixed.alias("hash"), *(F.col(c).alias(f"kept_{k}") for k, c in enumerate(keep))))
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()  # a row for each source
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["size"]) for r in found]
    wanted = targets(sizes, [weights[k % len(weights)] for k in range(len(found))])
    passes = [int(wanted[k] // sizes[k]) if sizes[k] else 0 for k in range(len(found))]
    about = [(r["source"], k, sizes[k], wanted[k], passes[k], max(1, math.isqrt(r["n"]) // 8)) for k, r in enumerate(found)]
    about = _table(spark, about, "source string, source_no int, source_size long, target double, whole int, blocks long")
    block = F.pmod("hash", F.col("blocks"))  # by content, so that reruns agree
    dealt = rows.join(about, rows["source"].eqNullSafe(about["source"])).drop("source").withColumn("block", block).drop("blocks")
    order = Window.partitionBy("source_no").orderBy(F.xxhash64(F.lit(seed + 1), "source_no", "block"), "block")
    blocks = saved(dealt.select("source_no", "block").distinct().withColumn("place", F.row_number().over(order).cast("long")))
    drawn_whole, drawn_single, last = _extra(dealt, blocks, {k: wanted[k] - passes[k] * sizes[k] for k in range(len(found))})
    # Whole passes come first, then the permuted extra blocks up to the last one that is drawn from.
    n = {r["source_no"]: r["n"] for r in blocks.groupBy("source_no").agg(F.count(F.lit(1)).alias("n")).collect()}
    quotas = np.array([n.get(k, 0) * passes[k] + last.get(k, 0) for k in range(len(found))], np.int64)
    ends = np.cumsum(split_quotas(quotas, shards, seed), axis=0)
    bounds = _table(spark, [(k, n.get(k, 0), [int(x) for x in ends[:, k]]) for k in range(len(found))], "source_no int, n long, ends array<long>")
    none = spark.createDataFrame([], "source_no int, block long, most double")
    most = reduce(DataFrame.unionByName, drawn_whole, none)
    blocks = blocks.join(most, ["source_no", "block"], "left").join(bounds, "source_no")
    single = reduce(DataFrame.unionByName, drawn_single, spark.createDataFrame([], "row long")).withColumn("single", F.lit(True))
    every = dealt.join(blocks, ["source_no", "block"]).join(single, "row", "left")
    more = F.coalesce(F.col("single"), F.col("size").between(1, F.col("most")), F.lit(False)).cast("int")
    copies = F.col("whole") + more
    number = F.transform(F.sequence(F.lit(0), F.col("whole")), lambda i: i * F.col("n") + F.col("place") - 1)
    shard_of = F.slice(F.transform(number, lambda x: F.size(F.filter("ends", lambda e: e <= x))), F.lit(1), F.col("copies"))
    every = every.withColumn("copies", copies).withColumn("shards", shard_of)
    return every.select("doc_id", "hash", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "shards", *(F.col(f"kept_{k}").alias(c) for k, c in enumerate(keep)))


def mixed_documents(docs: DataFrame, shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """The mix: a row for each copy that is taken, with the columns of docs, dealt by output shard and in hash order within it.

    Documents that the mix doesn't reach, and documents without words of a source that is taken in part, are left out.
    """
    own, whole, key, hash_, shard, part, n = free_names(docs, "own", "whole", "key", "hash_", "shard", "part", "n")
    marked = docs.withColumn(whole, whole_hash(docs, seed))
    decided = mix(marked, shards=shards, seed=seed, keep=[whole]).select(F.col("doc_id").alias(key), F.col("hash").alias(hash_), F.col(whole).alias(f"{whole}_"), "shards")
    decided = saved(decided)
    keys = [key, hash_, f"{whole}_"]
    marked = marked.withColumn(own, F.xxhash64(F.lit(seed), "doc_id", "text"))

    def match(other: DataFrame) -> Column:
        return marked["doc_id"].eqNullSafe(other[key]) & (marked[own] == other[hash_]) & (marked[whole] == other[f"{whole}_"])

    repeated = saved(decided.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1).select(*keys))
    if not repeated.isEmpty():  # of rows that are equal in every column one stands for all; their decisions are added up below
        once = marked.join(repeated, match(repeated), "left_semi").dropDuplicates(["doc_id", own, whole])
        marked = marked.join(repeated, match(repeated), "left_anti").unionByName(once)
    draws = saved(decided.select(*keys, F.explode("shards").alias(shard)).groupBy(*keys, shard).agg(F.count(F.lit(1)).alias(n)))
    parts = max(1, -(-draws.count() // (shards * PART_ROWS)))
    taken = marked.join(draws, match(draws))
    dealt = taken.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), n))).withColumn(part, F.pmod(hash_, F.lit(parts))).repartition(shard, part)
    return dealt.sortWithinPartitions(shard, hash_).select(*(f"`{c}`" for c in docs.columns))


def mixing_report(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "shards")
