"""Exact deduplication with a two-pass Bloom filter.

Pass 1 counts, in saturating cells (0, 1, 2 or more), the hashes of the normalised texts. Pass 2 looks every hash up: a text that
occurs twice has raised all its cells to 2, so a row with a smaller cell is unique and passes straight through. Only the other rows,
a few per cent beyond the true copies, are grouped, by the SHA-256 of the text. What is grouped are slim rows; texts are never shuffled.

The filter has CELLS_PER_ROW cells a row up to MOST_CELLS (a bit each, 32 MB, the most that is broadcast). More than 16 million rows go through it in
rounds: slim rows are dealt to rounds by their hash, each round's rows lie in a folder of their own and have a filter of their own, so that every row is
read once and the filter is as empty as for few rows. Cells are merged in streams, one range of cells at a time, so that a task holds a few ranges only.

Cases: null texts count as empty and are copies of each other; of rows with equal text the smallest doc_id stays, null doc_ids last; of wholly equal
rows exactly one stays; an empty table gives no rows; other columns are left aside, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmere.llm.common import SPACE, filter_bits, free_names, may_hold, saved, saved_one_by_one, without

CELLS_PER_ROW = 16
MOST_CELLS = 2**28
RANGE = 2**18


def cells_of(hashes: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of each hash; cells is a power of two."""
    h = hashes.view(np.uint64)
    return (h & np.uint64(cells - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(cells - 1)).astype(np.int64)


def _counted(cells: int):
    """Of each batch: by range of cells, the cells that were hit, and whether more than once."""

    def run(batches):
        for batch in batches:
            first, second = cells_of(batch.column(0).to_numpy(), cells)
            both = np.concatenate([first, second[second != first]])  # a row raises a cell once
            hit, times = np.unique(both, return_counts=True)
            ranges, starts = np.unique(hit // RANGE, return_index=True)
            parts = list(zip(starts, [*starts[1:], len(hit)], strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ranges, pa.int32()), pa.array([(hit[a:b] % RANGE).astype("<u4").tobytes() for a, b in parts], pa.binary()), pa.array([(times[a:b] > 1).tobytes() for a, b in parts], pa.binary())],
                names=["range", "cells", "twice"],
            )

    return run


def _merged(batches):
    """The bits of the cells with 2 or more, of each range that comes to this task."""
    counts: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, cells, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at = counts.setdefault(k, np.zeros(RANGE, np.uint8))
            where = np.frombuffer(cells, "<u4")
            at[where] = np.minimum(at[where] + 1 + np.frombuffer(twice, np.bool_), 2)
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array([np.packbits(c > 1).tobytes() for c in counts.values()], pa.binary())], names=["range", "bits"])


def _flagged(bits, cells: int):
    """Adds whether a row's hash may occur again."""

    def run(batches):
        held = np.unpackbits(np.frombuffer(bits.value, np.uint8)).view(np.bool_)
        for batch in batches:
            first, second = cells_of(batch.column("hash").to_numpy(), cells)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held[first] & held[second])], names=[*batch.schema.names, "again"])

    return run


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, row, text_sha256, hash of every row, with the white space of its text made single."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), f"{SPACE}+", " ")
    slim = docs.select("doc_id", text.alias("text"))
    return slim.select("doc_id", F.monotonically_increasing_id().alias("row"), F.sha2("text", 256).alias("text_sha256"), F.xxhash64("text").alias("hash"))


def _filtered(slim: DataFrame, rows: int) -> DataFrame:
    """slim, of about so many rows, with a column again, by one filter."""
    cells = min(MOST_CELLS, max(RANGE, 1 << (max(rows * CELLS_PER_ROW, 1) - 1).bit_length()))
    parts = slim.select("hash").mapInArrow(_counted(cells), "range int, cells binary, twice binary")
    merged = parts.repartition(max(1, min(cells // RANGE, 256)), "range").mapInArrow(_merged, "range int, bits binary")
    bits = bytearray(cells // 8)
    for r in merged.toLocalIterator():
        bits[r["range"] * RANGE // 8 : (r["range"] + 1) * RANGE // 8] = r["bits"]
    held = slim.sparkSession.sparkContext.broadcast(bytes(bits))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema)
    return slim.mapInArrow(_flagged(held, cells), f"{schema}, again boolean")


def possibly_repeated(slim: DataFrame) -> DataFrame:
    """slim with a column again; false only where the hash occurs once. slim has been saved."""
    rows = slim.count()
    rounds = max(1, -(-rows * CELLS_PER_ROW // MOST_CELLS))
    if rounds == 1:
        return _filtered(slim, rows)
    dealt = saved(slim.withColumn("round", F.pmod(F.xxhash64("hash"), F.lit(rounds)).cast("int")), by="round")
    return saved_one_by_one(_filtered(dealt.where(F.col("round") == k).drop("round"), -(-rows // rounds)) for k in range(rounds))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    rows = possibly_repeated(saved(hashed(docs)))
    own = F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("row"))
    unique = rows.where(~F.col("again")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = rows.where("again")
    # Saved, so that the join below deals both sides anew and a group with very many copies is split among tasks.
    groups = saved(maybe.groupBy("text_sha256").agg(F.min(own).alias("first"), F.count(F.lit(1)).alias("group_size")))
    copies = maybe.join(groups, "text_sha256").select("doc_id", F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256")
    return unique.unionByName(copies)


def kept_documents(docs: DataFrame) -> DataFrame:
    """docs without the copies: of each group of equal texts the row of the smallest doc_id, with all its columns.

    Of rows with equal doc_id and text one stays, any, if that doc_id stays.
    """
    duplicates = exact_duplicates(docs)
    own, key, sha, same = free_names(docs, "own", "key", "sha", "same")
    out = duplicates.where(~F.col("kept")).select(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias(same))
    out = saved(out.distinct())
    if out.isEmpty():
        return docs
    text_sha = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), f"{SPACE}+", " "), 256)
    left = without(docs, out.select(key, sha), key, sha, text_sha)
    repeated = saved(out.where(F.col(same)).select(key, sha))
    if not repeated.isEmpty():
        bits = filter_bits(repeated.select(F.xxhash64(key).alias("hash")))
        marked = docs.where(may_hold(bits, F.xxhash64("doc_id"))).withColumn(own, text_sha)
        match = marked["doc_id"].eqNullSafe(repeated[key]) & (marked[own] == repeated[sha])
        left = left.unionByName(marked.join(repeated, match, "left_semi").dropDuplicates(["doc_id", own]).drop(own))
    return left
