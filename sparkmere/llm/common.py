"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import os
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmere.plans.saving import saved, saved_in_buckets, saved_one_by_one  # noqa: F401

#: The white space that separates words in every operator here.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Within it, jobs hand rows to Python in batches of so many at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def parts(batches, rows: int = 2000):
    """Batches in slices of so many rows at most, so that what is made of a slice doesn't lie in memory for a whole batch."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def released() -> None:
    """Give free memory of this process back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trimmed(run):
    """run, a function over batches, after which its worker gives memory back: workers live on, and stay as large as they were, while others need it."""

    def trimming(*given):
        try:
            yield from run(*given)
        finally:
            released()

    return trimming


#: Bits of a filter that is a literal of a plan, at most.
MOST_BITS = 2**23


def filter_bits(hashes: DataFrame) -> bytes:
    """A bitmap of hashes (hash long), of 16 bits a hash up to MOST_BITS, for may_hold. Spark sets the bits; words of 64 of them come to the driver."""
    bits = min(MOST_BITS, max(1024, 1 << (16 * hashes.count()).bit_length()))
    at = F.pmod("hash", F.lit(bits))
    words = hashes.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 AS int))")).alias("set"))
    found = bytearray(bits // 8)
    for r in words.toLocalIterator():
        found[8 * r["word"] : 8 * r["word"] + 8] = (r["set"] % 2**64).to_bytes(8, "little")
    return bytes(found)


def may_hold(bits: bytes, hash_: Column) -> Column:
    """Whether a hash may be one of those of a bitmap; it is not where this is false."""
    at = F.pmod(hash_, F.lit(8 * len(bits)))
    byte = F.conv(F.hex(F.substring(F.lit(bits), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (at % 8).cast("int")) == 1


def without(docs: DataFrame, gone: DataFrame, doc_id: str, hash_: str, text_hash: Column) -> DataFrame:
    """docs without the rows of gone (doc_id and hash_ are its columns, of which hash_ equals text_hash of a text).

    A bitmap of the doc_ids that go lets all other rows pass straight through; the hash of a text is worked out, and rows are joined, only where
    a doc_id may go.
    """
    bits = filter_bits(gone.select(F.xxhash64(doc_id).alias("hash")))
    own, flag = free_names(docs, "own", "flag")
    flagged = docs.withColumn(flag, may_hold(bits, F.xxhash64("doc_id")))
    asked = flagged.where(F.col(flag)).withColumn(own, text_hash)
    match = asked["doc_id"].eqNullSafe(gone[doc_id]) & (asked[own] == gone[hash_])
    return flagged.where(~F.col(flag)).drop(flag).unionByName(asked.join(gone, match, "left_anti").drop(flag, own))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for temporary columns that no column of df has, whatever its case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; SPARKMERE_TOKENIZERS overrides the installed folder."""
    folder = os.environ.get("SPARKMERE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
