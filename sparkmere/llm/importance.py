"""Target-distribution importance resampling over hashed n-grams, in two Arrow passes.

Pass 1 counts the features of all documents, and of all target texts, into BUCKETS buckets: each task adds np.bincount vectors up and gives one, and treeReduce
merges these. A bucket's gain is the logarithm of how much more frequent it is in the target. Pass 2 gathers the broadcast gains (one number a bucket) of every
feature and sums them by document with np.bincount. A document's score is its mean gain with Gumbel noise that hangs on its doc_id only, so that
the highest scores are a draw without replacement by importance, the same at every run.

Ranks come from ranges of (score, doc_id) with a row a range for their borders: no task holds more than a range.

Cases: null and empty texts have no features and weight 0; a null doc_id has the noise of an empty one and comes last among ties; repeated rows are
drawn by themselves; without target texts gains follow from the documents alone; an empty table gives no rows; other columns are left aside, whatever
their names.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmere.llm.common import free_names, saved
from sparkmere.llm.words import plain_words, slices

BUCKETS = 10_000
#: Features are runs of 1 to LONGEST words.
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
SCORED = "n_words long, n_features long, weight long, score long"


def features(data: np.ndarray, offsets: np.ndarray, buckets: int, longest: int):
    """(n_words of each text, and for each length: the bucket of each feature and its text)."""
    words, _, _, places = plain_words(data, offsets)
    found = []
    for n in range(1, longest + 1):
        count = len(words) - n + 1
        if count <= 0:
            break
        joined = words if n == 1 else pc.binary_join_element_wise(*(words[k : count + k] for k in range(n)), pa.scalar(b" ", pa.large_binary()))
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(places))[:count]
        whole = np.arange(count) + n <= places[text + 1]  # of one text
        coded = joined.dictionary_encode()
        bucket = np.array([zlib.crc32(w) % buckets for w in coded.dictionary.to_pylist()], np.int64)
        found.append((bucket[coded.indices.to_numpy()][whole], text[whole]))
    return np.diff(places), found


def _counted(buckets: int, longest: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                for bucket, _ in features(data, offsets, buckets, longest)[1]:
                    total += np.bincount(bucket, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How often the features of each bucket occur in all texts."""
    parts = texts.select("text").mapInArrow(_counted(buckets, longest), "counts binary").rdd.map(lambda r: np.frombuffer(r["counts"], np.int64))
    tasks = parts.getNumPartitions()
    if not tasks:
        return np.zeros(buckets, np.int64)
    depth = 2 + (tasks > 10_000)  # the last step merges a root of the number of tasks on the driver
    zero = texts.sparkSession.sparkContext.parallelize([np.zeros(buckets, np.int64)], 1)
    return parts.union(zero).treeReduce(np.add, depth)


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much more frequent each bucket is in the target, with one added to each count."""
    buckets = len(target)
    t_all, s_all = float(target.sum() + buckets), float(source.sum() + buckets)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for t, s in zip(target.tolist(), source.tolist(), strict=True)], np.int64)


def noise(doc_id, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(held, longest: int, seed: int):
    """SCORED of each row behind its other columns; the last two columns are doc_id and text."""

    def run(batches):
        gain = held.value
        for batch in batches:
            n = batch.num_rows
            n_words, n_features, total = (np.zeros(n, np.int64) for _ in range(3))
            for low, high, data, offsets in slices(batch.column(batch.num_columns - 1)):
                n_words[low:high], found = features(data, offsets, len(gain), longest)
                for bucket, text in found:
                    n_features[low:high] += np.bincount(text, minlength=high - low)
                    total[low:high] += np.bincount(text, weights=gain[bucket], minlength=high - low).astype(np.int64)
            weight = np.where(n_features > 0, total // np.maximum(n_features, 1), 0)
            score = weight + np.array([noise(i, seed) for i in batch.column(batch.num_columns - 2).to_pylist()], np.int64)
            columns = [pa.array(c) for c in (n_words, n_features, weight, score)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *columns], names=[*batch.schema.names[:-2], *(c.split(" ")[0] for c in SCORED.split(", "))])

    return run


def scored(docs: DataFrame, target: DataFrame, keep: list[str], buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """The columns keep of docs and SCORED, whose names keep must not hold."""
    found = gains(bucket_counts(target, buckets, longest), bucket_counts(docs, buckets, longest))
    held = docs.sparkSession.sparkContext.broadcast(found)
    kept = [F.col(f"`{c}`") for c in keep]
    schema = T.StructType(docs.select(*kept).schema.fields + T.StructType.fromDDL(SCORED).fields)
    return docs.select(*kept, F.col("doc_id").alias("asked_id"), F.col("text").alias("asked_text")).mapInArrow(_scored(held, longest, seed), schema)


def ranked(rows: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """rows (doc_id, SCORED) with rank: 1, 2, 3 ... of the drawn ones, null of all others."""
    rows = saved(rows.withColumn("long", F.col("n_words") >= least_words).withColumn("row", F.monotonically_increasing_id()))
    draws = percent * rows.where("long").count() // 100
    keys = [F.desc("long"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    ranged = saved(rows.repartitionByRange(*keys).withColumn("range", F.spark_partition_id()))
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("rows"))  # a row a range
    before = F.coalesce(F.sum("rows").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*keys)) + F.col("before")
    placed = ranged.join(F.broadcast(sizes.select("range", before.alias("before"))), "range").withColumn("place", place.cast("long"))
    return placed.withColumn("rank", F.when(F.col("long") & (F.col("place") <= draws), F.col("place"))).drop("long", "row", "range", "before", "place")


def resampling_report(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row."""
    rows = ranked(scored(docs, target, ["doc_id"], buckets, longest, seed), least_words, percent)
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def resampled_documents(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """The drawn rows of docs. Texts aren't shuffled: the last drawn row is a border, and all rows down to it stay; rows that equal it in score and
    doc_id stay with it, though the share may end between them."""
    names = [f"column_{k}" for k in range(len(docs.columns))]
    (doc_id,) = (n for n, c in zip(names, docs.columns, strict=True) if c.lower() == "doc_id")
    wide = docs.toDF(*names).withColumns({"doc_id": F.col(doc_id), "text": F.col(names[[c.lower() for c in docs.columns].index("text")])})
    rows = saved(ranked(scored(docs, target, ["doc_id"], buckets, longest, seed), least_words, percent))
    last = rows.where("rank IS NOT NULL").orderBy(F.desc("rank")).limit(1).head()
    every = scored(wide, target, [*names, "doc_id"], buckets, longest, seed)
    if last is None:
        return every.where("false").select(*names).toDF(*docs.columns)
    own = F.col("doc_id")
    tie = F.lit(True) if last["doc_id"] is None else F.coalesce(own <= last["doc_id"], F.lit(False))
    drawn = every.where((F.col("n_words") >= least_words) & ((F.col("score") > last["score"]) | (F.col("score") == last["score"]) & tie))
    return drawn.select(*names).toDF(*docs.columns)
