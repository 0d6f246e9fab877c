"""Nearest neighbours by inner product from a hash-prefix forest.

Each tree gives a vector a long string of bits, the sides of random hyperplanes on which it lies; a tree is the sorted array of these strings, dealt
to tasks by its first bits, the more of them the more vectors there are, and, in crowded units, into chunks. A query descends to its longest-prefix matches: the strings beside its own
place. Their scores bound its k-th best score from below. Then it ascends in all trees at once, to the longest prefix x with
(1 - p^x)^TREES <= MISS, p being the chance that a vector of that k-th score shares a bit: every vector that shares x bits in any tree is
scored. So the number of candidates follows from the data, not from a cap. Scores are inner products in double precision.

For vectors of unequal length a coordinate is added that makes all equally long, so that angles order as inner products do.

Cases: vectors that are null, zero, of another dimension than most, or hold null or non-finite components, and rows without vec_id, take no part;
of rows with one vec_id the best counts, and as a query the one of the greatest vector; ties go to the smaller vec_id; with k candidates or fewer all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmere.llm.common import saved

TREES = 48
BITS = 60
#: Bits of a unit, at least and at most.
UNIT_BITS = (4, 16)
CHUNK = 8192
BATCH = 1024
PROBE_TREES = 12
PROBE = 12
MISS = 0.06
FOUND = "query_id long, vec_id long, score double"


def _planes(dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((TREES * BITS, dims + 1))


def _matrix(column) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(array), -1)


def _labelled(dims: int, longest: float, seed: int):
    """Adds each vector's string in every tree, as queries and as candidates."""

    def run(batches):
        planes = _planes(dims, seed)
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in (part.slice(k, BATCH) for part in batches for k in range(0, part.num_rows, BATCH)):
            vectors = _matrix(batch.column(1))
            lengths = np.linalg.norm(vectors, axis=1)
            rest = np.sqrt(np.maximum(0.0, longest**2 - lengths**2))
            whole = vectors @ planes[:, :dims].T + rest[:, None] * planes[:, dims]
            out = []
            for signs in (whole, vectors @ planes[:, :dims].T):
                labels = ((signs > 0).reshape(-1, TREES, BITS) * weights).sum(axis=2)
                out.append(pa.ListArray.from_arrays(pa.array(np.arange(0, labels.size + 1, TREES), pa.int32()), pa.array(labels.ravel(), pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *out], names=["vec_id", "embedding", "labels", "query_labels"])

    return run


def _sorted(vectors: pa.Table):
    labels = vectors["label"].to_numpy()
    order = np.argsort(labels, kind="stable")
    return labels[order], vectors["vec_id"].to_numpy()[order], _matrix(vectors["embedding"])[order]


def _best(ids: np.ndarray, matrix: np.ndarray, own: int, query: np.ndarray, k: int):
    """The k best of the candidates; equal vectors get equal scores, so that ties go by vec_id."""
    keep = ids != own
    ids, matrix = ids[keep], matrix[keep]
    rough = matrix @ query
    if len(ids) > k:
        least = np.partition(rough, len(rough) - k)[len(rough) - k]
        keep = rough >= least - 1e-9 * (1 + abs(least))
        ids, matrix = ids[keep], matrix[keep]
    exact = (matrix * query).sum(axis=1)
    order = np.lexsort((ids, -exact))
    order = order[np.sort(np.unique(ids[order], return_index=True)[1])][:k]
    return ids[order], exact[order]


def _search(k: int, descend: bool):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        found = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if queries.num_rows and vectors.num_rows:
            labels, ids, matrix = _sorted(vectors)
            depths = queries["depth"].to_numpy()
            for own, label, depth, query in zip(queries["vec_id"].to_numpy(), queries["label"].to_numpy(), depths, _matrix(queries["embedding"]), strict=True):
                if descend:
                    at = int(np.searchsorted(labels, label))
                    low, high = max(0, at - PROBE), at + PROBE
                else:
                    shift = BITS - int(depth)
                    low = np.searchsorted(labels, (label >> shift) << shift)
                    high = np.searchsorted(labels, ((label >> shift) + 1) << shift)
                best, scores = _best(ids[low:high], matrix[low:high], own, query, k)
                for out, x in zip(found, (np.full(len(best), own), best, scores), strict=True):
                    out.append(x)
        return pa.table({n: np.concatenate(x) for n, x in zip(("query_id", "vec_id", "score"), found, strict=True)})

    return run


def _searched(queries: DataFrame, vectors: DataFrame, k: int, descend: bool) -> DataFrame:
    """The best k in each unit, chunk and tree that a query visits."""
    key = ["tree", "unit", "chunk"]
    queries, vectors = (df.select(*(F.col(c).alias(c) for c in (*key, "vec_id", "label", "embedding", *more))) for df, more in ((queries, ["depth"]), (vectors, [])))
    return queries.groupBy(*key).cogroup(vectors.groupBy(*key)).applyInArrow(_search(k, descend), FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    scores = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by every."""
    sound = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound &= F.exists("embedding", lambda x: x != 0)
    element = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"  # floats travel as they are, and are exact as doubles
    usable = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{element}>")).where(F.col("vec_id").isNotNull() & sound)
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    shapes = usable.groupBy(F.size("embedding").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("longest")).orderBy(F.desc("n"), "dims").head()
    spark = vectors.sparkSession
    if shapes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    usable = usable.where(F.size("embedding") == shapes["dims"])
    labelled = saved(usable.mapInArrow(_labelled(shapes["dims"], shapes["longest"], seed), f"vec_id long, embedding array<{element}>, labels array<long>, query_labels array<long>"))
    unit_bits = min(UNIT_BITS[1], max(UNIT_BITS[0], (shapes["n"] // CHUNK).bit_length()))

    def unit(label):
        return F.shiftright(label, BITS - unit_bits).cast("int")

    def in_trees(rows: DataFrame, labels: str, trees: int) -> DataFrame:
        return rows.select("*", F.posexplode(F.slice(labels, 1, trees)).alias("tree", "label"))

    def dealt(trees: int) -> tuple[DataFrame, DataFrame]:
        rows = in_trees(labelled, "labels", trees).select("vec_id", "embedding", "tree", "label", unit(F.col("label")).alias("unit"))
        counts = rows.groupBy("tree", "unit").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
        if trees << unit_bits <= 200_000:  # so many rows at most
            counts = F.broadcast(counts)
        return rows.join(counts, ["tree", "unit"]).withColumn("chunk", F.pmod(F.xxhash64("vec_id"), "chunks").cast("int")).drop("chunks"), counts

    def visiting(queries: DataFrame, counts: DataFrame) -> DataFrame:
        """Queries at the units and chunks that they visit; above unit_bits these are several."""
        wide = F.greatest(F.lit(0), unit_bits - F.col("depth"))
        queries = queries.withColumn("unit", unit(F.col("label"))).withColumn("wide", wide).withColumn("unit", F.expr("shiftright(unit, wide)"))
        span = F.expr("sequence(cast(shiftleft(unit, wide) as int), cast(shiftleft(unit + 1, wide) - 1 as int))")
        queries = queries.withColumn("unit", F.explode(span)).drop("wide")
        queries = queries.join(counts, ["tree", "unit"])
        return queries.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

    asked = labelled.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max(F.struct("embedding", "query_labels")).alias("one"))
    asked = asked.select("vec_id", "one.embedding", "one.query_labels")
    rows, counts = dealt(PROBE_TREES)
    descended = visiting(in_trees(asked, "query_labels", PROBE_TREES).withColumn("depth", F.lit(unit_bits)), counts)
    first = saved(_top(_searched(descended, rows, k, True), k))
    least = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("least") / (length * float(shapes["longest"]))))
    shares = 1 - F.acos(cosine) / np.pi
    wanted = 1 - MISS ** (1 / TREES)
    depth = F.floor(F.log(F.lit(wanted)) / F.log(F.least(shares, F.lit(1 - 1e-9))))
    depth = F.when((F.col("n") < k) | F.col("n").isNull() | (shares <= 0.5), 0).otherwise(F.least(depth, F.lit(BITS))).cast("int")
    deep = asked.join(least, F.col("vec_id") == F.col("query_id"), "left").withColumn("depth", depth).select("vec_id", "embedding", "query_labels", "depth")
    rows, counts = dealt(TREES)
    ascended = visiting(in_trees(deep, "query_labels", TREES), counts)
    # At depth 0 one tree holds every vector.
    ascended = ascended.where((F.col("depth") > 0) | (F.col("tree") == 0))
    found = _searched(ascended, rows, k, False).unionByName(first.select("query_id", "vec_id", "score"))
    return _top(found, k).select("query_id", "rank", "vec_id", "score")
