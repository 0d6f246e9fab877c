"""Benchmark decontamination: a broadcast hash set of the benchmark's n-grams, and a scan of all windows of the documents.

Words are runs of digits, letters and characters beyond ASCII, with A-Z made small. Of each benchmark item every run of WINDOW words is a window; an item of
fewer words is one window as a whole. Document words are numbered by the benchmark's vocabulary, all windows of a text are hashed at once from these numbers,
looked up in a bitmap, then in the sorted hashes, and verified number by number against the benchmark's words: a hash decides nothing by itself.

What is broadcast is bounded: ROUND_BYTES of normalised benchmark text make one table. A larger benchmark is dealt into rounds of pieces, by hash; each
round scans the documents, and only the hits of each distinct text, found by its SHA-256, are merged. Within one round nothing is shuffled.

Cases: null and empty texts have no words; an item without words has no windows; items of equal id are one item, an item of null id marks words but is
neither counted nor listed; repeated rows and null doc_ids are judged like any; an empty benchmark hits nothing; an empty table gives no rows; other columns
are left aside, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmere.llm.common import free_names, saved, saved_one_by_one
from sparkmere.llm.words import PLAIN_WORD, lowered, plain_words, slices

WINDOW = 10
ROUND_BYTES = 16_000_000
#: Windows of an item that lie in one piece.
PIECE = 4096
#: Odd numbers that hash word numbers and their places.
STEP, PLACE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
FOUND = "n_words long, n_hit long, firsts array<int>, ends array<int>, items array<string>"


class Windows:
    """The distinct windows of some pieces (item, words), found by hash."""

    def __init__(self, pieces: list[tuple[str | None, list[str]]], window: int = WINDOW):
        numbers: dict[str, int] = {}
        names: dict[str, int] = {}
        places: dict[bytes, int] = {}  # of each distinct window, where it first stands in the stream
        holders: list[set[int]] = []
        stream, at, lengths = [np.zeros(0, np.int32)], 0, []
        for item, words in pieces:
            own = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int32)
            length = min(window, len(own))
            for k in range(len(own) - length + 1 if length else 0):
                key = own[k : k + length].tobytes()
                if key not in places:
                    places[key] = len(holders)
                    holders.append(set())
                    lengths.append((at + k, length))
                if item is not None:
                    holders[places[key]].add(names.setdefault(item, len(names)))
            stream.append(own)
            at += len(own)
        self.vocabulary = pa.array([w.encode() for w in numbers], pa.large_binary())
        self.items = np.array(list(names), object)
        self.stream = np.concatenate(stream)
        starts, sizes = np.array(lengths, np.int64).reshape(-1, 2).T
        hashes = np.zeros(len(holders), np.uint64)
        for length, total in self._hashes(lambda j: self.stream[np.minimum(starts + j, at - 1)], set(sizes.tolist())):
            hashes[sizes == length] = total[sizes == length]
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.starts, self.lengths = hashes[order], starts[order], sizes[order]
        self.ends = np.cumsum([len(holders[k]) for k in order], dtype=np.int64)
        self.holders = np.array([i for k in order for i in holders[k]], np.int32)
        self.most = int(np.unique(self.hashes, return_counts=True)[1].max()) if holders else 0
        bits = max(10, min(25, (64 * len(holders)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.marks = np.zeros(1 << bits, np.bool_)
        self.marks[(self.hashes >> self.shift).astype(np.int64)] = True

    @staticmethod
    def _hashes(column, lengths: set[int]):
        """(length, hashes) of the windows of each length, where column(j) are the numbers of their words j, or of fewer windows if some end before."""
        total = None
        for j in range(max(lengths, default=0)):
            own = column(j).astype(np.int64).view(np.uint64) + np.uint64(1)
            total = (own if total is None else total[: len(own)] + own) * STEP
            total ^= total >> np.uint64(32)
            if j + 1 in lengths:
                yield j + 1, total * (PLACE + np.uint64(2 * j))

    def of(self, words: pa.Array, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) of every verified occurrence; ends are where each text's words end, the first being 0."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        numbers = pc.fill_null(pc.index_in(words, value_set=self.vocabulary), -1).to_numpy() if len(self.hashes) else np.zeros(0, np.int32)
        for length, hashes in self._hashes(lambda j: numbers[j:], {n for n in set(self.lengths.tolist()) if n <= len(numbers)}):
            place = np.flatnonzero(self.marks[(hashes >> self.shift).astype(np.int64)])
            place = place[place + length <= ends[np.searchsorted(ends, place, side="right")]]  # of one text
            at = np.searchsorted(self.hashes, hashes[place])
            for _ in range(self.most):  # windows of equal hash, one after the other
                same = at < len(self.hashes)
                same[same] = self.hashes[at[same]] == hashes[place[same]]
                place, at = place[same], at[same]
                right = self.lengths[at] == length
                for j in range(length):
                    right[right] = self.stream[self.starts[at[right]] + j] == numbers[place[right] + j]
                found.append((place[right], at[right]))
                at = at + 1
        return np.concatenate([p for p, _ in found]), np.concatenate([w for _, w in found])

    def items_of(self, windows: np.ndarray) -> list[str]:
        """The items of some windows, sorted."""
        held = np.zeros(len(self.items), np.bool_)
        for w in np.unique(windows).tolist():
            held[self.holders[(self.ends[w - 1] if w else 0) : self.ends[w]]] = True
        return sorted(self.items[held].tolist())


def _scanned(held):
    """FOUND of each text, the last column, behind the other columns."""

    def run(batches):
        table = held.value
        for batch in batches:
            n = batch.num_rows
            n_words, n_hit = np.zeros(n, np.int64), np.zeros(n, np.int64)
            firsts, ends, items = ([[]] * n for _ in range(3))
            for low, high, data, offsets in slices(batch.column(batch.num_columns - 1)):
                words, _, _, places = plain_words(data, offsets)
                n_words[low:high] = np.diff(places)
                place, window = table.of(words, places)
                text = np.searchsorted(places, place, side="right") - 1
                order = np.argsort(text, kind="stable")
                text, place, window = text[order], place[order], window[order]
                cuts = np.flatnonzero(np.diff(text)) + 1
                for own, at in zip(np.split(place, cuts), np.split(window, cuts), strict=True):
                    if len(own):
                        k = int(np.searchsorted(places, own[0], side="right")) - 1
                        change = np.zeros(places[k + 1] - places[k] + 1, np.int64)
                        np.add.at(change, own - places[k], 1)
                        np.add.at(change, own - places[k] + table.lengths[at], -1)
                        hit = np.cumsum(change) > 0
                        turns = np.flatnonzero(np.diff(np.concatenate([[False], hit]).astype(np.int8)))
                        n_hit[low + k] = int(hit.sum())
                        firsts[low + k], ends[low + k] = turns[::2].tolist(), turns[1::2].tolist()
                        items[low + k] = table.items_of(at)
            columns = [pa.array(n_words), pa.array(n_hit), pa.array(firsts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *(c.split(" ")[0] for c in FOUND.split(", "))])

    return run


def pieces(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item, words: each item's words, in pieces of PIECE windows at most that overlap by what windows need."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), F.regexp_extract_all(lowered(F.col("text")), F.lit(PLAIN_WORD), F.lit(0)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(PIECE))
    return words.select("item", "words", F.explode(starts).alias("start")).select("item", F.slice("words", F.col("start") + 1, PIECE + window - 1).alias("words"))


def _merged(batches):
    """key, and the union of the firsts, ends (arrays of arrays) and items of all rounds."""
    schema = pa.schema([("key", pa.string()), ("n_hit", pa.int64()), ("firsts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            firsts, ends = [], []
            for a, b in sorted((a, b) for own in r["spans"] for a, b in zip(own["firsts"], own["ends"], strict=True)):
                if ends and a <= ends[-1]:
                    ends[-1] = max(ends[-1], b)
                else:
                    firsts.append(a)
                    ends.append(b)
            out.append({"key": r["key"], "n_hit": sum(ends) - sum(firsts), "firsts": firsts, "ends": ends, "items": sorted({i for own in r["spans"] for i in own["items"]})})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def marked(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """The columns keep of docs and n_words, n_hit, firsts, ends, items: the runs of hit words, as numbers of words from 0, the end exclusive, and the
    items whose windows occur. keep must not hold these names."""
    spark = docs.sparkSession
    parts = saved(pieces(benchmark, window))
    size = parts.agg(F.sum(F.length(F.array_join("words", " ")))).head()[0] or 0
    rounds = max(1, -(-size // round_bytes))

    def table(k: int):
        own = parts.where(F.pmod(F.xxhash64("item", "words"), F.lit(rounds)) == k)
        return spark.sparkContext.broadcast(Windows([(r["item"], r["words"]) for r in own.toLocalIterator()], window))

    kept = [F.col(f"`{c}`") for c in keep]
    fields = [f for f in docs.select(*kept).schema.fields]
    found = T.StructType.fromDDL(FOUND)
    if rounds == 1:
        return docs.select(*kept, "text").mapInArrow(_scanned(table(0)), T.StructType(fields + found.fields))
    (key,) = free_names(docs, "key")
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    texts = docs.select(sha.alias("key"), "text")
    schema = T.StructType.fromDDL(f"key string, {FOUND}")
    hits = saved_one_by_one(texts.mapInArrow(_scanned(table(k)), schema).where("n_hit > 0").select("key", F.struct("firsts", "ends", "items").alias("spans")).distinct() for k in range(rounds))
    merged = hits.groupBy("key").agg(F.collect_list("spans").alias("spans")).mapInArrow(_merged, "key string, n_hit long, firsts array<int>, ends array<int>, items array<string>")
    merged = saved(merged.withColumnRenamed("key", key))
    n_words = F.regexp_count(lowered(F.col("text")), F.lit(PLAIN_WORD)).cast("long").alias("n_words")
    every = docs.select(*kept, n_words, sha.alias(key)).join(merged, key, "left")
    none = F.array()
    return every.select(*kept, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), *(F.coalesce(c, none.cast(f"array<{t}>")).alias(c) for c, t in (("firsts", "int"), ("ends", "int"), ("items", "string"))))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row, with the runs of hit words and the items."""
    listed = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    rows = marked(docs, benchmark, ["doc_id"], window, round_bytes)
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed, (F.col("n_hit") > 0).alias("contaminated"), "firsts", "ends", "items")


def _cut(batches):
    """Each text without its runs of hit words: what stands between a run's first and last word goes with it. Columns: ..., firsts, ends, text."""
    for batch in batches:
        firsts, ends, texts = (batch.column(batch.num_columns - k) for k in (3, 2, 1))
        out = texts.to_pylist()
        hit = np.flatnonzero(pc.list_value_length(firsts).to_numpy(zero_copy_only=False) > 0)
        for k in hit.tolist():
            ((_, _, data, offsets),) = slices(texts.slice(k, 1))
            _, begin, end, _ = plain_words(data, offsets)
            whole, at, left = data.tobytes(), 0, []
            for a, b in zip(firsts[k].as_py(), ends[k].as_py(), strict=True):
                left.append(whole[at : begin[a]])
                at = end[b - 1]
            out[k] = b"".join([*left, whole[at:]]).decode()
        yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(out, pa.string())], names=[*batch.schema.names[:-3], batch.schema.names[-1]])


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", window: int = WINDOW, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """docs without what the benchmark holds: with remove = "spans" the runs of hit words are cut out of the texts, with "documents" every document with
    a hit goes."""
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove spans or documents, not {remove}")
    names = [f"column_{k}" for k in range(len(docs.columns))]
    renamed = docs.toDF(*names)
    text = names[[c.lower() for c in docs.columns].index("text")]
    rows = marked(renamed.withColumn("text", F.col(text)), benchmark, names, window, round_bytes)
    if remove == "documents":
        return rows.where("n_hit = 0").select(*names).toDF(*docs.columns)
    others = [c for c in names if c != text]
    schema = T.StructType([f for c in (*others, text) for f in renamed.schema.fields if f.name == c])
    cut = rows.select(*others, "firsts", "ends", text).mapInArrow(_cut, schema)
    return cut.select(*names).toDF(*docs.columns)
