"""Byte-level BPE: ranked merges folded over the distinct words of the corpus, and decoding by concatenating binary pieces.

A text is cut into words by the vocabulary's pattern. Each run of BLOCK_ROWS documents becomes a block, a few rows, that holds its distinct
words and, per document, the numbers of its words. Words that are a piece as a whole get their id at once. All others leave their blocks as rows
(word, block, number), meet by word, and each is folded once for the corpus (once for every GROUP_BLOCKS blocks, so that a word of all blocks is no hot
group). The ids then go back to the blocks, which lie in buckets by their number: documents and their codes are not shuffled.

The fold is Spark's higher-order function ``aggregate`` over an array of binary pieces, at first single bytes: each step looks up the ranks of the
pairs that the last merge made, and joins the first pair of the least rank, until no pair has one. The ranks are a literal, dealt into BUCKETS by
checksum, as Spark looks through a map entry by entry. A step copies the arrays, so the fold's time is quadratic in a word's bytes; words of more than
LONG_BYTES bytes are merged in the block by a heap instead.

Cases: null and empty texts have no ids; repeated rows stay repeated, null doc_ids stay null; an empty table gives no rows; columns other than doc_id
and text are left aside, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmere.llm.common import arrow_rows, released, saved_in_buckets, tokenizer_path, trimmed

BUCKETS = 32768  # a power of two
NO_RANK = 2**31 - 1
#: Java's (?U) gives \s the Unicode meaning that the vocabulary's pattern expects.
UNICODE_FLAG = "(?U)"
#: A word is folded once for so many blocks at most.
GROUP_BLOCKS = 4096
LONG_BYTES = 2048
#: A block's rows or words, whichever come first, and the rows that reach it at a time.
BLOCK_ROWS, BLOCK_WORDS, ARROW_ROWS = 8_000, 6_000_000, 1_000
#: A block's chunks, of ARROW_ROWS documents, that lie in one row.
PART_CHUNKS = 2
#: Documents that leave a block together.
ROWS = 256
#: Numbers that are worked on at a time.
PART = 1 << 19
BLOCK = "block long, part int, ids array<bigint>, counts array<int>, codes binary, done array<int>, done_ids array<array<int>>, n_words int, words array<string>"
ENCODED = "doc_id bigint, ids_sha256 string, token_ids array<int>"


def bound(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


class Vocabulary:
    """Ranks of a tiktoken file, as a literal for Spark expressions and as the pieces in order of rank."""

    def __init__(self, name: str = "byte_bpe_50k.tiktoken", pattern: str | None = None):
        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        with open(tokenizer_path(name), "rb") as lines:
            ranks = {int(rank): piece.decode() for piece, rank in (line.split() for line in lines if line.strip())}
        self.pattern = UNICODE_FLAG + pattern
        self.pieces = [base64.b64decode(ranks[k]) if k in ranks else None for k in range(max(ranks) + 1)]
        buckets: list[dict[str, list]] = [{"pieces": [], "ranks": []} for _ in range(BUCKETS)]
        for rank, piece in ranks.items():
            bucket = buckets[xxhash.xxh64_intdigest(base64.b64decode(piece), seed=42) % BUCKETS]
            bucket["pieces"].append(piece)
            bucket["ranks"].append(rank)
        self._ranks = F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<struct<pieces: array<binary>, ranks: array<int>>>")

    def ranks_of(self, pieces: Column) -> Column:
        """array<int>: the ranks of an array of binary pieces, NO_RANK for what is no piece."""

        def rank(piece: Column) -> Column:
            bucket = F.get(self._ranks, F.xxhash64(piece).bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
            return bound(bucket, lambda b: F.coalesce(F.get(b["ranks"], F.array_position(b["pieces"], piece).cast("int") - 1), F.lit(NO_RANK)))

        return F.transform(pieces, rank)

    def encode_word(self, word: Column) -> Column:
        """array<int>: the ids of one word that is not a piece as a whole."""

        def folded(bytes_: Column) -> Column:
            single = F.transform(F.sequence(F.lit(1), F.length(bytes_)), lambda i: F.substring(bytes_, i, F.lit(1)))
            pairs = F.transform(F.sequence(F.lit(1), F.length(bytes_) - 1), lambda i: F.substring(bytes_, i, F.lit(2)))
            none = F.array().cast("array<int>")
            start = F.struct(single.alias("pieces"), none.alias("before"), F.when(F.length(bytes_) > 1, pairs).otherwise(F.array().cast("array<binary>")).alias("asked"), none.alias("after"))
            return F.aggregate(F.sequence(F.lit(1), F.length(bytes_)), start, lambda s, _: F.when(s["asked"].isNull(), s).otherwise(self._step(s)), lambda s: self.ranks_of(s["pieces"]))

        return bound(F.encode(word, "UTF-8"), folded)

    def _step(self, s: Column) -> Column:
        """The ranks of all pairs are those before the asked ones, the asked ones' and those after. No more pairs are asked when none has a rank."""
        pieces = s["pieces"]
        none = F.array().cast("array<int>")
        ended = F.struct(pieces.alias("pieces"), none.alias("before"), F.lit(None).cast("array<binary>").alias("asked"), none.alias("after"))

        def joined(ranks: Column, at: Column, new: Column) -> Column:
            left = F.when(at > 1, F.array(F.concat(F.get(pieces, at - 2), new))).otherwise(F.array().cast("array<binary>"))
            right = F.when(at + 1 < F.size(pieces), F.array(F.concat(new, F.get(pieces, at + 1)))).otherwise(F.array().cast("array<binary>"))
            return F.struct(
                F.flatten(F.array(F.slice(pieces, 1, at - 1), F.array(new), F.slice(pieces, at + 2, F.size(pieces)))).alias("pieces"),
                F.slice(ranks, 1, F.greatest(at - 2, F.lit(0))).alias("before"),
                F.flatten(F.array(left, right)).alias("asked"),
                F.slice(ranks, at + 2, F.size(ranks)).alias("after"),
            )

        def least(ranks: Column) -> Column:
            one = lambda at: bound(F.concat(F.get(pieces, at - 1), F.get(pieces, at)), lambda new: joined(ranks, at, new))
            return bound(F.array_min(ranks), lambda rank: F.when(F.coalesce(rank, F.lit(NO_RANK)) == NO_RANK, ended).otherwise(bound(F.array_position(ranks, rank).cast("int"), one)))

        return bound(F.flatten(F.array(s["before"], self.ranks_of(s["asked"]), s["after"])), least)


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a long word: a heap of pairs by (rank, place), and links between the pieces that are left."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the piece that starts at k; an absorbed piece has end 0

    def pair(k):
        follower = end[k]
        rank = ranks.get(word[k : end[follower]]) if follower < n else None
        return (rank, k, end[follower]) if rank is not None else None

    heap = [p for p in map(pair, range(n)) if p]
    heapq.heapify(heap)
    while heap:
        _, k, to = heapq.heappop(heap)
        if not end[k] or end[k] >= to or end[end[k]] != to:  # a piece of the pair has changed since
            continue
        end[end[k]], end[k] = 0, to
        if to < n:
            before[to] = k
        for p in (pair(k), pair(before[k]) if before[k] >= 0 else None):
            if p:
                heapq.heappush(heap, p)
    found, k = [], 0
    while k < n:
        found.append(ranks[word[k : end[k]]])
        k = end[k]
    return found


def _lists(values: pa.Array, ends=None) -> pa.Array:
    """values as one list, or as the lists that end at ends."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)] if ends is None else ends, pa.int32()), values)


def _numbers(numbers: np.ndarray, places: list[np.ndarray] | None = None) -> bytes:
    """numbers below 2^32, or those at places, as four planes of bytes, compressed: most upper bytes are zero. Worked out in parts, to hold little at a time."""
    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, "zstd") as out:
        for k in range(4):
            plane = (numbers >> (8 * k)).astype(np.uint8)
            if places is None:
                out.write(plane.tobytes())
            for own in places or []:
                for low in range(0, len(own), PART):
                    out.write(plane[own[low : low + PART]].tobytes())
    return sink.getvalue().to_pybytes()


def _times(indices: np.ndarray, n: int) -> np.ndarray:
    """How often each of the numbers up to n occurs; in parts, as bincount makes its input wider."""
    found = np.zeros(n, np.int64)
    for low in range(0, len(indices), PART):
        found += np.bincount(indices[low : low + PART], minlength=n)
    return found


def _planes(packed: bytes, count: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, 4 * count, codec="zstd", asbytes=True), np.uint8).reshape(4, count)


def _of_planes(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _gathered(batches):
    """(doc_ids, counts, words as a dictionary array) of runs of batches, of BLOCK_ROWS rows or BLOCK_WORDS words or a little more.

    doc_ids are copied: a slice of a batch would keep all of it, with its words, in memory.
    """
    ids, counts, coded, rows, words = [], [], [], 0, 0

    def taken():
        found = pa.concat_arrays(ids), pa.concat_arrays(counts), pa.chunked_array(coded).unify_dictionaries()
        for parts in (ids, counts, coded):
            parts.clear()
        return found

    for batch in batches:
        ids.append(pa.compute.add(batch.column(0).cast(pa.int64()), 0))
        counts.append(pa.compute.fill_null(pa.compute.list_value_length(batch.column(1)), 0).cast(pa.int32()))
        coded.append(batch.column(1).flatten().dictionary_encode())
        rows, words = rows + batch.num_rows, words + len(coded[-1])
        del batch
        if rows >= BLOCK_ROWS or words >= BLOCK_WORDS:
            yield taken()
            rows = words = 0
    if ids:
        yield taken()


def _block(number_of_block: int, ids: pa.Array, counts: pa.Array, coded: pa.ChunkedArray, pieces: pa.Array, ranks_of):
    """The rows of one block: its documents as numbers into its distinct words, the most frequent word first, so that numbers are small. A row holds PART_CHUNKS
    chunks of documents, the first one the words, too."""
    distinct = coded.chunk(0).dictionary.cast(pa.binary())
    parts = [c.indices.to_numpy() for c in coded.chunks]
    del coded
    times = sum(_times(part, len(distinct)) for part in parts)
    order = pa.compute.sort_indices(pa.table({"times": times, "word": distinct}), sort_keys=[("times", "descending"), ("word", "ascending")])
    distinct = distinct.take(order)
    number = np.empty(len(order), np.uint32)
    number[order.to_numpy()] = np.arange(len(order))
    whole = pa.compute.fill_null(pa.compute.index_in(distinct, value_set=pieces), -1).to_numpy()
    long = np.flatnonzero((pa.compute.binary_length(distinct).to_numpy() > LONG_BYTES) & (whole < 0))
    done = np.union1d(np.flatnonzero(whole >= 0), long)
    done_ids = [[int(whole[j])] if whole[j] >= 0 else merged(distinct[int(j)].as_py(), ranks_of()) for j in done]
    rest = np.ones(len(distinct), bool)
    rest[done] = False
    words = [pa.array(done, pa.int32()), pa.array(done_ids, pa.list_(pa.int32())), len(distinct), distinct.filter(pa.array(rest)).cast(pa.string())]
    sizes = np.cumsum(counts.to_numpy(), dtype=np.int64)
    at = 0
    for low in range(0, len(parts), PART_CHUNKS):
        own = parts[low : low + PART_CHUNKS]
        last = low + PART_CHUNKS >= len(parts)
        until = len(ids) if last else int(np.searchsorted(sizes, sum(map(len, parts[: low + PART_CHUNKS])), side="right"))
        row = [pa.array([number_of_block], pa.int64()), pa.array([low], pa.int32()), _lists(ids[at:until]), _lists(counts[at:until]), pa.array([_numbers(number, own)], pa.binary())]
        row += [_lists(words[0]), _lists(words[1]), pa.array([words[2]], pa.int32()), _lists(words[3])]
        yield pa.RecordBatch.from_arrays(row, names=["block", "part", "ids", "counts", "codes", "done", "done_ids", "n_words", "words"])
        words, at = [pa.array([], pa.int32()), pa.array([], pa.list_(pa.int32())), 0, pa.array([], pa.string())], until


def _blocks(held):
    """The rows of a block for each run of batches."""

    def run(batches):
        pieces, ranks = pa.array(held.value, pa.binary()), {}
        task = TaskContext.get().partitionId()

        def ranks_of() -> dict[bytes, int]:
            if not ranks:
                ranks.update((piece, rank) for rank, piece in enumerate(held.value) if piece is not None)
            return ranks

        gathered = _gathered(batches)
        for k in itertools.count():
            parts = next(gathered, None)  # not in a for loop, whose variables would keep a block until the next one is whole
            if parts is None:
                return
            rows = _block(task << 33 | k, *parts, pieces, ranks_of)
            del parts
            yield from rows
            del rows
            pa.default_memory_pool().release_unused()

    return run


def _packed(batches):
    """For each batch and block one row: places of words and their ids."""
    for batch in batches:
        order = np.argsort(batch.column(0).to_numpy(), kind="stable")
        block, place = (batch.column(j).to_numpy()[order] for j in (0, 1))
        ids = batch.column(2).take(pa.array(order))
        lengths = pa.compute.list_value_length(ids).to_numpy()
        ends = np.concatenate([[0], np.cumsum(lengths)])
        flat = ids.flatten().to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])[: len(block)])
        rows = []
        for a, b in zip(starts, [*starts[1:], len(block)], strict=True):
            numbers = np.concatenate([place[a:b], lengths[a:b], flat[ends[a] : ends[b]]]).astype(np.uint32)
            rows.append((int(block[a]), int(b - a), len(numbers), _numbers(numbers)))
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["block", "n", "size", "packed"])


def _documents(finish):
    """The ids of every document of a block, from the ids of its words; finish makes the rows of ROWS documents at most."""

    def run(blocks: pa.Table, words: pa.Table) -> pa.Table:
        n_words = sum(blocks["n_words"].to_pylist())
        done, done_ids = _of_all(blocks)
        rest = np.delete(np.arange(n_words), done)
        numbers, lengths, flat = [done], [pa.compute.list_value_length(done_ids).to_numpy()], [done_ids.flatten().to_numpy()]
        for n, size, packed in zip(*(words[c].to_pylist() for c in ("n", "size", "packed")), strict=True):
            values = _of_planes(_planes(packed, size))
            numbers.append(rest[values[:n]])
            lengths.append(values[n : 2 * n])
            flat.append(values[2 * n :])
        numbers, lengths, flat = np.concatenate(numbers), np.concatenate(lengths).astype(np.int64), np.concatenate(flat).astype("<i4")
        if len(numbers) != n_words:
            raise ValueError("a block lacks ids of its words")
        start_of, length_of = np.empty(n_words, np.int64), np.empty(n_words, np.int64)
        start_of[numbers], length_of[numbers] = np.cumsum(lengths) - lengths, lengths
        found = []
        for block in blocks.select(["ids", "counts", "codes"]).to_batches(max_chunksize=1):
            ids, counts = (block.column(j)[0].values for j in (0, 1))
            places = np.concatenate([[0], np.cumsum(counts.to_numpy(), dtype=np.int64)])
            planes = _planes(block.column(2)[0].as_buffer(), int(places[-1]))
            for low in range(0, len(ids), ROWS):
                high = min(len(ids), low + ROWS)
                part = _of_planes(planes[:, places[low] : places[high]])
                long = length_of[part]
                ends = np.concatenate([[0], np.cumsum(long)])
                tokens = flat[np.repeat(start_of[part] - ends[:-1], long) + np.arange(ends[-1])]
                found.append(finish(ids[low:high].cast(pa.int64()), tokens, ends[places[low : high + 1] - places[low]]))
            del planes
        released()
        return pa.Table.from_batches(found or [finish(pa.array([], pa.int64()), np.zeros(0, "<i4"), np.zeros(1, np.int64))])

    return run


def _of_all(blocks: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """The words of a block that are done, and their ids, from the row that has them."""
    done, done_ids = (blocks[c].combine_chunks().flatten() for c in ("done", "done_ids"))
    return done.to_numpy(), done_ids


def _digests(data, ends: np.ndarray) -> pa.Array:
    view = memoryview(data)
    return pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string())


def _with_ids(ids: pa.Array, tokens: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, _digests(tokens.tobytes(), 4 * ends), _lists(pa.array(tokens, pa.int32()), ends)], names=["doc_id", "ids_sha256", "token_ids"])


def concatenated(pieces: pa.Array, tokens, ends: np.ndarray) -> tuple[pa.Buffer, np.ndarray]:
    """The binary pieces of tokens one after the other, and where those of each document end."""
    joined = pieces.take(pa.array(tokens, pa.int32()))
    if not len(joined):
        return pa.py_buffer(b""), np.zeros(len(ends), np.int64)
    return joined.buffers()[2], np.frombuffer(joined.buffers()[1], np.int64)[ends]


def _with_digests(held):
    pieces: list[pa.Array] = []  # made once in a worker

    def finish(ids: pa.Array, tokens: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        if not pieces:
            pieces.append(_binary(held))
        data, places = concatenated(pieces[0], tokens, ends)
        return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(ends), pa.int64()), _digests(tokens.tobytes(), 4 * ends), _digests(data, places)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return finish


def _binary(held) -> pa.Array:
    return pa.array(held.value, pa.large_binary())


def _encoded(docs: DataFrame, vocabulary: Vocabulary, held, finish, schema: str) -> DataFrame:
    words = docs.select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(vocabulary.pattern), F.lit(0)).alias("words"))
    with arrow_rows(docs.sparkSession, ARROW_ROWS):  # the words of a batch lie in memory of the JVM and of Python
        blocks = saved_in_buckets(words.mapInArrow(trimmed(_blocks(held)), BLOCK), "block")
    group = F.pmod(F.xxhash64("block"), F.lit(-(-blocks.where("part = 0").count() // GROUP_BLOCKS) or 1)).alias("group")
    rows = blocks.select(F.posexplode("words").alias("place", "word"), "block", group).repartition("word", "group")
    each = rows.groupBy("word", "group").agg(F.collect_list(F.struct("block", "place")).alias("places"))
    folded = each.select(vocabulary.encode_word(F.col("word")).alias("token_ids"), "places").select(F.explode("places").alias("at"), "token_ids")
    packed = folded.select("at.block", "at.place", "token_ids").mapInArrow(trimmed(_packed), "block long, n int, size int, packed binary")
    return blocks.drop("words").groupBy("block").cogroup(packed.groupBy("block")).applyInArrow(_documents(finish), schema)


def _held(docs: DataFrame, vocabulary: Vocabulary):
    return docs.sparkSession.sparkContext.broadcast(vocabulary.pieces)  # of the vocabulary's size


def encode_documents(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids_sha256, token_ids) of every row of docs; the digest is of the ids as little-endian unsigned 32-bit integers."""
    return _encoded(docs, vocabulary, _held(docs, vocabulary), _with_ids, ENCODED)


def decode_documents(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, decoded (binary) of every row (doc_id, token_ids): the binary pieces of the ids, concatenated. Null ids decode to nothing."""
    held = _held(encoded, vocabulary)

    def run(batches):
        pieces = _binary(held)
        for batch in batches:
            ids = batch.column(1)
            ends = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(ids), 0).to_numpy(), dtype=np.int64)])
            data, places = concatenated(pieces, ids.flatten(), ends)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(places.tobytes()), data]).cast(pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, decoded binary")


def encoding_digest(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: the ids, and the bytes that come back from them."""
    vocabulary = vocabulary or Vocabulary()
    held = _held(docs, vocabulary)
    return _encoded(docs, vocabulary, held, _with_digests(held), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
