"""Spelling variant grouping by rolling-hash deletions.

Words are runs of letters of Latin-1, so a letter is a byte. The polynomial hashes of all prefixes and suffixes of a batch of words give, in one numpy
expression, the hash of every word without its letter at any place. Two words are near, one letter apart, if

* they have one length and are equal without their letters at the same place (kind REPLACED, the place goes into the key), or
* one is the other without a letter (kind SHORTENED): of a run of equal letters only the first is left out, so that every pair meets under one key.

Keys are slim rows (key, number of the word, place, kind), dealt by their upper bits and sorted; those that occur once, nearly all, end there. The others get
their words and are grouped by the rest of the word itself: a collision of hashes puts nothing together. Words of one key and rest differ in one letter at most,
so a group has no more words than an alphabet, times their length for SHORTENED: pairs are never listed, each word takes the count and the best two of its
group. Forms are followed to their roots by doubling; a step multiplies the count, so there are few.

Cases: null and empty texts have no words; a null doc_id is an empty string in the checksum; repeated rows count again; an empty table gives no rows; other
columns are left aside, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmere.llm.common import saved
from sparkmere.llm.words import LOWERED, runs, slices, word_array

LEAST_LENGTH = 7
LEAST_COUNT = 2
TIMES = 10
#: One in DAMAGE runs loses a letter before it is counted; 0: none.
DAMAGE = 31
REPLACED, SHORTENED, WHOLE = 0, 1, 2
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = np.uint64(pow(BASE, -1, 1 << 64))
#: Keys that are sorted in one part, about.
PART_KEYS = 1_000_000
LETTERS = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
#: Runs beyond this many bytes have their checksums worked out one by one.
LONG = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1).astype(np.uint32)
    return table


CRC = _crc_table()


def checksums(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The crc32 of each run of bytes, going on from the checksums before."""
    order = np.argsort(-lengths, kind="stable")
    state, start, long = ~before[order].astype(np.uint32), starts[order], lengths[order]
    for k in range(min(LONG, int(long.max(initial=0)))):
        n = int(np.searchsorted(-long, -k, side="left"))  # runs of more than k bytes come first
        state[:n] = CRC[(state[:n] ^ data[start[:n] + k]) & 255] ^ (state[:n] >> 8)
    found = np.empty(len(order), np.uint32)
    found[order] = ~state
    for k in np.flatnonzero(lengths > LONG).tolist():
        found[k] = zlib.crc32(data[starts[k] : starts[k] + lengths[k]].tobytes(), int(before[k]))
    return found


def _counted(damage: int, least_length: int):
    """word, n: the words of each slice of texts (doc_id, text) of least_length letters at least."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for low, high, data, offsets in slices(batch.column(1)):
                data = LOWERED[data]
                lead = data == 0xC3  # of U+00C0 to U+00FF; the byte behind it is theirs, too
                inside = LETTERS[data] | lead
                inside[1:] |= lead[:-1]
                starts, ends = runs(inside, offsets)
                letters = ends - starts - np.diff(np.concatenate([[0], np.cumsum(lead)])[np.stack([starts, ends], axis=1)], axis=1).ravel()
                long = letters >= least_length
                starts, lengths, letters = starts[long], (ends - starts)[long], letters[long]
                drop = np.zeros(len(starts), bool)
                if damage:
                    prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids[low:high]], np.uint32)
                    sums = checksums(data, starts, lengths, prefix[np.searchsorted(offsets, starts, side="right") - 1])
                    drop = sums % damage == 0
                shorter = []
                for a, n, h, m in zip(*(x[drop].tolist() for x in (starts, lengths, sums, letters)), strict=True) if damage else ():
                    if m > least_length:
                        word = data[a : a + n].tobytes().decode()
                        shorter.append(word[: h % m] + word[h % m + 1 :])
                left = ~drop
                body = np.zeros(len(data) + 1, np.int8)
                body[starts[left]] += 1
                np.add.at(body, (starts + lengths)[left], -1)
                whole = word_array(data[np.cumsum(body[:-1]).astype(bool)], lengths[left]).cast(pa.large_string())
                counts = pa.chunked_array([whole, pa.array(shorter, pa.large_string())]).value_counts()
                yield pa.RecordBatch.from_arrays([counts.field(0).cast(pa.string()), counts.field(1)], names=["word", "n"])

    return run


def word_counts(docs: DataFrame, damage: int = DAMAGE, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words that are long and frequent enough."""
    each = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(_counted(damage, least_length), "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers whose upper bits hang on all bits of x."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, ...]:
    """(key, place of the word in words, place of the letter, kind) of every word: whole, and without each letter."""
    data = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    lengths = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(data)) - (ends - lengths)[owner]
    power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(int(lengths.max(initial=0)), BASE, np.uint64))])
    total = np.concatenate([[np.uint64(0)], np.cumsum(_mixed(data.astype(np.uint64) + np.uint64(1)) * power[place])])  # sums wrap, as hashes may
    begin = total[ends - lengths]
    prefix, suffix = total[:-1] - begin[owner], total[ends][owner] - total[1:]
    without = _mixed((prefix + suffix * INVERSE) ^ lengths[owner].astype(np.uint64))
    replaced = _mixed(without + place.astype(np.uint64) + np.uint64(1))
    first = np.ones(len(data), bool)  # of a run of equal letters
    first[1:] = (data[1:] != data[:-1]) | (owner[1:] != owner[:-1])
    whole = _mixed((total[ends] - begin) ^ (lengths + 1).astype(np.uint64))
    every = np.arange(len(words))
    parts = [(replaced, owner, place, REPLACED), (without[first], owner[first], place[first], SHORTENED), (whole, every, lengths, WHOLE)]
    kind = np.concatenate([np.full(len(k), n, np.int8) for k, _, _, n in parts])
    return np.concatenate([k for k, *_ in parts]), np.concatenate([o for _, o, _, _ in parts]), np.concatenate([p for _, _, p, _ in parts]), kind


def _keyed(batches):
    for batch in batches:
        for low in range(0, batch.num_rows, 4096):
            part = batch.slice(low, 4096)
            key, owner, place, kind = deletion_keys(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), part.column(0).take(pa.array(owner)), pa.array(place.astype(np.int32)), pa.array(kind)], names=["key", "id", "place", "kind"])


def _shared(batches):
    """The rows whose key occurs again; rows are sorted by key."""
    last, met = None, False  # the last row, and whether its key has occurred before
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
        key = table.column(0).to_numpy()
        same = key[1:] == key[:-1]
        again = np.concatenate([[met], same]) | np.concatenate([same, [False]])
        yield from table.slice(0, len(key) - 1).filter(pa.array(again[:-1])).to_batches()
        last, met = table.slice(len(key) - 1).to_batches()[0], bool(again[-1])
    if met:
        yield last


def near_words(words: DataFrame, keyed=_keyed) -> DataFrame:
    """word, n, n_near, best (struct of -n and word of the best near word, or null) of every row of distinct words (word, n)."""
    numbered = saved(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    keys = 2 * (numbered.agg(F.sum(F.length("word"))).head()[0] or 0)
    parts = 1 << max(3, (keys // PART_KEYS).bit_length())
    slim = "key long, id long, place int, kind byte"
    radix = F.shiftrightunsigned("key", 60 - parts.bit_length())  # some sixteen values a part, so that parts are of about one size
    dealt = numbered.select("id", "word").mapInArrow(keyed, slim).repartition(parts, radix).sortWithinPartitions("key")
    shared = saved(dealt.mapInArrow(_shared, slim)).join(numbered, "id")
    letters = F.col("word")
    rest = F.when(F.col("kind") == WHOLE, letters).otherwise(F.concat(F.substring(letters, F.lit(1), F.col("place")), F.substring(letters, F.col("place") + 2, F.length(letters))))
    shared = shared.select("key", "id", F.when(F.col("kind") == REPLACED, F.col("place")).otherwise(F.lit(-1)).alias("place"), (F.col("kind") == WHOLE).alias("whole"), rest.alias("rest"), F.struct((-F.col("n")).alias("less"), "word").alias("own"))
    group = Window.partitionBy("key", "place", "rest")
    ordered = group.orderBy("own").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Of words that differ at one place: all others. Of a word and those that are it with a letter more: the word has these, each of these the word.
    replaced = shared.where("place >= 0").select("id", "own", F.count(F.lit(1)).over(group).alias("all"), F.first("own").over(ordered).alias("first"), F.nth_value("own", 2).over(ordered).alias("second"))
    replaced = replaced.select("id", (F.col("all") - 1).alias("near"), F.when(F.col("own") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("best"))
    longer = F.count(F.when(~F.col("whole"), 1)).over(group)
    shortened = shared.where("place < 0").select("id", "whole", longer.alias("longer"), F.min(F.when(F.col("whole"), F.col("own"))).over(group).alias("short"), F.min(F.when(~F.col("whole"), F.col("own"))).over(group).alias("long"))
    shortened = shortened.where("short IS NOT NULL AND longer > 0")
    shortened = shortened.select("id", F.when(F.col("whole"), F.col("longer")).otherwise(F.lit(1)).alias("near"), F.when(F.col("whole"), F.col("long")).otherwise(F.col("short")).alias("best"))
    each = replaced.unionByName(shortened).where("near > 0").groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return numbered.join(each, "id", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "best")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every row of forms (word, form): where following forms ends. Each round doubles the steps."""
    now = saved(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = saved(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            return now


def variants(counts: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct words (word, n)."""
    told = near_words(counts)
    often = -F.col("best.less") >= times * F.col("n")
    told = saved(told.select("word", "n", "n_near", F.when(often, F.col("best.word")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n")))
    ends = roots(told.where("form IS NOT NULL").select("word", "form"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, damage: int = DAMAGE, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """variants of the words of all texts."""
    return variants(word_counts(docs, damage, least_length, least_count), times)


def respelled(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, word, root, times: where texts hold a word that has a form (rows of variants), and how often."""
    words = docs.select("doc_id", F.explode(F.regexp_extract_all(F.col("text"), F.lit("[A-Za-zÀ-ÿ]{%d,}" % LEAST_LENGTH), F.lit(0))).alias("word"))
    words = words.select("doc_id", F.translate("word", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("times"))
    return words.join(found.where("form IS NOT NULL").select("word", "root"), "word").select("doc_id", "word", "root", "times")
