"""Words of whole texts as numpy arrays: a batch's bytes, and where its runs of word bytes start and end.

Letters outside ASCII have bytes above 127 only, in UTF-8, so runs of bytes are runs of characters. Texts are worked on in slices of about SLICE bytes; a
longer text is a slice of its own, never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Each byte with A-Z made small.
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[ord("A") : ord("Z") + 1] += 32
#: Digits, letters and all that isn't ASCII.
WORD_BYTES = np.array([chr(b).isdigit() and b < 128 or 97 <= b < 123 or 65 <= b < 91 or b >= 128 for b in range(256)])
#: The same words as a pattern for texts whose A-Z have been made small.
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A text with A-Z, and no other letters, made small; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(low, high, bytes, offsets) of the texts from low to high; nulls are empty."""
    if not len(texts):
        return
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE, side="right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of True start and end. A run ends where its text does."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    starts, ends = offsets[:-1][offsets[:-1] < len(inside)], offsets[1:][offsets[1:] > 0] - 1
    first[starts], last[ends] = inside[starts], inside[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_array(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Words that lie in data one after the other."""
    ends = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=ends[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(words with A-Z made small, their starts and ends in data, and how many words precede each text and the end)."""
    inside = WORD_BYTES[data]
    starts, ends = runs(inside, offsets)
    return word_array(LOWERED[data[inside]], ends - starts), starts, ends, np.searchsorted(starts, offsets)
