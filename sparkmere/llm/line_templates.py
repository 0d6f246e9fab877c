"""Line dedup with a log-template tree of fixed depth.

A line descends by its number of tokens and its leading DEPTH tokens to a leaf; tokens with a digit are variable fields from the start. In a leaf lines
that agree in at least SIMILAR of their tokens share a template, and tokens in which they differ become variable. In tokens of scripts written
without spaces only the digits are variable. Three kinds of lines are recurring, and dropped wherever they occur:

* lines that two documents or more hold verbatim, of any length, white space aside;
* lines of templates in two documents or more with LONG_BYTES fixed bytes (UTF-8) at least;
* lines of templates in MIN_DOCS documents or more with MIN_FIXED fixed tokens or MIN_BYTES fixed bytes at least.

Equal lines are counted before anything else. Leaves of one document, and those all of whose lines recur verbatim, are left out, as no template there
adds a line. The distinct lines of a leaf stream through one task in one pass, whatever their number, as each line changes the templates that the next
one meets. The task holds the templates of that leaf and two numbers a line. From INDEXED templates on, a line is compared only with those that hold one of
its rarer tokens at the same place; all others agree in too few.

Cases: null and empty texts have no lines to drop; blank lines are kept; a line that repeats within one document counts once; repeated
rows and null doc_ids are documents of their own; an empty table gives no rows; other columns are left aside.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmere.llm.common import saved

DEPTH = 3
SIMILAR = 0.6
MIN_DOCS = 5
MIN_FIXED = 2
MIN_BYTES = 4
LONG_BYTES = 64
#: Rows that leave the parser at a time.
PART = 2048
#: Templates of a leaf from which on they are found by their tokens.
INDEXED = 1024
#: Thai to Khmer, kana, CJK and its compatibility forms: scripts written without spaces.
UNSPACED = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
VARIABLE = "<*>"


def single_spaced(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " "))


def masked(line: Column) -> Column:
    """A single-spaced line with variable fields for tokens with a digit. The pattern is tried only where something changes."""
    whole = F.regexp_replace(line, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*", VARIABLE)
    spaced = F.regexp_replace(line, rf"(?<![^ ])[^ 0-9{UNSPACED}]*+[0-9][^ {UNSPACED}]*+(?![^ ])", VARIABLE)
    return F.when(line.rlike("[0-9]"), F.when(line.rlike(f"[{UNSPACED}]"), F.regexp_replace(spaced, "[0-9]+", VARIABLE)).otherwise(whole)).otherwise(line)


def leaf(line: Column) -> Column:
    tokens = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    return F.xxhash64(tokens, F.substring_index(line, " ", DEPTH))


def _lines(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_lines, at, leaf, line_hash, raw_hash, line of every line that isn't blank, and of each row's first line."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    lines = texts.select("row", "doc_id", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("at", "raw"))
    lines = lines.where(F.col("raw").rlike(r"[^\x20\x09-\x0D]") | (F.col("at") == 0))  # on raw, so that no line is masked for the filter and again for its value
    lines = lines.select("row", "doc_id", "n_lines", "at", single_spaced(F.col("raw")).alias("line"))
    lines = lines.select("row", "doc_id", "n_lines", "at", F.xxhash64("line").alias("raw_hash"), masked(F.col("line")).alias("line"))
    return lines.select("row", "doc_id", "n_lines", "at", F.when(F.col("line") != "", leaf(F.col("line"))).alias("leaf"), F.xxhash64("line").alias("line_hash"), "raw_hash", "line")


class Leaf:
    """The templates of one leaf, in the order in which they came up: a row of token numbers each. Number 0 is the variable field."""

    def __init__(self, width: int):
        self.numbers = {VARIABLE: 0}
        self.table = np.zeros((16, width), np.int32)
        self.count = 0
        self.holders: dict[tuple[int, int], list[int]] | None = None  # templates by place and token; some have lost the token since
        self.needed = max(0, int(SIMILAR * width) - 1)  # tokens that must agree
        while self.needed / width < SIMILAR:
            self.needed += 1

    def _asked(self, own: np.ndarray) -> slice | np.ndarray:
        """Templates, in their order, of which one may agree with a line: what agrees in self.needed places does so in one of any width - needed + 1."""
        if self.holders is None:
            return slice(0, self.count)
        lists = sorted((self.holders.get(key, []) for key in enumerate(own.tolist())), key=len)[: len(own) - self.needed + 1]
        if 8 * sum(map(len, lists)) > self.count:
            return slice(0, self.count)
        return np.array(sorted(set().union(*lists)), np.int64)

    def _hold(self, template: int, places, tokens) -> None:
        for key in zip(places, tokens, strict=True):
            self.holders.setdefault(key, []).append(template)

    def place(self, tokens: list[str]) -> int:
        own = np.array([self.numbers.setdefault(t, len(self.numbers)) for t in tokens], np.int32)
        asked = self._asked(own)
        hits = (self.table[asked] == own).sum(axis=1)
        if len(hits):
            best = int(hits.argmax())
            if hits[best] / len(tokens) >= SIMILAR:
                best = best if isinstance(asked, slice) else int(asked[best])
                changed = np.flatnonzero((self.table[best] != own) & (self.table[best] != 0))
                self.table[best, changed] = 0
                if self.holders is not None:
                    self._hold(best, changed.tolist(), [0] * len(changed))
                return best
        if self.count == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.count] = own
        self.count += 1
        if self.holders is not None:
            self._hold(self.count - 1, range(len(own)), own.tolist())
        elif self.count == INDEXED:
            self.holders = {}
            for k in range(self.count):
                self._hold(k, range(len(own)), self.table[k].tolist())
        return self.count - 1

    def texts(self) -> list[str]:
        tokens = list(self.numbers)
        return [" ".join(tokens[k] for k in row) for row in self.table[: self.count].tolist()]


def _parsed(batches):
    """leaf, line_hash, template, fixed, bytes of each line (leaf, line_hash, line); rows come leaf by leaf, the most frequent line first."""
    schema = pa.schema([("leaf", pa.int64()), ("line_hash", pa.int64()), ("template", pa.int64()), ("fixed", pa.int32()), ("bytes", pa.int64())])

    def out(key, tree, ids, places):
        texts = tree.texts()
        names = [int.from_bytes(hashlib.blake2b(f"{key} {t}".encode(), digest_size=8).digest(), "little", signed=True) for t in texts]
        fixed = [sum(t != VARIABLE for t in text.split(" ")) for text in texts]
        size = [sum(len(t.replace(VARIABLE, "").encode()) for t in text.split(" ")) for text in texts]
        for low in range(0, len(ids), PART):
            own = places[low : low + PART]
            columns = [[key] * len(own), ids[low : low + PART], *([of[k] for k in own] for of in (names, fixed, size))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    key, tree, ids, places = None, None, array("q"), array("q")
    for batch in batches:
        for leaf_, line_id, line in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            tokens = line.split(" ")
            if leaf_ != key:
                if ids:
                    yield from out(key, tree, ids, places)
                key, tree, ids, places = leaf_, Leaf(len(tokens)), array("q"), array("q")
            ids.append(line_id)
            places.append(tree.place(tokens))
    if ids:
        yield from out(key, tree, ids, places)


def templates_of(distinct: DataFrame) -> DataFrame:
    """leaf, line_hash, template, fixed, bytes of distinct lines (leaf, line_hash, line, n)."""
    dealt = distinct.repartition("leaf").sortWithinPartitions("leaf", F.desc("n"), "line_hash")
    return saved(dealt.select("leaf", "line_hash", "line").mapInArrow(_parsed, "leaf long, line_hash long, template long, fixed int, bytes long"))


def recurring_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, n_lines of every row), (row, at of the lines to drop)."""
    slim = saved(_lines(docs).drop("line"))
    several = F.min("first") < F.max("last")  # the least and the largest row differ: two documents or more
    lines = slim.where("leaf IS NOT NULL").groupBy("leaf", "line_hash", "raw_hash").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"), F.max("row").alias("last"))
    lines = saved(lines.withColumn("verbatim", F.col("first") < F.col("last")))
    heavy = saved(lines.groupBy("leaf").agg(several.alias("several"), F.every("verbatim").alias("settled")).where("several AND NOT settled").select("leaf"))
    counts = lines.join(heavy.hint("merge"), "leaf").groupBy("leaf", "line_hash").agg(F.sum("n").alias("n"))
    # Merged at any size: at scale the tables of leaves and lines are too large to broadcast.
    texts = _lines(docs).select("leaf", "line_hash", "line").join(heavy.hint("merge"), "leaf", "left_semi").dropDuplicates(["leaf", "line_hash"])
    distinct = counts.join(texts, ["leaf", "line_hash"]).select("leaf", "line_hash", "line", "n")
    templates = templates_of(distinct)
    wide = templates.where((F.col("fixed") >= MIN_FIXED) | (F.col("bytes") >= MIN_BYTES)).select("leaf", "line_hash", "template", (F.col("bytes") >= LONG_BYTES).alias("long"))
    known = lines.join(wide.hint("merge"), ["leaf", "line_hash"], "left").where("verbatim OR template IS NOT NULL").select("leaf", "line_hash", "raw_hash", "verbatim", "template", "long")
    told = saved(slim.join(known.hint("merge"), ["leaf", "line_hash", "raw_hash"]).select("row", "at", "verbatim", "template", "long"))
    docs_of = told.where("template IS NOT NULL").select("row", "template", "long").distinct().groupBy("template", "long").agg(F.count(F.lit(1)).alias("docs"))
    often = saved(docs_of.where((F.col("docs") >= MIN_DOCS) | F.col("long") & (F.col("docs") >= 2)).select("template"))
    dropped = told.where("verbatim").select("row", "at").unionByName(told.where("NOT verbatim").join(often, "template", "left_semi").select("row", "at"))
    rows = slim.where("at = 0").select("row", "doc_id", "n_lines")
    return rows, dropped


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped: the numbers of the lines of each row that recur across documents."""
    rows, dropped = recurring_lines(docs)
    by_row = dropped.groupBy("row").agg(F.sort_array(F.collect_list("at")).alias("dropped"))
    none = F.array().cast("array<int>")
    return rows.join(by_row, "row", "left").select("doc_id", "n_lines", F.greatest(F.size("dropped"), F.lit(0)).alias("n_dropped"), F.coalesce("dropped", none).alias("dropped"))
