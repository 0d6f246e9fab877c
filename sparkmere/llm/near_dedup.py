"""MinHash near-duplicates: universal hash minima, banding, verification, connected components.

Documents whose sets of 5-word shingles are equal form a class (a digest of the sorted set); everything after works on one row per
class, so copies cost nothing. A class has BANDS x ROWS minima of universal hashes; classes that agree on all ROWS minima of a band share a
bucket. At similarity 0.75 a pair shares no bucket with a chance of 2e-5. Candidates are first each bucket's members with its least member, and all
pairs of buckets of FEW members; they are verified on sketches (a byte of each minimum), then on whole shingle sets, which are
worked out again from the texts of candidates only. Links that would not join two components are not needed, so first each node's best candidate
is verified. What still shares a bucket but not a component is tried in blocks: in larger buckets the sketches of members outside the most frequent
component are compared with all others, block against block, and what comes out is not pairs but (node, component) once each; then the node's set is compared with the sets of the whole component, again in blocks. So no
candidate is left out, and near copies of one text, by then one component, are never paired with each other.

Cases: null and empty texts and white space have empty sets and are linked with nothing; fewer than five words are one shingle; null doc_ids take part
and are never a component's id unless all its rows are null; repeated rows are copies of each other; other columns are left aside.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmere.llm.common import arrow_rows, filter_bits, free_names, may_hold, saved, trimmed, without
from sparkmere.llm.components import components

WORDS = 5
BANDS = 40
ROWS = 5
SIMILAR = 75  # per cent
#: A sketch's similarity has a standard error of 0.03 at 0.75; nothing similar is lost here.
SKETCH = 0.60
FEW = 8
#: Rows of a bucket, and sets of a component, that one task compares with others at a time.
BUCKET_BLOCK = 512
SET_BLOCK = 512
#: Bytes of texts whose shingles are worked out together: some fifty bytes of numbers are held for each.
TEXT_BLOCK = 500_000
#: Pairs that a task holds the sets of at a time.
PAIRS = 256

_random = np.random.default_rng(20240229)
_LETTERS = _random.integers(1, 2**63, 256, np.uint64)
_BASE = np.uint64(int(_random.integers(0, 2**60)) * 8 + 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_PLACES = _random.integers(0, 2**63, WORDS, np.uint64) | np.uint64(1)
_FACTORS = (_random.integers(0, 2**63, BANDS * ROWS, np.uint64) << np.uint64(1)) | np.uint64(1)
_OFFSETS = _random.integers(0, 2**63, BANDS * ROWS, np.uint64) << np.uint64(1)
_MINI = 2048

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    powers = np.full(n + 1, base, np.uint64)
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


class Shingler:
    """Sets of 64-bit shingle hashes of texts. A word's hash is a difference of running sums over the bytes."""

    def __init__(self):
        self.powers = self.inverses = np.zeros(0, np.uint64)

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The sorted distinct shingles of each text; data: UTF-8 bytes of all texts, which start at offsets."""
        n = len(data)
        if len(self.powers) <= n:
            self.powers, self.inverses = _powers(n, _BASE), _powers(n, _INVERSE)
        low = _LOWER[data]
        word = ~_BLANK[low]
        fresh = np.zeros(n + 1, bool)
        fresh[offsets] = True
        before = np.concatenate([[False], word[:-1]]) if n else word
        starts = np.flatnonzero(word & (~before | fresh[:n]))
        after = np.concatenate([word[1:], [False]]) if n else word
        ends = np.flatnonzero(word & (~after | fresh[1:])) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTERS[low] * self.powers[:n], out=sums[1:])
        words = _mixed((sums[ends] - sums[starts]) * self.inverses[starts])
        bounds = np.searchsorted(starts, offsets)
        m = len(words)
        whole = np.zeros(max(0, m - WORDS + 1), np.uint64)
        for k in range(WORDS):
            whole += words[k : k + len(whole)] * _PLACES[k]
        whole = _mixed(whole)
        found = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= WORDS:
                found.append(np.unique(whole[a : b - WORDS + 1]))
            elif b > a:
                found.append(_mixed((words[a:b] * _PLACES[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
            else:
                found.append(whole[:0])
        return found


def _texts(column: pa.Array):
    """Runs of texts of some megabytes: first text, bytes, offsets."""
    array = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < len(array):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + TEXT_BLOCK, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each universal hash, (a x + b) mod 2^64 >> 32, over a set."""
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint64)
    for k in range(0, len(shingles), _MINI):
        values = shingles[None, k : k + _MINI] * _FACTORS[:, None]
        values += _OFFSETS[:, None]
        np.minimum(least, values.min(axis=1) >> np.uint64(32), out=least)
    return least


def _key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _signed(batches):
    shingler = Shingler()
    numbers = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for batch in batches:
        for first, data, offsets in _texts(batch.column(2)):
            sets = shingler.sets(data, offsets)
            keys, bands, sketches = [], [], []
            for own in sets:
                keys.append(_key(own))
                if len(own):
                    least = minima(own)
                    parts = _mixed(least.reshape(BANDS, ROWS) * _PLACES[:ROWS]).sum(axis=1, dtype=np.uint64)
                    bands.append(_mixed(parts + numbers).view(np.int64))
                    sketches.append((least & np.uint64(255)).astype(np.uint8).tobytes())
                else:
                    bands.append(None)
                    sketches.append(None)
            rows = slice(first, first + len(sets))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[rows], batch.column(1)[rows], batch.column(3)[rows], pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                names=["row", "doc_id", "text_hash", "n_shingles", "set_key", "bands", "sketch"],
            )


def _keyed_sets(batches):
    shingler = Shingler()
    for batch in batches:
        for _, data, offsets in _texts(batch.column(0)):
            sets = [s for s in shingler.sets(data, offsets) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set_key", "shingles"])


def _alike(batches):
    """Pairs whose sketches agree often enough, with the similarity that they suggest."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for k in (2, 3))
            share = ((a == b).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
            keep = share >= SKETCH
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep)), pa.array(share[keep])], names=["u", "v", "share"])


def _similar(batches):
    """Pairs whose shingle sets are similar."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= SIMILAR * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], names=["u", "v"])


def _touching(strays: pa.Table, members: pa.Table) -> pa.Table:
    """node, root of a block of strays and a block of members of their bucket that look alike but lie in different components.

    The smaller component's member is the node, the other's root is the root. What several bands find is made distinct later.
    """
    found = set()
    if strays.num_rows and members.num_rows:
        left, right = ([t[c].to_numpy() for c in ("node", "root", "size")] for t in (strays, members))
        sketches = [np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for t in (strays, members)]
        for a, sketch in enumerate(sketches[0]):
            other = np.flatnonzero(right[1] != left[1][a])
            other = other[(sketches[1][other] == sketch).mean(axis=1) >= SKETCH]
            for b in other.tolist():
                if (left[2][a], left[1][a]) < (right[2][b], right[1][b]):
                    found.add((int(left[0][a]), int(right[1][b])))
                else:
                    found.add((int(right[0][b]), int(left[1][a])))
    return pa.table({"node": pa.array([x for x, _ in found], pa.int64()), "root": pa.array([x for _, x in found], pa.int64())})


def _linked_in_block(asked: pa.Table, members: pa.Table) -> pa.Table:
    """u, v: of each asked node one link, if any, to a member of a block of a component."""
    out: list[tuple[int, int]] = []
    if asked.num_rows and members.num_rows:
        sets = [np.frombuffer(s, np.uint64) for s in members["shingles"].to_pylist()]
        sizes = np.array([len(s) for s in sets])
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        owner, every = np.repeat(np.arange(len(sets)), sizes)[order], every[order]
        ids = members["node"].to_numpy()
        for node, shingles in zip(asked["node"].to_pylist(), asked["shingles"].to_pylist(), strict=True):
            own = np.frombuffer(shingles, np.uint64)
            low, high = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
            n = high - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(sets))
            hit = np.flatnonzero(100 * both >= SIMILAR * (len(own) + sizes - both))
            if len(hit):
                out.append((node, int(ids[hit[0]])))
    return pa.table({"u": pa.array([x for x, _ in out], pa.int64()), "v": pa.array([x for _, x in out], pa.int64())})


def _with_both(pairs: DataFrame, of: DataFrame, value: str) -> DataFrame:
    """u, v and the value of each."""
    first = of.select(F.col("node").alias("u"), F.col(value).alias("a"))
    second = of.select(F.col("node").alias("v"), F.col(value).alias("b"))
    return pairs.select("u", "v").join(second, "v").join(first, "u").select("u", "v", "a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


class NearDuplicates:
    """The steps over one table of documents (doc_id, text)."""

    def __init__(self, docs: DataFrame):
        self.docs = docs.select("doc_id", "text")
        rows = self.docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.xxhash64("text").alias("text_hash"))
        self.signed = saved(rows.mapInArrow(trimmed(_signed), "row long, doc_id long, text_hash long, n_shingles long, set_key binary, bands array<long>, sketch binary"))
        self.classes = saved(self.signed.where("n_shingles > 0").groupBy("set_key").agg(F.min("row").alias("node"), F.min("doc_id").alias("least_id")))
        chosen = self.classes.select(F.col("node").alias("row"))
        self.nodes = saved(self.signed.join(chosen, "row", "left_semi").select(F.col("row").alias("node"), "doc_id", "set_key", "bands", "sketch"))

    def members(self) -> DataFrame:
        """band, node, hub, n of the buckets with several members."""
        own = self.nodes.select("node", F.explode("bands").alias("band"))
        buckets = saved(own.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1"))
        return saved(own.join(buckets, "band"))

    def alike(self, pairs: DataFrame) -> DataFrame:
        return saved(_with_both(pairs, self.nodes, "sketch").mapInArrow(trimmed(_alike), "u long, v long, share double"))

    def sets(self, ends: DataFrame) -> DataFrame:
        """node, shingles of the nodes of ends (node), from their texts."""
        about = saved(self.nodes.join(ends.distinct(), "node", "left_semi").select("node", "doc_id", "set_key"))
        wanted = about.select(F.col("doc_id").alias("id")).distinct()
        texts = self.docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text")
        sets = texts.mapInArrow(trimmed(_keyed_sets), "set_key binary, shingles binary")
        return saved(about.join(sets, "set_key").select("node", "shingles").dropDuplicates(["node"]))

    def similar(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are links, by their whole sets."""
        pairs = saved(pairs.select("u", "v"))
        sets = self.sets(pairs.select(F.explode(F.array("u", "v")).alias("node")))
        with arrow_rows(self.docs.sparkSession, PAIRS):
            return saved(_with_both(pairs, sets, "shingles").mapInArrow(trimmed(_similar), "u long, v long"))

    def touching(self, members: DataFrame, parts: DataFrame) -> DataFrame:
        """node, root: members of larger buckets that look like a member of another component.

        The members outside a bucket's most frequent component, its strays, are compared with all its members, by blocks of both.
        """
        crowded = members.where(F.col("n") > FEW).select("band", "node", "n").join(parts, "node")
        per_root = crowded.groupBy("band", "root").agg(F.count(F.lit(1)).alias("own"))
        main = F.max_by("root", F.struct("own", "root")).alias("main")
        mixed = saved(per_root.groupBy("band").agg(main, (F.sum("own") - F.max("own")).alias("strays")).where("strays > 0"))
        blocks, groups = (F.ceil(F.col(n) / BUCKET_BLOCK).cast("int").alias(to) for n, to in (("n", "blocks"), ("strays", "groups")))
        crowded = saved(crowded.join(mixed, "band").select("band", "node", "root", "size", "main", blocks, groups))
        told = crowded.join(self.nodes.select("node", "sketch"), "node")

        def part(n: str):
            return F.pmod(F.xxhash64("node"), F.col(n)).cast("int")

        def all_of(n: str):
            return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

        key = ["band", "group", "block"]
        left = told.where("root != main").select("*", part("groups").alias("group"), all_of("blocks").alias("block"))
        right = told.select("*", part("blocks").alias("block"), all_of("groups").alias("group"))
        left, right = (d.select(*(F.col(c).alias(c) for c in (*key, "node", "root", "size", "sketch"))) for d in (left, right))
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_touching, "node long, root long")

    def linked(self, asked: DataFrame, parts: DataFrame) -> DataFrame:
        """u, v: links of nodes to members of components, for asked (node, root): each set against the sets of the component, in blocks."""
        asked = saved(asked.distinct())
        touched = saved(asked.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / SET_BLOCK).cast("int").alias("groups")))
        members = saved(parts.join(touched, "root").withColumn("blocks", F.ceil(F.col("size") / SET_BLOCK).cast("int")))
        sets = self.sets(asked.select("node").unionByName(members.select("node")))
        counts = saved(members.groupBy("root").agg(F.max("blocks").alias("blocks"), F.max("groups").alias("groups")))

        def part(n: str):
            return F.pmod(F.xxhash64("node"), F.col(n)).cast("int")

        def all_of(n: str):
            return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

        left = asked.join(counts, "root").withColumn("group", part("groups")).select("root", "node", "group", all_of("blocks").alias("block")).join(sets, "node")
        right = members.withColumn("block", part("blocks")).select("root", "node", "block", all_of("groups").alias("group")).join(sets, "node")
        left, right = (d.select(*(F.col(c).alias(c) for c in ("root", "block", "group", "node", "shingles"))) for d in (left, right))
        return saved(left.groupBy("root", "block", "group").cogroup(right.groupBy("root", "block", "group")).applyInArrow(_linked_in_block, "u long, v long"))

    def roots(self) -> DataFrame:
        """node, root of every class that is linked with another."""
        members = self.members()
        stars = members.where("node != hub").select(F.col("hub").alias("u"), F.col("node").alias("v"))
        few = members.where(F.col("n").between(3, FEW)).select("band", "node")
        every = few.select("band", F.col("node").alias("u")).join(few.select("band", F.col("node").alias("v")), "band").where("u < v").select("u", "v")
        candidates = self.alike(_ordered(stars.unionByName(every)))
        best = candidates.groupBy("v").agg(F.max_by("u", F.struct("share", "u")).alias("u")).select("u", "v")
        links = self.similar(best)
        roots = saved(self.nodes.select("node").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node")))
        parts = saved(roots.join(saved(roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))), "root"))
        ends = [parts.select(F.col("node").alias(e), F.struct("size", "root").alias(f"part_{e}")) for e in ("u", "v")]
        between = candidates.select("u", "v").join(ends[0], "u").join(ends[1], "v").where("part_u.root != part_v.root")
        smaller = F.col("part_u") < F.col("part_v")
        apart = between.select(F.when(smaller, F.col("u")).otherwise(F.col("v")).alias("node"), F.when(smaller, F.col("part_v.root")).otherwise(F.col("part_u.root")).alias("root"))
        links = links.unionByName(self.linked(apart.unionByName(self.touching(members, parts)), parts))
        return saved(components(links))

    def rooted(self) -> DataFrame:
        """set_key, least_id, root of every class."""
        return saved(self.classes.join(self.roots(), "node", "left").select("set_key", "least_id", F.coalesce("root", "node").alias("root")))

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id, kept of every row."""
        rooted = self.rooted()
        least = saved(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")))
        ids = saved(rooted.select("set_key", "root").join(least, "root").select("set_key", "component_id"))
        rows = self.signed.select("doc_id", "n_shingles", "set_key")
        component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
        found = rows.join(ids, "set_key", "left").select("doc_id", "n_shingles", component.alias("component_id"))
        return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

    def losers(self) -> tuple[DataFrame, DataFrame]:
        """(doc_id, text_hash) of the rows of components that go, and of those of which one stays but which occur several times.

        Of each component the row of the smallest doc_id stays (null last), of several texts with that doc_id the one of the smallest hash.
        """
        own = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
        rows = self.signed.where("n_shingles > 0").groupBy("set_key", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
        rows = saved(rows.join(self.rooted().select("set_key", "root"), "set_key").select("root", "doc_id", "text_hash", "n", own.alias("own")))
        best = saved(rows.groupBy("root").agg(F.min("own").alias("best"), F.sum("n").alias("all")).where(F.col("all") > 1).drop("all"))
        told = saved(rows.join(best, "root").select("doc_id", "text_hash", "n", (F.col("own") == F.col("best")).alias("stays")))
        return told.where("NOT stays").select("doc_id", "text_hash").distinct(), told.where("stays AND n > 1").select("doc_id", "text_hash")


def near_duplicates(docs: DataFrame) -> DataFrame:
    return NearDuplicates(docs).result()


def kept_documents(docs: DataFrame) -> DataFrame:
    """docs, with all its columns, with one row of each group of near-duplicates: that of the smallest doc_id, null doc_ids last.

    Of several texts with that doc_id one stays, of wholly equal rows any one. Rows without words (null or empty texts) all stay; an empty table stays empty.
    """
    own, key, hash_ = free_names(docs, "own", "key", "hash")
    gone, several = (saved(d.select(F.col("doc_id").alias(key), F.col("text_hash").alias(hash_))) for d in NearDuplicates(docs).losers())
    text_hash = F.xxhash64("text")
    left = without(docs, gone, key, hash_, text_hash)
    if not several.isEmpty():
        bits = filter_bits(several.select(F.xxhash64(key).alias("hash")))
        marked = docs.where(may_hold(bits, F.xxhash64("doc_id"))).withColumn(own, text_hash)
        match = marked["doc_id"].eqNullSafe(several[key]) & (marked[own] == several[hash_])
        left = without(left, several, key, hash_, text_hash).unionByName(marked.join(several, match, "left_semi").dropDuplicates(["doc_id", own]).drop(own))
    return left
