"""Sharding, mixing, the language network and the pipeline's stages against plain accounts, row by row."""

import collections
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sparkmere.llm import language_id, mixing, near_dedup, sharding
from tests.llm.test_operators import normal, shingles

SF = "/root/testdata/sf0.001"


def spark_hash(*values):
    """Spark's xxhash64 of several columns."""
    h = 42
    for v, kind in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if kind == "s" else struct.pack("<" + kind, v), seed=h)
    return h - 2**64 if h >= 2**63 else h


def walked(rows, shards, points=64):
    """doc_id, shard, slot by walking: round after round every arc offers what it has left to the next shard clockwise."""
    ring = sharding.ring_points(shards, points)
    places = [p for p, _ in ring]
    arcs = collections.defaultdict(list)
    for i, text in rows:
        size, crc = len((text or "").encode()) + 8, zlib.crc32((text or "").encode())
        place = spark_hash((text or "", "s")) if i is None else spark_hash((i, "q"))
        part = spark_hash((i, "q"), (crc, "q"), (size, "q")) % sharding.PARTS
        arcs[int(np.searchsorted(places, place)) % len(ring)].append((part, place, (i is not None, i or 0), crc, size, i))
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    used, left, found = [0] * shards, {a: sorted(own) for a, own in arcs.items()}, []
    for step in range(len(ring)):
        for arc in sorted(left):
            shard = ring[(arc + step) % len(ring)][1]
            while left[arc] and used[shard] < room[shard]:
                found.append((left[arc].pop(0)[-1], shard, used[shard]))
                used[shard] += 1
    return found


@pytest.mark.parametrize("shards", [3, 24])
def test_sharding_walk(spark, shards):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, "a"), (None, "b"), (-5, None), (2**40, "")], docs.schema)
    every = docs.unionByName(odd)
    found = [(r.doc_id, r.shard, r.slot) for r in sharding.shard(every, shards).collect()]
    assert sorted(found, key=str) == sorted(walked([tuple(r) for r in every.collect()], shards), key=str)


def test_sharding_moves(spark):
    """How many rows one more shard moves, as the README tells: 24 to 25 shards, without slack."""
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    a, b = ({r.doc_id: r.shard for r in sharding.shard(docs, n).collect()} for n in (24, 25))
    assert sum(a[k] != b[k] for k in a) / len(a) < 0.25


def plain_mix(rows, seed=7):
    """copies of each row (doc_id, text, source): whole passes, then blocks in permuted order, then of border blocks the largest documents that fit."""
    own = [(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), spark_hash((seed, "i"), (i, "q"), (t, "s")), s) for i, t, s in rows]
    sources = sorted({s for *_, s in own}, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for n, _, s in own if s == source) for source in sources]
    wanted = mixing.targets(sizes, [mixing.WEIGHTS[k % 3] for k in range(len(sources))])
    copies = [0] * len(rows)
    for k, source in enumerate(sources):
        mine = [j for j, r in enumerate(own) if r[2] == source]
        passes = int(wanted[k] // sizes[k]) if sizes[k] else 0
        blocks = max(1, int(len(mine) ** 0.5) // 8)
        block = {j: own[j][1] % blocks for j in mine}
        order = sorted(set(block.values()), key=lambda b: (spark_hash((seed + 1, "i"), (k, "i"), (b, "q")), b))
        for j in mine:
            copies[j] = passes
        left, past, near = wanted[k] - passes * sizes[k], -1, mixing.NEAR * (wanted[k] - passes * sizes[k])
        for _ in range(mixing.ROUNDS if left > 0 else 0):
            border, start, before = None, left, 0
            for p, b in enumerate(order):
                fitting = [j for j in mine if block[j] == b and 0 < own[j][0] <= start]
                total = sum(own[j][0] for j in fitting)
                if p <= past or not fitting or before >= start:
                    continue
                if before + total <= start:
                    before += total
                    for j in fitting:
                        copies[j] += 1
                else:
                    border, spare = p, start - before
                    for j in sorted((j for j in mine if block[j] == b and own[j][0] > 0), key=lambda j: (-own[j][0], own[j][1], j)):
                        if own[j][0] <= spare:
                            spare -= own[j][0]
                            copies[j] += 1
                    left = spare
                    break
            if border is None:
                break
            past = border
            if left <= near:
                break
    return copies


def test_mixing_draws(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("s"), F.col("doc_id") % 3)).alias("source"))
    rows = [tuple(r) for r in docs.collect()]
    many = [(1000 + k, "w " * (1 + k * 37 % 90), "big") for k in range(1500)] + [(9000, "w " * 30_000, "big"), (9001, None, "big"), (9002, "", None)]
    every = rows + many
    found = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(every, docs.schema)).collect()}
    want = dict(zip((i for i, _, _ in every), plain_mix(every)))
    assert found == want and len(set(want.values())) >= 2


def test_windows_lose_little(spark):
    """Pooled probabilities from windows against one pass of both directions over the whole text."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    network = language_id.trained(docs)
    texts = [r.text.encode() for r in docs.where("length(text) > 0").limit(40).collect()] + [b"a", "ünïcödé 日本語 ".encode() * 200]
    pooled = network.pooled(texts)
    for text, got in zip(texts, pooled):
        line = np.frombuffer(text, np.uint8).astype(np.int64)[:, None]
        states = []
        for net, order in ((network.ahead, range(len(line))), (network.behind, range(len(line) - 1, -1, -1))):
            h, own = np.zeros((language_id.UNITS, 1), np.float32), {}
            for t in order:
                h = net.step(line[t], h)[0]
                own[t] = h
            states.append(np.concatenate([own[t] for t in range(len(line))], axis=1))
        scores = network.out @ np.concatenate(states) + network.bias
        whole = language_id.softmax(scores.astype(np.float64)).mean(axis=1)
        assert np.abs(whole - got).max() < 0.02 and whole.argmax() == got.argmax()


def test_pipeline_row_by_row(spark, tmp_path):
    """Each stage's rows from its own input, with null ids, equal ids, clashing names and columns of their own."""
    import tiktoken

    from sparkmere.llm import bpe

    base = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    odd = [(None, "the same text of no id", "en", "s0", 1), (None, "the same text of no id", "en", "s0", 1), (7, "another text under seven is here", "en", None, 2), (7, None, "en", "s1", 3), (8, "123 456", "en", "s1", 3)]
    docs = base.unionByName(base.where("doc_id % 4 = 0")).unionByName(spark.createDataFrame(odd, base.schema)).withColumns({"Size": F.lit(1), "hash": F.lit("x"), "kept": F.lit(True), "keep_id": F.lit(0)})
    outs = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        outs[name] = docs
        if name != "bpe":
            assert docs.columns == before.columns
        given, left = ([tuple(r) for r in d.select("doc_id", "text", "source").collect()] for d in (before, docs if name != "bpe" else before))
        if name == "language_id":
            assert sorted(map(str, left)) == sorted(str(r) for r in given if r[1] and re.search(r"[^\W\d_]", r[1]))
        if name == "exact_dedup":
            first = {}
            for r in given:
                key = normal(r[1])
                if key not in first or (r[0] is None, r[0] or 0) < (first[key][0] is None, first[key][0] or 0):
                    first[key] = r
            assert sorted((str(r[0]), normal(r[1])) for r in left) == sorted((str(r[0]), key) for key, r in first.items())
        if name == "near_dedup":
            sets = [shingles(r[1]) for r in given]
            near = {(a, b) for a in range(len(given)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0}
            group = list(range(len(given)))
            for _ in given:
                for a, b in near:
                    group[a] = group[b] = min(group[a], group[b])
            best = {}
            for k, r in enumerate(given):
                rank = (r[0] is None, r[0] or 0)
                if group[k] not in best or rank < best[group[k]][0]:
                    best[group[k]] = (rank, r)
            assert sorted(str(r[0]) for r in left) == sorted(str(r[0]) for _, r in best.values()) and near_dedup.near_duplicates(docs).where("not kept").count() == 0
        if name == "mixing":
            want = collections.Counter({r: c for r, c in zip(given, plain_mix(given)) if c})
            assert collections.Counter(left) == want
        if name == "bpe":
            vocabulary = bpe.Vocabulary()
            ranks = {p: k for k, p in enumerate(vocabulary.pieces) if p is not None}
            own = tiktoken.Encoding("own", pat_str=vocabulary.pattern.removeprefix(bpe.UNICODE_FLAG), mergeable_ranks=ranks, special_tokens={})
            want = collections.Counter((r[0], len(own.encode_ordinary(r[1] or ""))) for r in given)
            assert collections.Counter((r.doc_id, r.n_tokens) for r in docs.collect()) == want


def test_rows_that_pass_straight_through(spark, monkeypatch):
    from sparkmere.llm import common

    keys = spark.range(0, 3000, 7).select(F.xxhash64("id").alias("hash"))
    bits = common.filter_bits(keys)
    asked = spark.range(3000).select("id", common.may_hold(bits, F.xxhash64("id")).alias("may")).collect()
    assert all(r.may for r in asked if r.id % 7 == 0) and sum(r.may for r in asked) < 900
    for most in (common.MOST_BITS, 64):  # a bitmap that is full lets nothing pass, and changes nothing
        monkeypatch.setattr(common, "MOST_BITS", most)
        docs = spark.createDataFrame([(k if k % 50 else None, f"text {k}", k) for k in range(400)], "doc_id long, text string, Flag int")
        gone = spark.createDataFrame([(k if k % 50 else None, f"text {k}") for k in range(0, 400, 5)], "id long, t string").select("id", F.xxhash64("t").alias("h"))
        left = common.without(docs, gone, "id", "h", F.xxhash64("text"))
        assert left.columns == docs.columns and sorted(r.Flag for r in left.collect()) == [k for k in range(400) if k % 5]
    assert len(common.filter_bits(keys.limit(0))) and not any(common.filter_bits(keys.limit(0)))
