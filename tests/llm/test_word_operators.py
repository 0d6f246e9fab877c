"""Decontamination, spelling variants and importance resampling against plain Python accounts of the same rules."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkmere.llm import decontamination, importance, queries, spelling, words

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, N_words long, items string, rank int, score int"
B = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
TEXTS = [
    (1, f"So: {B.upper()} nu."), (2, None), (3, ""), (4, " .\n"), (5, "short item"), (6, "a Short, ITEM! here"), (7, "x" * 70_000 + " " + B + " " + "y " * 4000), (None, B + " " + B),
    (8, "été — " + "é" * 40 + " short\titem"), (8, "été — " + "é" * 40 + " short\titem"), (9, B.replace("kappa", "cappa")), (10, "alpha beta gamma delta epsilon zeta eta theta iota\n"), (11, "kappa lambda mu"),
]
ITEMS = [(1, B), (2, "Short item"), (2, "short item"), (10, "beta gamma delta epsilon zeta eta theta iota kappa lambda"), (3, None), (4, "..."), (None, "Cappa"), (5, "absent words"), (12, B + " nu")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", -1, "x", 0, 0) for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination_by_hand(rows, items):
    windows = collections.defaultdict(set)
    for i, t in items:
        own = plain(t)
        for k in range(max(1, len(own) - 9) if own else 0):
            windows[tuple(own[k : k + 10])].add(i)
    longest = {len(w) for w in windows}
    for i, t in rows:
        own, hit, found = plain(t), set(), set()
        for n in longest:
            for k in range(len(own) - n + 1):
                w = tuple(own[k : k + n])
                if w in windows:
                    hit.update(range(k, k + n))
                    found |= windows[w]
        names = ",".join(sorted(str(x) for x in found if x is not None))
        yield i, len(own), len(hit), len(found - {None}), hashlib.sha256(names.encode()).hexdigest(), bool(hit)


def rows_of(df, *columns):
    return sorted(str(tuple(r)) for r in df.select(*columns).collect())


REPORT = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("round_bytes", [decontamination.ROUND_BYTES, 40])
def test_contamination(docs, benchmark, round_bytes):
    found = decontamination.contamination(docs, benchmark, round_bytes=round_bytes)
    assert rows_of(found, *REPORT) == sorted(map(str, contamination_by_hand(TEXTS, ITEMS)))
    assert rows_of(found, "firsts", "ends") == rows_of(decontamination.contamination(docs, benchmark), "firsts", "ends")
    assert decontamination.contamination(docs.limit(0), benchmark, round_bytes=round_bytes).count() == 0


def test_contamination_of_the_corpus(spark, corpus):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = list(contamination_by_hand([(r.doc_id, r.text) for r in corpus.collect()], items))
    assert rows_of(queries.op11_decontamination(spark, SF), *REPORT) == sorted(map(str, want)) and any(w[-1] for w in want)


def test_pieces_of_long_items(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE", 7)
    long = " ".join(f"w{k}" for k in range(60))
    texts = [(k, " ".join(f"w{j}" for j in range(k, k + 10))) for k in range(52)]
    found = decontamination.contamination(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(1, long)], "item_id long, text string"))
    assert {r.doc_id: r.n_hit for r in found.collect()} == {k: 10 * (k <= 50) for k in range(52)}


def test_windows_of_equal_hash(monkeypatch):
    monkeypatch.setattr(decontamination.Windows, "_hashes", staticmethod(lambda column, lengths: [(n, np.full(max(0, len(column(0)) - n + 1) if len(column(0)) > 4 else len(column(0)), 7, np.uint64)) for n in sorted(lengths)]))
    table = decontamination.Windows([("a", ["one", "two"]), ("b", ["two", "one"]), ("c", ["one"])])
    assert table.most == 3
    data = np.frombuffer(b"two one two six one", np.uint8)
    own, _, _, places = words.plain_words(data, np.array([0, len(data)]))
    place, window = table.of(own, places)
    assert sorted((int(p), table.items_of(np.array([w]))[0]) for p, w in zip(place, window, strict=True)) == [(0, "b"), (1, "a"), (1, "c"), (4, "c")]


def test_decontaminated_documents(spark, docs, benchmark):
    for round_bytes in (decontamination.ROUND_BYTES, 40):
        cut = decontamination.decontaminated(docs, benchmark, round_bytes=round_bytes)
        assert cut.columns == docs.columns and cut.count() == len(TEXTS)
        texts = {r.doc_id: r.text for r in cut.collect()}
        assert texts[1] == "So:  nu." or texts[1] == "So: ."
        assert texts[2] is None and texts[6] == "a ! here" and texts[8] == "été — " + "é" * 40 + " " and texts[10] == TEXTS[11][1]
        left = decontamination.decontaminated(docs, benchmark, "documents", round_bytes=round_bytes)
        assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 10, 11]
    with pytest.raises(ValueError):
        decontamination.decontaminated(docs, benchmark, "words")


def test_without_a_benchmark(docs, benchmark):
    assert decontamination.contamination(docs, benchmark.limit(0)).where("contaminated").count() == 0


def importance_by_hand(rows, target, buckets=10_000, longest=1, least=20, percent=10):
    def features(text):
        own = plain(text)
        return [" ".join(own[k : k + n]) for n in range(1, longest + 1) for k in range(len(own) - n + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s = collections.Counter(bucket(f) for _, t in rows for f in features(t))
    t = collections.Counter(bucket(f) for x in target for f in features(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for k, (i, text) in enumerate(rows):
        own = features(text)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain(text)) >= least, k])
    order = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(order[: percent * len(order) // 100]):
        r[4] = k + 1
    return sorted(str(tuple(r[:5])) for r in out)


RANKED = ("doc_id", "n_features", "weight", "score", "rank")


def test_importance_of_the_corpus(spark, corpus):
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = queries.op13_importance(spark, SF)
    assert rows_of(found, *RANKED) == importance_by_hand([(r.doc_id, r.text) for r in corpus.collect()], target)
    kept = importance.resampled_documents(corpus.withColumn("Score", F.lit(1)), spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert kept.columns == [*corpus.columns, "Score"] and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in found.where("rank IS NOT NULL").collect())


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_importance(docs, benchmark, longest):
    found = importance.resampling_report(docs, benchmark, buckets=50, longest=longest, least_words=2, percent=50)
    assert rows_of(found, *RANKED) == importance_by_hand(TEXTS, [t for _, t in ITEMS], 50, longest, 2, 50)
    assert importance.resampling_report(docs.limit(0), benchmark, buckets=50, longest=longest).count() == 0
    alone = importance.resampling_report(docs, benchmark.limit(0), buckets=50, longest=longest, least_words=2, percent=50)
    assert rows_of(alone, *RANKED) == importance_by_hand(TEXTS, [], 50, longest, 2, 50)
    assert importance.resampled_documents(docs, benchmark).count() == 0  # two texts of twenty words and more: a tenth of them is none


def spelling_by_hand(rows, damage=31, least=7, count=2, times=10):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= count}
    by_mask, near = collections.defaultdict(set), collections.defaultdict(set)
    for w in n:
        for k in range(len(w)):
            by_mask[w[:k] + "\0" + w[k + 1 :]].add(w)
            if w[:k] + w[k + 1 :] in n:
                near[w].add(w[:k] + w[k + 1 :])
                near[w[:k] + w[k + 1 :]].add(w)
    for own in by_mask.values():
        for w in own:
            near[w] |= own - {w}
    best = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: best[w] if best[w] and n[best[w]] >= times * n[w] else None for w in n}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        yield str((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))


VARIANT = ("word", "form", "root", "n", "n_near", "form_n")


def test_spelling_of_the_corpus(spark, corpus):
    assert rows_of(queries.op12_spelling(spark, SF), *VARIANT) == sorted(spelling_by_hand([(r.doc_id, r.text) for r in corpus.collect()]))


def test_spelling(spark, docs):
    chain = [("colours", 400), ("colour", 9999), ("colouurs", 30), ("coluurs", 3), ("coloürs", 40), ("ÀÉÎõüßÿ", 2), ("ÀÉÎõüßÿa", 21), ("aaaaaaaa", 3), ("aaaaaaaaa", 2), ("z" * 3000, 2), ("z" * 2999 + "y", 30), ("Colours", 20)]
    rows = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(chain)] + [(None, "colours\ncolours"), (99, "x×y÷zxyz x×y÷zxyz x×y÷zxy0"), (100, None), (101, "")] + TEXTS
    more = spark.createDataFrame(rows, "doc_id long, text string")
    for damage in (0, 2, 31):
        assert rows_of(spelling.spelling_variants(more, damage=damage), *VARIANT) == sorted(spelling_by_hand(rows, damage))
    found = {r.word: r.root for r in spelling.spelling_variants(more, damage=0).collect()}
    assert found["coluurs"] == "colours" and found["coloürs"] == "colours"
    assert spelling.spelling_variants(docs.limit(0)).count() == 0
    told = {(r.doc_id, r.word): (r.root, r.times) for r in spelling.respelled(more, spelling.spelling_variants(more, damage=0)).collect()}
    assert told[3, "coluurs"] == ("colours", 3) and (0, "colours") not in told


def test_collisions_are_told_apart(spark):
    def one_key(batches):
        for batch in spelling._keyed(batches):
            yield batch.set_column(0, "key", pa.array(np.full(batch.num_rows, -1)))

    rows = [("abcdefg", 2), ("abcdefh", 50), ("hgfedcb", 3), ("hgfedcba", 40), ("qqqqqqq", 9)]
    found = {r.word: (r.best and r.best.word, r.n_near) for r in spelling.near_words(spark.createDataFrame(rows, "word string, n long"), one_key).collect()}
    assert found == {"abcdefg": ("abcdefh", 1), "abcdefh": ("abcdefg", 1), "hgfedcb": ("hgfedcba", 1), "hgfedcba": ("hgfedcb", 1), "qqqqqqq": (None, 0)}


def test_checksums_go_on():
    own = [b"a", b"bcd" * 30, b"", b"colours", b"x" * 64]
    data = np.frombuffer(b"".join(own), np.uint8)
    lengths = np.array([len(w) for w in own])
    before = np.array([zlib.crc32(f"{k}:".encode()) for k in range(len(own))], np.uint32)
    assert spelling.checksums(data, np.cumsum(lengths) - lengths, lengths, before).tolist() == [zlib.crc32(f"{k}:".encode() + w) for k, w in enumerate(own)]


def test_shared_keys_over_batches():
    keys = [1, 1, 2, 3, 3, 3, 4, 5, 5]
    for size in (1, 2, 3, 9):
        parts = [pa.RecordBatch.from_arrays([pa.array(keys[k : k + size])], names=["key"]) for k in range(0, len(keys), size)]
        assert [x for b in spelling._shared(iter(parts)) for x in b.column(0).to_pylist()] == [1, 1, 3, 3, 3, 5, 5]
