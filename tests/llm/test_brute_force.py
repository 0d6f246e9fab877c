"""Secret scans, line dedup, sharding, mixing and the kept rows against plain Python accounts of the same rules."""

import collections
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkmere.llm import exact_dedup, language_id, line_templates, mixing, near_dedup, secret_scan, sharding

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def plain_base(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(a, ("assign", "access", "hex")[k], b) for a, k, b in sorted(found)]


def plain_linked(text, base):
    weak = [(m.start(), "identifier", m.end()) for m in secret_scan.IDENTIFIER.finditer(text)] + [(m.start(), "endpoint", m.end()) for m in secret_scan.ENDPOINT.finditer(text)]
    others = [*base, *weak]
    weak += [(m.start(), "key", m.end()) for m in secret_scan.KEY.finditer(text) if secret_scan.looks_like_key(m[0]) and all(b <= m.start() or m.end() <= a for a, _, b in others)]
    roles = {"assign": "secret", "hex": "secret", "key": "secret", "access": "identifier", "identifier": "identifier", "endpoint": "endpoint"}

    def near(at, role):
        return any(roles[k] == role and abs(a - at) <= 300 for a, k, _ in [*base, *weak])

    rule = {"key": lambda a: near(a, "identifier") or near(a, "endpoint"), "identifier": lambda a: near(a, "secret"), "endpoint": lambda a: near(a, "secret") and near(a, "identifier")}
    return [p for p in weak if rule[p[1]](p[0])]


def test_secrets(spark, corpus):
    key = "Zm9vYmFyMTIzNDU2Nzg5MEFCQ0RFRg"
    more = [(-1, f"user: ann {'pad ' * 60}{key} {'pad ' * 70}https://h.example/x token=abcdef1"), (-2, f"{key} " * 5 + "login = bob42"), (-3, "https://a.example secret: x " + "0" * 24)]
    every = corpus.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    order = {k: n for n, k in enumerate(secret_scan.KINDS)}
    for r in every.join(secret_scan.secret_report(every), "doc_id").collect():
        base = plain_base(r.text or "")
        spans = sorted([*base, *plain_linked(r.text or "", base)], key=lambda s: (s[0], order[s[1]], s[2]))
        assert r.spans == ",".join(f"{k}:{a}:{b}" for a, k, b in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for _, k, _ in base) for kind in ("assign", "access", "hex"))


def test_secrets_of_long_texts():
    text = "a https://h.example/0123456789abcdefghij " * 100_000
    assert len(secret_scan.weak_parts(text, secret_scan.base_spans(text))) == 100_000


def plain_lines(rows):
    """For each row the numbers of its recurring lines."""

    def mask(token):
        if not re.search("[0-9]", token):
            return token
        unspaced = "[" + re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), line_templates.UNSPACED) + "]"
        return re.sub("[0-9]+", "<*>", token) if re.search(unspaced, token) else "<*>"

    def number(line):
        return (xxhash.xxh64_intdigest(line.encode(), seed=42) + 2**63) % 2**64

    lines = [(k, at, " ".join(w for w in re.split(r"[\x20\x09-\x0D]+", line) if w)) for k, text in enumerate(rows) for at, line in enumerate((text or "").split("\n"))]
    lines = [(k, at, raw, " ".join(map(mask, raw.split(" ")))) for k, at, raw in lines if raw]
    held = collections.defaultdict(set)
    times, leaves = collections.Counter(), collections.defaultdict(set)
    for k, _, raw, line in lines:
        held[raw].add(k)
        times[line] += 1
        leaves[len(line.split(" ")), *line.split(" ")[:3]].add(line)
    template_of = {}
    for key, own in leaves.items():
        templates = []
        for line in sorted(own, key=lambda x: (-times[x], number(x))):
            tokens = line.split(" ")
            shares = [sum(a == b for a, b in zip(t, tokens, strict=True)) / len(tokens) for t in templates]
            best = shares.index(max(shares)) if shares else -1
            if best >= 0 and shares[best] >= 0.6:
                templates[best][:] = [a if a == b else "<*>" for a, b in zip(templates[best], tokens, strict=True)]
            else:
                templates.append(tokens)
                best = len(templates) - 1
            template_of[line] = (key, best, templates[best])
    docs = collections.defaultdict(set)
    for k, _, _, line in lines:
        docs[template_of[line][:2]].add(k)

    def recurs(line):
        n, template = len(docs[template_of[line][:2]]), template_of[line][2]
        size = sum(len(t.replace("<*>", "").encode()) for t in template)
        return n >= 2 and size >= 64 or n >= 5 and (sum(t != "<*>" for t in template) >= 2 or size >= 4)

    return {k: sorted(at for i, at, raw, line in lines if i == k and (len(held[raw]) > 1 or recurs(line))) for k in range(len(rows))}


def test_lines(spark, corpus):
    rows = [(k, r.text) for k, r in enumerate(corpus.collect())]
    rows += [(1000 + k, f"job {k} of host{k} ended in {k * k} ms\ntie a b\ntie a c\n" + "long " * (50 if k == 1 else 20_000) + f"{k}\n第{k}章 の 話\n\n \t") for k in range(6)]
    found = line_templates.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = plain_lines([t for _, t in rows])
    assert {r.doc_id: r.dropped for r in found} == {i: want[k] for k, (i, _) in enumerate(rows)}


def test_lines_of_a_split_leaf(spark, monkeypatch):
    monkeypatch.setattr(line_templates, "PART", 40)
    names = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    rows = [(k, f"the service of {name} was started by the operator\nthe service of {name} had {name}x {name}y {name}z then {name}w") for k, name in enumerate(names)]
    found = line_templates.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.dropped == [0] for r in found) and len(found) == 100


def scattered_lines(n):
    """Lines of one leaf that agree in some of their tokens, so that what a line joins hangs on those before it."""
    draw = random.Random(5)
    return [" ".join(["at", "this", "place", *(draw.choice("abc") + chr(103 + j) for j in range(7))]) for _ in range(n)]


def test_a_leaf_is_parsed_in_one_pass(spark):
    rows = list(enumerate(scattered_lines(2200)))  # more distinct lines than a part once had
    draw = random.Random(6)
    rows = [(k, f"{line} {draw.choice('uvwxyz')}{draw.choice('uvwxyz')}{draw.choice('uvwxyz')}") for k, line in rows]
    found = line_templates.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.dropped for r in found} == plain_lines([t for _, t in rows])


def test_templates_are_found_by_their_tokens(monkeypatch):
    lines = [line.split(" ") for line in scattered_lines(400)] + [["at", "this", "place", *(f"w{k % 90}{j}" if (k + j) % 3 else line_templates.VARIABLE for j in range(7))] for k in range(400)]
    plain, indexed = line_templates.Leaf(10), line_templates.Leaf(10)
    monkeypatch.setattr(line_templates, "INDEXED", 10_000)
    want = [plain.place(x) for x in lines]
    monkeypatch.setattr(line_templates, "INDEXED", 4)
    assert [indexed.place(x) for x in lines] == want and indexed.texts() == plain.texts() and indexed.holders is not None


def test_dissimilar_lines_of_one_leaf():
    leaf = line_templates.Leaf(8)
    for k in range(20_000):
        leaf.place(["a", "b", "c", *(f"w{k}_{j}" for j in range(5))])
    assert leaf.count == 20_000


def test_sharding_walks_the_ring(corpus):
    found = sharding.shard_report(corpus).collect()
    assert sorted(collections.Counter(r.shard for r in found).values())[0] >= len(found) // 24
    assert {r.doc_id: (r.shard, r.slot) for r in found} == {r.doc_id: (r.shard, r.slot) for r in sharding.shard_report(corpus.repartition(7)).collect()}


def test_mixing_passes_over_a_giant(spark):
    rows = [(k, "w " * (40_000 if k == 5 else 1 + k % 97), "a") for k in range(3000)] + [(k, "w " * 10, "b") for k in range(3000, 3600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed in (7, 8, 9):
        taken = mixing.mix(docs, seed=seed).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") / F.col("size")).alias("most")).collect()
        assert all(abs(r.taken - r.target) <= 0.005 * r.target and r.most <= 2 for r in taken)


def test_mixing_row_by_row(spark, corpus):
    """Sizes, targets and the draws of each source, told row by row."""
    rows = {(r.doc_id): len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in corpus.collect()}
    source = {r.doc_id: r.source for r in corpus.collect()}
    sizes = collections.Counter()
    for i, n in rows.items():
        sizes[source[i]] += n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        weight = {s: (3, 1, 2)[names.index(s) % 3] for s in open_}
        full = {s for s in open_ if left * weight[s] / sum(weight.values()) > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in full} if full else {s: left * weight[s] / sum(weight.values()) for s in open_}
        left -= sum(2.0 * sizes[s] for s in full)
        open_ = open_ - full if full else set()
    taken = collections.Counter()
    for r in mixing.mixing_report(corpus).collect():
        assert (r.size, r.source_size) == (rows[r.doc_id], sizes[source[r.doc_id]]) and r.target == pytest.approx(target[source[r.doc_id]])
        assert r.taken % max(1, r.size) == 0 and r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    for s in names:  # no further document fits where words are left
        fits = [n for i, n in rows.items() if source[i] == s and 0 < n <= target[s] - taken[s]]
        assert taken[s] <= target[s] and len(fits) < len(rows)


def test_mixed_rows_repeat_as_decided(spark):
    rows = [(1, "a b c", "s", 1)] * 3 + [(None, "d e", "s", 2), (2, None, "t", 3), (3, "f " * 20, "t", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, Hash int")
    copies = {(r.doc_id, r.size): r.c for r in mixing.mix(docs).groupBy("doc_id", "size").agg(F.sum("copies").alias("c")).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(copies.values())
    assert out.where("doc_id = 1").count() == copies[1, 3]


def test_mixed_rows_keep_their_source(spark):
    """Rows of one doc_id and text, but of other sources or languages, are rows of their own."""
    rows = [(1, "a b c d", "s", "en", {"k": 1}), (1, "a b c d", "t", "fr", {"k": 2}), (1, "a b c d", "t", "en", None)] + [(k, "e f g h", "st"[k % 2], "en", None) for k in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, more map<string, int>")
    decided = mixing.mix(docs.withColumn("own", mixing.whole_hash(docs, 7)), keep=["own"])
    want = {r.own: r.copies for r in decided.collect() if r.copies}
    out = mixing.mixed_documents(docs)
    got = collections.Counter(r.own for r in out.withColumn("own", mixing.whole_hash(out, 7)).collect())
    assert got == want and out.columns == docs.columns


def test_bloom_filter_in_rounds(spark, corpus, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_CELLS", exact_dedup.RANGE)
    monkeypatch.setattr(exact_dedup, "CELLS_PER_ROW", 4096)
    docs = corpus.unionByName(corpus.limit(20))
    slim = exact_dedup.saved(exact_dedup.hashed(docs))
    marked = exact_dedup.possibly_repeated(slim)
    assert slim.count() * 4096 > 2 * exact_dedup.RANGE and marked.count() == slim.count()
    often = {r.hash for r in slim.groupBy("hash").count().where("count > 1").collect()}
    assert often <= {r.hash for r in marked.where("again").collect()}
    assert marked.where("again").count() < slim.count() / 2
    assert exact_dedup.exact_duplicates(docs).where("kept").count() == corpus.selectExpr(r"sha2(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' '), 256)").distinct().count()


def test_kept_rows_of_near_copies(spark):
    base = [f"w{k}" for k in range(40)]
    near = " ".join([*base[:-1], "end"])
    other = " ".join(f"v{k}" for k in range(40))
    rows = [(5, " ".join(base), 1), (5, other, 2), (3, near, 3), (None, near + " ", 4), (None, "quite another text of few words here", 5), (7, other + " tail", 6), (7, other + " tail", 7), (8, None, 8), (8, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Key int")
    kept = sorted(r.Key for r in near_dedup.kept_documents(docs).collect())
    assert kept == [2, 3, 5, 8, 9]  # of each group the least doc_id; two rows of one doc_id are judged apart
    again = near_dedup.kept_documents(docs.where("doc_id = 7"))
    assert again.count() == 1 and again.columns == docs.columns and near_dedup.kept_documents(docs.limit(0)).count() == 0


def test_network_decides_what_is_recognised(spark):
    rows = [(k, "der hund und die katze laufen durch den garten " * 4 if k % 2 else "the dog and the cat are walking through the garden " * 4, "de" if k % 2 else "en", k) for k in range(60)]
    docs = spark.createDataFrame(rows + [(100, None, "en", 0), (101, "12 34", "en", 0)], "doc_id long, text string, lang string, Score int")
    network = language_id.trained(docs)
    assert language_id.recognised_documents(docs, network).count() == 60
    network.out[:] = 0  # both languages are as likely everywhere: nothing exceeds the other
    network.bias[:] = 0
    network.langs.append("xx")
    network.out, network.bias = np.zeros((3, network.out.shape[1]), np.float32), np.zeros((3, 1), np.float32)
    kept = language_id.recognised_documents(docs, network)
    assert kept.count() == 0 and kept.columns == docs.columns


def test_sample_bounds():
    found = language_id.bounds({"a": 10**10, "b": 3, "c": 2400}, 600)
    assert found["b"] == 2**63 - 1 and -(2**63) < found["a"] < found["c"] < 2**63
    assert (found["a"] + 2**63) / 2**64 * 10**10 == pytest.approx(1200)


def test_sample_is_exact(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "concat('text of ', id) AS text", "if(id % 1000 = 0, 'rare', 'often') AS lang")
    chosen = language_id.sample(docs.unionByName(docs.limit(50)))
    count = collections.Counter(r.lang for r in chosen)
    assert count["often"] == language_id.SAMPLE and 0 < count["rare"] <= 7
    assert sorted(chosen) == sorted(language_id.sample(docs.repartition(3).unionByName(docs.limit(50))))
