"""Operators on small inputs whose results can be worked out by hand."""

import collections
import hashlib
import re
import types

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkmere.functions import text
from sparkmere.operators import evaluate, grams, graph, lexical, prior, pyramid, rerank, search, tags
from sparkmere.plans import log
from sparkmere.sources import parsers
from sparkmere.streaming.windows import windowed


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_edges(spark):
    nodes = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.8, 0.6]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])], "node_id long, vector array<double>")
    semantic = graph.semantic_edges(nodes, 0.5, block=2)
    assert [(a, b, round(w, 6)) for a, b, w in values(semantic)] == [(0, 1, 0.8), (1, 2, 0.6)]
    merged = {(r.src, r.dst): (round(r.weight, 6), r.kind) for r in graph.merged_edges(semantic, graph.consecutive_edges(nodes)).collect()}
    assert merged == {(0, 1): (0.95, "semantic"), (1, 2): (0.75, "semantic"), (2, 3): (0.15, "consecutive")}


def test_semantic_edges_is_strict_and_empty(spark):
    nodes = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0])], "node_id long, vector array<double>")
    assert values(graph.semantic_edges(nodes, 0.5)) == []
    assert values(graph.semantic_edges(nodes.limit(0), 0.5)) == []


def test_structural(spark):
    nodes = spark.createDataFrame([(0, ["a"]), (1, ["a", "b"]), (2, ["a", "c"]), (3, ["d"])], "node_id long, path array<string>")
    assert values(graph.structural_edges(nodes)) == [(0, 1, 0.2, "parent_child"), (0, 2, 0.2, "parent_child"), (1, 2, 0.1, "sibling")]


def test_wave_flows_and_dies(spark):
    sims = spark.createDataFrame([(7, 0, 1.0), (7, 1, -0.5), (7, 2, -0.5), (7, 3, -0.5)], "query_id long, node_id long, sim double")
    edges = graph.both_ways(spark.createDataFrame([(0, 1, 0.5), (1, 2, 0.5), (2, 3, 0.01)], "src long, dst long, weight double"))
    found = {r.node_id: round(r.amplitude, 6) for r in search.wave(sims, edges, sources=1).collect()}
    assert found == {0: 1.0, 1: 0.35, 2: 0.1225}
    summed = {r.node_id: round(r.amplitude, 6) for r in search.wave(sims, edges, "sum", sources=1).collect()}
    assert summed[0] == round(1 + 0.35 * 0.35, 6)


def test_cooccurrence_direction(spark):
    positions = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "manual long, tag long, position int")
    found = {(r.src, r.dst): round(r.weight, 6) for r in tags.cooccurrence(positions).collect()}
    assert found == {(10, 11): round(0.9 * 0.7, 6), (10, 12): 0.45, (11, 12): 0.35}


def test_spike(spark):
    seeds = spark.createDataFrame([(1, 0, 1.0)], "query_id long, tag long, energy double")
    chain = spark.createDataFrame([(0, 1, 0.8), (1, 2, 1.5)], "src long, dst long, weight double")
    found = {r.tag: round(r.energy, 6) for r in tags.spike(seeds, chain).collect()}
    assert found == {0: 1.0, 1: 0.2, 2: round(0.2 * 1.5 * 0.7, 6)}


def plain_basis(vectors, order, clusters=32):
    centres = vectors[order[:clusters]].copy()
    for _ in range(25):
        own = ((vectors[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([vectors[own == k].mean(axis=0) if (own == k).any() else centres[k] for k in range(len(centres))])
        done, centres = np.allclose(moved, centres, atol=1e-9), moved
        if done:
            break
    sizes = np.bincount(own, minlength=len(centres))
    mean = (centres * sizes[:, None]).sum(axis=0) / sizes.sum()
    return mean, np.linalg.svd((centres - mean) * np.sqrt(sizes)[:, None], full_matrices=False)[1] ** 2


def test_energy_basis(spark):
    vectors = np.random.default_rng(0).normal(size=(200, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "node_id long, vector array<double>").repartition(3)
    order = [r.node_id for r in df.orderBy(F.xxhash64(F.lit(42), "node_id")).collect()]
    axes, mean, energies = pyramid.energy_basis(df, starts=0)
    want_mean, want = plain_basis(vectors, order)
    assert np.allclose(mean, want_mean) and np.allclose(energies, want[: len(energies)]) and np.allclose(axes @ axes.T, np.eye(len(axes)), atol=1e-9)
    assert 8 <= len(axes) <= 16 and energies.sum() / want.sum() >= 0.95
    few = pyramid.energy_basis(df.limit(15))
    assert np.array_equal(few[0], np.eye(16)[:8]) and len(pyramid.energy_basis(df.limit(0))[0]) == 0
    p = pyramid.projection(df.select(F.col("node_id").alias("query_id"), "vector"), axes, mean).orderBy("query_id").first().p
    energy = (axes @ (vectors[0] - mean)) ** 2
    assert np.allclose(p, energy / energy.sum())


def test_parallel_starts(spark):
    rng = np.random.default_rng(21)
    homes = rng.normal(size=(24, 6)) * 6
    vectors = np.concatenate([homes[rng.integers(0, 24, 700)] + rng.normal(size=(700, 6)) * 0.4, np.zeros((30, 6))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "node_id long, vector array<double>").repartition(3)

    def plain(seed):
        centres = vectors[np.random.default_rng(seed).choice(len(vectors), 24, replace=False)]
        for _ in range(25):
            own = ((vectors[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
            centres = np.array([vectors[own == k].mean(axis=0) if (own == k).any() else centres[k] for k in range(24)])
        return ((vectors[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum()

    centres, sizes, inertia = pyramid.best_clusters(df, 24, 3)
    assert inertia <= 1.05 * min(map(plain, range(20))) and sizes.sum() == len(vectors)
    assert abs(inertia - ((vectors[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum()) < 1e-6 * inertia
    again = pyramid.parallel_start(df.repartition(5), 24, 42)
    assert np.allclose(np.sort(again, axis=0), np.sort(pyramid.parallel_start(df, 24, 42), axis=0)) and again.shape == (24, 6)
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(40)], "node_id long, vector array<double>")
    assert pyramid.best_clusters(same, 3)[2] == 0 and pyramid.parallel_start(same, 3, 1).shape == (3, 2)
    axes = pyramid.energy_basis(df, 24)[0]
    mean = (centres * sizes[:, None]).sum(axis=0) / sizes.sum()
    want = np.linalg.svd((centres - mean) * np.sqrt(sizes)[:, None], full_matrices=False)[2][: len(axes)]
    assert np.allclose(axes.T @ axes, want.T @ want, atol=0.05)  # the axes span the same space
    assert [pyramid.needs_training(*x) for x in ((10, None), (10, 10), (12, 10), (11, 10), (0, 0), (1, 0))] == [True, False, True, False, False, True] and pyramid.needs_training(10, 10, dirty=True)


def test_residual_pyramid(spark):
    rng = np.random.default_rng(1)
    ids, tags = np.arange(60), rng.normal(size=(60, 24))
    query = rng.normal(size=24)
    want, rest, used = [], query.copy(), set()
    for level in range(3):
        near = sorted((k for k in ids if k not in used), key=lambda k: (-(tags[k] @ rest) / np.linalg.norm(tags[k]), k))[:10]
        used |= set(near)
        basis = np.linalg.qr(tags[near].T)[0].T
        coefficients = np.abs(basis @ rest)
        rest = rest - basis.T @ (basis @ rest)
        want += [(level, int(k), c, rest @ rest / (query @ query)) for k, c in zip(near, coefficients)]
        if want[-1][3] < 0.1:
            break
    vectors = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(ids, tags)] + [(99, [0.0] * 24)], "node_id long, vector array<double>")
    asked = spark.createDataFrame([(7, query.tolist())], "query_id long, vector array<double>")
    found = sorted((r.level, r.tag, r.coefficient, r.residual) for r in pyramid.residual_pyramid(asked, vectors).collect())
    assert [x[:2] for x in found] == sorted(x[:2] for x in want) and np.allclose([x[2:] for x in found], [x[2:] for x in sorted(want)])


def test_token_classes(spark):
    row = spark.createDataFrame([("E05 and WM-8000 the washers 123",)], "t string").select(F.transform(text.tokens(F.col("t")), text.token_class).alias("k")).head()
    assert row.k == ["exact_code", None, "model", None, "ordinary", None]
    words = spark.createDataFrame([("batteries",), ("glasses",), ("boxes",), ("glass",), ("is",)], "w string").select(text.singular(F.col("w")).alias("s"))
    assert [r.s for r in words.collect()] == ["battery", "glass", "box", "glass", "is"]


def test_cjk_terms(spark):
    row = spark.createDataFrame([("机器人 x 你",)], "t string").select(text.cjk_terms(F.col("t")).alias("k")).head()
    assert row.k == ["机器人", "机器", "器人"]


def one_singular(w):
    if len(w) > 4 and w.endswith("ies"):
        return w[:-3] + "y"
    if len(w) > 5 and w.endswith("sses") or len(w) > 4 and w.endswith(("ches", "shes", "xes", "zes")):
        return w[:-2]
    return w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w


def compacted(value):
    return re.sub("[^a-z0-9\u3400-\u9fff]+", "", value.lower())


def terms_of(query):
    """(codes, models, ordinary terms, CJK terms, ordinary terms in order) of a question."""
    low, codes, models, ordered = query.strip().lower(), set(), set(), []
    for raw in re.findall(r"\b[a-z]{1,4}\s+\d{1,5}[a-z0-9]*\b", low):
        codes |= {raw, compacted(raw)}
    for t in re.findall(text.TOKEN, low):
        flat = compacted(t)
        if t.isdigit():
            continue
        if len(flat) >= 4 and re.search("[a-z]", flat) and re.search("[0-9]", flat):
            models |= {t, flat}
        elif re.search(text.CODE, t) or re.search(text.CODE, flat):
            codes |= {t, flat}
        elif len(t) >= 2 and t not in text.STOP_WORDS:
            ordered.append(t)
    runs = [r for r in re.findall(text.CJK, low) if len(r) >= 2]
    cjk = {*runs, *(r[k : k + n] for r in runs for n in (2, 3) for k in range(len(r) - n + 1))} - set(text.CJK_STOP_TERMS)
    return codes, models, set(ordered), cjk, ordered


def full_score(query, heading, body, identity, web, boost=0.2):
    """The lexical score of one node, field by field, text by text."""
    codes, models, ordinary, cjk, ordered = terms_of(query)
    score = ties = 0.0
    for name, weight, value in (("heading", 1.0, heading), ("body", 0.9, body), ("identity", 0.85, identity)):
        low = value.lower()
        words = re.findall(text.TOKEN, low)
        if name != "body":
            score += weight * (0.15 * any(c in low or compacted(c) in compacted(low) for c in codes) + 0.12 * any(m in low or compacted(m) in compacted(low) for m in models))
        hits = sum(t in low or one_singular(t) in set(map(one_singular, words)) for t in ordinary) + sum(t in low for t in cjk)
        if name != "identity":
            score += boost * weight * min(4, hits)
        if name == "body":
            pairs = sum(bool(re.search(rf"\b{re.escape(a)}\b(?:\W+\w+){{0,2}}\W+\b{re.escape(b)}\b", low)) for a, b in zip(ordered, ordered[1:]))
            score += boost * weight * 0.5 * min(2, pairs)
            best, ones = 0, list(map(one_singular, words))
            for p in range(len(ones)) if web and len(ordinary) >= 3 and len(ones) >= 24 else ():
                best = max(best, len(ordinary & set(ones[p : p + 14])))
                if best >= 5:
                    break
            compact = max(0, best - 2)
            if web:
                score += boost * weight * 0.35 * min(2, compact)
                ties = min(0.12 * boost, boost * (0.01 * min(8, hits) + 0.015 * min(4, compact)))
    return round(min(score, 1.6) + ties, 5) if score > 0 else None


def test_full_lexical_scores_by_brute_force(spark, monkeypatch):
    asked = [
        (1, "机器人清洁 洗衣机"), (2, "Clean the water tank filters"), (3, "E05 WM-8000 batteries 清洁"), (4, ""), (5, None), (6, "清洁机器人怎么充电池"), (7, "tank tank water tank"), (8, "error E 05 on wm 8000x"),
        (9, "alpha beta gamma delta epsilon zeta eta theta"), (10, "a-7 x_9 wi-fi water_tank re-set now"),
    ]
    pad = " pad" * 20
    greek = "alpha beta gamma delta epsilon zeta eta theta"
    bodies = [
        "用清洁机器人清洁", "clean x y tank of water", "clean the water tank filter" + pad, "water" + pad + " clean tank filter", "WM-8000 battery e05 tank", "清洁机器人怎么充电池了 E05",
        "洗衣机", "Clean filters" + pad + " clean water tank", "", "tank, tank: water 机器", "see e05 wm-8000", "cleaner watertanks prefilter", greek + pad, pad + " " + greek, "alpha beta" + pad + " gamma alpha delta epsilon beta alpha zeta eta",
        "re-set wi-fi, now: water_tank é wi-fi " + pad, "x_9 a7 wi fi re set",
    ]
    heads = ["", "E05", "wm8000 x", "Error e-05 water", "Clean the water-tank", "WM 8000X filters", "x9 a-7"]
    nodes = [(k, heads[k % 7], b, "web E05" if k % 2 else "wm-8000 机器 E 05", k % 3 != 1) for k, b in enumerate(bodies)]
    nodes += [(100 + k, "", b * 3, None, True) for k, b in enumerate(bodies)]
    table = spark.createDataFrame(nodes, "node_id long, heading string, body string, identity string, web boolean")
    want = {(q, n[0]): full_score(t or "", *(x or "" for x in n[1:4]), n[4]) for q, t in asked for n in nodes}
    queries = spark.createDataFrame(asked, "query_id long, text string")
    for together, part in ((1024, 4096), (3, 5)):
        monkeypatch.setattr(lexical, "QUERIES", together)
        monkeypatch.setattr(lexical, "PART", part)
        found = lexical.full_lexical_scores(queries, table, {n: n for n in ("heading", "body", "identity")})
        assert {(r.query_id, r.node_id): round(r.score, 5) for r in found.collect()} == {k: v for k, v in want.items() if v is not None}
    assert want[1, 0] and want[6, 5]
    best = lexical.full_lexical_topk(queries, table, {n: n for n in ("heading", "body", "identity")}, 3).collect()
    for q, _ in asked:
        order = sorted(((-v, n) for (k, n), v in want.items() if k == q and v is not None))[:3]
        assert [(r.rank, r.node_id) for r in sorted(best, key=lambda r: r.rank) if r.query_id == q] == [(k + 1, n) for k, (_, n) in enumerate(order)]


def plain_prior(query, header, body, source_file, manual):
    codes, models, ordinary, cjk, ordered = terms_of(query)
    head, low = header.lower(), body.lower()
    if not (codes or models or ordinary or cjk) or not f"{head}\n{low}".strip():
        return 0.0
    ones = set(map(one_singular, ordinary))
    share = lambda terms, where: sum(t in where or t in set(map(one_singular, re.findall(text.TOKEN, where))) for t in terms) / max(1, len(terms))
    score = 0.45 * share(ones, low) + 0.16 * share(ones, head) + 0.42 * sum(t in low for t in cjk) / max(1, len(cjk)) + 0.18 * sum(t in head for t in cjk) / max(1, len(cjk))
    score += 0.08 * min(2, sum(bool(re.search(rf"\b{re.escape(a)}\b(?:\W+\w+){{0,2}}\W+\b{re.escape(b)}\b", low)) for a, b in zip(ordered, ordered[1:])))
    words = list(map(one_singular, re.findall(text.TOKEN, low)))
    best = max((len(ordinary & set(words[p : p + 14])) for p in range(len(words))), default=0) if len(ordinary) >= 3 and len(words) >= 24 else 0
    score += 0.08 * min(2, max(0, best - 2))
    identity = " ".join([source_file, manual, header]).lower()
    score += 0.16 * any(c in identity or compacted(c) in compacted(identity) for c in codes | models)
    bonus = 0.0
    for t in map(compacted, cjk | ordinary) if compacted(header) else ():
        bonus = max(bonus, 0.18 if len(t) >= 2 and compacted(header) == t else 0.08 if len(t) >= 3 and t in compacted(header) and compacted(header) in compacted(query) else 0.0)
    score += bonus
    size = len(re.findall(text.TOKEN, low)) + len(re.findall(text.CJK, low))
    score *= 1 if cjk else 0.35 if size < 8 else 0.65 if size < 18 else 1
    return round(min(0.85, max(0.0, score)), 6)


def test_prior_by_brute_force(spark):
    asked = [(1, "机器人清洁 洗衣机"), (2, "Clean the water tank filters"), (3, "E05 WM-8000 batteries 清洁"), (4, ""), (5, None), (6, "tank tank water tank"), (7, "error E 05 of the"), (8, "alpha beta gamma delta epsilon"), (9, "the of")]
    pad = " pad" * 20
    bodies = ["用清洁机器人清洁", "clean x y tank of water", "clean the water tank filter" + pad, "water" + pad + " clean tank filter", "E05 battery", "", "Alpha beta" + pad + " gamma delta beta epsilon alpha", "cleaner watertanks, prefilter of a tank with water and more of it all here too"]
    heads = ["清洁", "Water-Tank", "clean the water tank filters", "E 05", "", "tank", "机器人清洁"]
    nodes = [(k, heads[k % 7], b, "x/wm8000.pdf" if k % 3 else "", "e05" if k % 2 else "m") for k, b in enumerate(bodies)] + [(50, None, None, None, None), (51, "tank", "tank", None, None)]
    pairs = spark.createDataFrame([(q, *n) for q, _ in asked for n in nodes], "query_id long, node_id long, header string, body string, source_file string, manual string")
    found = {(r.query_id, r.node_id): round(r.prior, 6) for r in prior.evidence_prior(pairs, spark.createDataFrame(asked, "query_id long, text string")).collect()}
    assert found == {(q, n[0]): plain_prior(t or "", *(x or "" for x in n[1:])) for q, t in asked for n in nodes}
    assert len({v for v in found.values()}) > 12
    scored = spark.createDataFrame([(1, 7, 0.5), (1, 8, 0.5), (1, 9, 0.5), (1, 3, 0.9), (1, 2, 0.1)], "query_id long, node_id long, score double")
    told = spark.createDataFrame([(1, 8, 0.3), (1, 9, 0.3)], "query_id long, node_id long, prior double")
    assert [r.node_id for r in prior.final_rank(scored, told, 4).orderBy("rank").collect()] == [3, 8, 9, 7]


def test_windows_word_by_word():
    rng = np.random.default_rng(3)
    for n in (10, 24, 60, 300):
        for _ in range(30):
            chunk = lexical.Asked([], [{"query_id": k, "terms": [f"w{j}" for j in rng.choice(12, rng.integers(1, 9), replace=False)]} for k in range(6)])
            words = [f"w{j}" for j in rng.integers(0, 40, n)]
            places, numbers, count, _ = chunk.body(" ".join(words))
            found = chunk.windows(np.array(places, np.int64), np.array(numbers, np.int64), count)
            for k, own in enumerate(chunk.window.T):
                terms, best = {t for t, j in chunk.words.items() if own[j]}, 0
                for p in range(n if n >= 24 and len(terms) >= 3 else 0):
                    best = max(best, len(terms & set(words[p : p + 14])))
                    if best >= 5:
                        break
                assert found[k] == max(0, best - 2)


def test_containing(spark):
    rng = np.random.default_rng(5)
    values = ["".join(rng.choice(list("abc-"), rng.integers(0, 12))) for _ in range(300)] + [None, "", "机器人清洁"]
    terms = ["".join(rng.choice(list("abc-"), rng.integers(0, 6))) for _ in range(60)] + ["器人", "zzz", None, ""]
    found = grams.containing(spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame(list(enumerate(terms)), "no int, term string"))
    assert sorted((r.value, r.no) for r in found.collect()) == sorted((v, k) for v in {v for v in values if v} for k, t in enumerate(terms) if t and t in v)


def test_coverage_by_rare_terms(spark):
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(3000)]
    weights = np.arange(1, 3001.0) ** -0.8
    docs = [(k, " ".join(["the", "of", *rng.choice(words, 30, p=weights / weights.sum())])) for k in range(600)] + [(600, None), (601, "")]
    asked = [(q, " ".join(["the", "of", *rng.choice(docs[q * 7][1].split(), 6), *rng.choice(words, 3)])) for q in range(40)] + [(90, "the of"), (91, "absent words"), (92, ""), (93, None), (94, "absent the w0")]
    nodes, queries = spark.createDataFrame(docs, "node_id long, text string"), spark.createDataFrame(asked, "query_id long, text string")
    held = {k: set((t or "").split()) for k, t in docs}
    want = []
    for q, t in asked:
        terms = set((t or "").split())
        order = sorted((-len(terms & own), k) for k, own in held.items() if terms & own)[:5]
        want += [(q, k, round(-n / len(terms), 9), r + 1) for r, (n, k) in enumerate(order)]
    for floors in (lexical.FLOORS, (0.9, 0.0), (0.0,)):
        found = lexical.coverage_topk(queries, nodes, 5, floors).collect()
        assert sorted((r.query_id, r.node_id, round(r.coverage, 9), r["rank"]) for r in found) == sorted(want)
    first = lexical.rare_first(queries.where("query_id < 40"), nodes)
    few = lexical.rare_candidates(first, nodes, 0.6, 5).count()
    every = sum(bool(set(t.split()) & own) for q, t in asked if q < 40 for own in held.values())
    assert every == 40 * 600 and few < every / 8  # lists of frequent words are not read
    assert lexical.coverage_topk(queries.limit(0), nodes, 5).count() == 0


def test_limiter(spark):
    events = spark.createDataFrame([(1, k, f"2024-01-01 00:00:{k:02d}") for k in range(4)], "key long, event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert [r.allowed for r in rerank.limited(events, 60, 2).orderBy("event_id").collect()] == [True, True, False, False]


def test_calibration_of_equal_scores(spark):
    rows = spark.createDataFrame([(1, 3.0), (1, 3.0), (2, 9.0), (3, 0.0), (3, 2.0)], "query_id long, score double")
    assert values(rerank.calibrated(rows, "minmax").select("query_id", "calibrated")) == [(1, 0.5), (1, 0.5), (2, 0.5), (3, 0.0), (3, 1.0)]


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([(1, 1, 5, False), (1, 2, 6, True)], "query_id long, rank int, node_id long, matched boolean")
    expected = spark.createDataFrame([(1, 2), (2, 1)], "query_id long, n long")
    found = values(evaluate.ranking_metrics(ranked, expected, 5))
    assert found == [(1, 0.2, 0.5, 0.5, 1.0, 2), (2, 0.0, 0.0, 0.0, 0.0, None)]


def test_filters_are_checked():
    assert log.parsed_filters("intent=a, created_after=2024-01-01") == {"intent": "a", "created_after": "2024-01-01"}
    for bad in ("x=1", "intent=a,intent=b", "intent"):
        with pytest.raises(ValueError, match="bad filter"):
            log.parsed_filters(bad)


def test_markdown_and_html(spark):
    docs = spark.createDataFrame([(1, "intro\n# One\nbody\n## Two #\nmore")], "doc_id long, text string")
    found = parsers.markdown_sections(docs).orderBy("section").collect()
    assert [(r.level, r.header, r.start_line) for r in found] == [(0, "", 1), (1, "One", 2), (2, "Two #", 4)]
    pages = spark.createDataFrame([(1, "<svg><title>icon</title></svg><title>T</title><nav>x</nav><p>a</p><main><p>b &amp; c</p><p>b<br>&amp; c</p></main>"), (2, None)], "page_id long, html string")
    assert [(r.title, r.blocks) for r in parsers.html_blocks(pages).orderBy("page_id").collect()] == [("T", ["b & c"]), ("", [])]


def hashed(value):
    value = value or ""
    found = re.findall(r"[a-z0-9]+|[^a-z0-9 \t\n\r\f]", value.lower()) + [p for p in map("".join, zip(value, value[1:])) if p.strip(" \t\n\r\f\v")]
    return collections.Counter(int(hashlib.sha256(t.encode()).hexdigest()[:8], 16) % 64 for t in found)


def test_hashing_of_whole_texts(spark):
    texts = {1: None, 2: "", 3: " \n\t", 4: "x", 5: "Ab cd-1\n\n z", 6: "日本🎉語 é🎉", 7: "Wörter und 🎉 words. " * 5000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert values(parsers.hash_buckets(docs)) == sorted((k, b, n) for k, t in texts.items() for b, n in hashed(t).items())
    found = {r.doc_id: r.vector for r in parsers.hash_embedding(docs).collect()}
    assert set(found) == set(texts)
    for k, t in texts.items():
        want = np.array([hashed(t)[b] for b in range(64)], float)
        assert np.allclose(found[k], want / (np.linalg.norm(want) or 1.0))


def test_documents_are_hashed(spark):
    from sparkmere import catalogue

    catalogue.load_all()
    sf = "/root/testdata/sf0.001"
    found = catalogue.QUERIES["hashing_embed_documents"](spark, sf)
    assert found.count() == spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").distinct().count()


def test_stream_equals_batch(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(source)
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    rows = windowed(stream, late="1 day")
    running = rows.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).start()
    running.processAllAvailable()
    running.stop()
    assert sorted(map(str, spark.sql("SELECT start, event_type, n FROM windows").collect())) == sorted(map(str, windowed(batch).select("start", "event_type", "n").collect()))


def test_hits_leave_a_task_in_few_batches():
    asked = lexical.Asked([{"query_id": q, "term": f"t{q}", "kind": "ordinary"} for q in range(5)], [{"query_id": q, "terms": []} for q in range(5)])
    rows = [{"node_id": k, "heading": [k % 5], "body": [k % 5, (k + 1) % 5], "codes_heading": [], "codes_identity": []} for k in range(700)]
    schema = pa.schema([("node_id", pa.int64()), *((n, pa.list_(pa.int32())) for n in ("heading", "body", "codes_heading", "codes_identity"))])
    found = list(lexical._counted(types.SimpleNamespace(value=asked))([pa.RecordBatch.from_pylist(rows, schema)]))
    assert len(found) == 2  # one for each lexical.NODES rows, not one for each node and field
    told = sorted((r["node_id"], r["field"], r["query_id"], r["codes"], r["models"], r["hits"]) for b in found for r in b.to_pylist())
    assert told == sorted((k, f, q, 0, 0, 1) for k in range(700) for f, q in (("heading", k % 5), ("body", k % 5), ("body", (k + 1) % 5)))
