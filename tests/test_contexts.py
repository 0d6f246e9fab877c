"""Contexts, page order and interval joins against plain Python accounts of their rules."""

import re

import numpy as np
from pyspark.sql import functions as F

from sparkmere.operators import compaction, contexts, evidence, intervals
from tests.test_wording import plain_compacted, plain_usefulness

SCHEMA = "query_id long, rank int, node_id long, source string, section string, page_first long, page_last long, score double, text string, asked array<string>"


def plain_terms(text):
    return {w for w in re.findall("[a-z0-9㐀-鿿]+", text.lower()) if len(w) > 1}


def tokens(text):
    return max(1, (len(text) + 3) // 4)


def plain_context(rows, asked, budget, most=3):
    target = max(48, min(180, int(budget * 0.45)))
    rows = [dict(zip(("rank", "node", "source", "section", "first", "last", "score", "text"), r)) for r in rows]
    for r in rows:
        r["text"] = r["text"] or ""
        r["words"] = plain_terms(r["text"])
        r["cover"] = len(r["words"] & asked) / len(asked) if asked else 0.0
        r["use"] = plain_usefulness(r["text"], asked)
        r["content"] = plain_compacted(r["text"], asked, target)
    top = max(r["score"] for r in rows)
    for r in rows:
        r["value"] = r["use"]
        if r["cover"] >= 0.3:
            r["value"] += (min(0.28, 0.28 * max(0.0, r["score"]) / top) if top > 0 else 0) + min(0.04, 0.04 / max(1, r["rank"] - 1))
    chosen, left, used = [], list(rows), 0
    while fit := [r for r in left if used + tokens(r["content"]) <= budget]:
        gain = lambda r: r["value"] - 0.35 * max((len(r["words"] & c["words"]) / max(1, len(r["words"] | c["words"])) for c in chosen), default=0)
        best = max(fit, key=lambda r: (gain(r), r["score"], -r["rank"]))
        chosen.append(best)
        left.remove(best)
        used += tokens(best["content"])
    out, gone, used = [], set(), 0
    for place, r in enumerate(chosen, 1):
        if r["rank"] in gone:
            continue
        near = []
        for c in rows:
            if c is r or c["rank"] in gone or c["source"] != r["source"] or abs(c["node"] - r["node"]) > 5 or not (c["cover"] >= 0.3 or c["use"] >= 0.45):
                continue
            if c["first"] is not None and r["first"] is not None:
                if c["first"] > r["last"] or r["first"] > c["last"]:
                    continue
            elif c["first"] is None and r["first"] is None and c["section"] != r["section"]:
                continue
            near.append(c)
        near.sort(key=lambda c: (-c["use"], -c["score"], abs(c["node"] - r["node"]), c["rank"]))
        content, refs, ranks = r["content"], [r["node"]], [r["rank"]]
        for c in near[:most]:
            whole = (content.rstrip() + "\n\n" + c["content"].strip()).strip()
            if tokens(whole) > budget - used:
                room = max(1, budget - used - tokens(content))
                short = plain_compacted(c["text"], asked, room) if tokens(c["text"]) > room else c["text"]
                if tokens(short) > room or short.strip() == c["text"].strip():
                    continue
                whole = (content.rstrip() + "\n\n" + short.strip()).strip()
                if tokens(whole) > budget - used:
                    continue
            content = whole
            refs.append(c["node"])
            ranks.append(c["rank"])
            gone.add(c["rank"])
        used += tokens(content)
        out.append((place, r["node"], content, refs, tokens(content), ranks))
    return out


def evidence_of(rng, n):
    words = "the pump is a part of machine filter means clean must open lid water tank safety use if when steam hose coffee".split()
    rows = []
    for rank in range(1, n + 1):
        text = ". ".join(" ".join(rng.choice(words, rng.integers(3, 14))).capitalize() for _ in range(rng.integers(1, 9))) + "."
        first = None if rng.random() < 0.3 else int(rng.integers(0, 30))
        rows.append((rank, int(rng.integers(0, 12)) * 2 + rank % 2 * 40 + rank, "ab"[rng.integers(0, 2)], "st"[rng.integers(0, 2)], first, None if first is None else first + int(rng.integers(0, 40)), round(1 - rank * 0.05, 3), None if rng.random() < 0.05 else text))
    return rows


def test_contexts(spark):
    rng = np.random.default_rng(11)
    asked = {1: {"pump", "filter", "clean"}, 2: {"water", "steam"}, 3: set(), 4: {"lid", "tank", "hose", "coffee", "use"}}
    rows = {q: evidence_of(rng, 12) for q in asked}
    table = spark.createDataFrame([(q, *r, sorted(asked[q])) for q, own in rows.items() for r in own], SCHEMA)
    merged = 0
    for budget in (60, 250, 2000):
        for most in (0, 3):
            found = contexts.contexts(table, budget, most).collect()
            for q, own in rows.items():
                want = plain_context(own, asked[q], budget, most)
                assert [(r.place, r.node_id, r.content, r.refs, r.tokens, r.ranks) for r in sorted(found, key=lambda r: r.place) if r.query_id == q] == want
                merged += sum(len(w[3]) - 1 for w in want)
    assert merged > 10
    told = contexts.diagnostics(contexts.scored(table), contexts.contexts(table, 250)).collect()
    held = {(q, k): item[0] for q, own in rows.items() for item in plain_context(own, asked[q], 250) for k in item[5]}
    assert len(told) == 48 and all((r.selected, r.place) == ((r.query_id, r["rank"]) in held, held.get((r.query_id, r["rank"]))) for r in told)
    assert contexts.contexts(table.limit(0), 250).count() == 0
    queries = spark.createDataFrame([(q,) for q in (*asked, 9)], "query_id long")
    for budget in (5, 250):
        told = {r.query_id: tuple(r)[1:] for r in contexts.inspected(queries, table, contexts.contexts(table, budget), budget).collect()}
        for q, own in rows.items():
            want = plain_context(own, asked[q], budget)
            reason = "" if want else "context_budget_exhausted"
            assert told[q] == (12, len(want), sum(len(w[3]) - 1 for w in want), budget, sum(w[4] for w in want), not reason, reason)
        assert told[9] == (0, 0, 0, budget, 0, False, "no_results")


def test_merging_asks_for_overlapping_pages(spark):
    text = "the pump is a part of the filter"
    rows = [(1, 1, 10, "a", "s", 3, 5, 0.9, text), (1, 2, 11, "a", "s", 5, 9, 0.8, text + " x"), (1, 3, 12, "a", "s", 6, 7, 0.7, text + " y"), (1, 4, 13, "b", "s", 4, 4, 0.6, text), (1, 5, 16, "a", "s", 3, 3, 0.6, text), (1, 6, 14, "a", "t", None, None, 0.5, text)]
    table = spark.createDataFrame([(*r, ["pump", "filter"]) for r in rows], SCHEMA)
    near = {r["rank"]: r.near for r in contexts.mergeable(contexts.scored(table)).collect()}
    assert near == {1: [2, 6], 2: [1, 3, 6], 3: [2, 6], 5: [6], 6: [1, 2, 3, 5]} or near[1] == [2, 6] and 4 not in near


def test_overlapping_intervals(spark):
    rng = np.random.default_rng(2)
    left, right = ([(k, "xy"[k % 2] if k else None, *(None if rng.random() < 0.05 else int(rng.integers(-40, 80)) for _ in range(2))) for k in range(60)] for _ in range(2))
    schema = "id long, key string, first long, last long"
    found = intervals.overlapping(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["key"], 7)
    want = [(a[0], b[0], a[1]) for a in left for b in right if a[1] and a[1] == b[1] and None not in (*a[2:], *b[2:]) and min(a[2:]) <= max(b[2:]) and min(b[2:]) <= max(a[2:])]
    assert sorted(map(tuple, found.collect())) == sorted(want) and want


def plain_order(rows):
    """Ranks in the new order of rows (rank, page, header, score, coverage, usefulness)."""
    stay = [r[0] for r in rows]
    pages, headers = ([r[k] for r in rows if r[k]] for k in (1, 2))
    if max([*map(pages.count, pages), *map(headers.count, headers), 0]) < 2:
        return stay
    first, others, best = rows[0], rows[1:], max(r[5] for r in rows)
    peers = [r for r in others if abs(r[3] - first[3]) <= 1e-6]
    if first[5] >= 0.55 or (peers and max(r[5] for r in peers) <= first[5] + 1e-9) or first[3] - max(r[3] for r in others) >= 0.15:
        return stay
    useful = [r[0] for r in rows if best > 0 and r[5] >= max(0.45, best - 1e-9)]
    if not useful or useful[0] <= 1:
        return stay
    return [r[0] for r in sorted(rows, key=lambda r: (-r[5], -r[4], -r[3], r[0]))]


def test_same_page_order(spark):
    rng = np.random.default_rng(4)
    cases = {q: [(k, ["p", "q", None, ""][rng.integers(0, 4)], ["h", "i", None][rng.integers(0, 3)], float(rng.choice([0.9, 0.85, 0.8, 0.6])), float(rng.choice([0.1, 0.5])), float(rng.choice([0, 0.2, 0.44, 0.5, 0.6]))) for k in range(1, 1 + rng.integers(1, 6))] for q in range(300)}
    table = spark.createDataFrame([(q, *r) for q, own in cases.items() for r in own], "query_id long, rank int, page string, header string, score double, coverage double, usefulness double")
    found = evidence.same_page_order(table).collect()
    moved = 0
    for q, own in cases.items():
        got = [r["rank"] for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.new_rank)]
        assert got == plain_order(own)
        moved += got != sorted(got)
    assert moved > 10


def test_page_usefulness(spark):
    texts = ["Heading\nThis is a pump. It contains water; you must use the lid", "Navigation\nprevious next : table of contents the pump", "x\nsource: https://x pump filter", "\n", "A\nif it can be 清潔"]
    df = spark.createDataFrame([(t, ["pump", "filter"]) for t in texts], "text string, asked array<string>")
    share, useful = compaction.page_usefulness(F.col("text"), F.col("asked"))
    found = [(r.s, r.u) for r in df.select("text", share.alias("s"), useful.alias("u")).collect()]
    for text, (s, u) in zip(texts, found):
        low = f" {text.lower()} "
        cover = len(plain_terms(text) & {"pump", "filter"}) / 2
        menus = sum(c in low for c in compaction.CHROME)
        want = min(0.4, cover) + min(0.36, 0.12 * sum(bool(re.search(p, low)) for p in compaction.DEFINITIONS)) + (min(0.12, 0.04 * sum(bool(re.search(p, low)) for p in compaction.ACTIONS[:-1])) if cover >= 0.35 else 0)
        head = re.sub(r"\s+", " ", text.lower()).strip()[:180]
        want -= min(0.2, 0.08 * max(1, menus)) if menus or "source: http" in head or "navigation" in head else 0
        assert (s, u) == (cover, round(max(0.0, want), 6) if text.strip() else 0.0)
