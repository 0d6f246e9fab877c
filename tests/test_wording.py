"""Line classifiers and sentence compaction against plain Python accounts of their rules, and folds over keys."""

import re

from pyspark.sql import functions as F

from sparkmere.functions import pages
from sparkmere.operators import compaction, serving

LINES = {
    "": "noise", "  12 ": "page_number", "Page 7": "page_number", "Cleaning ..... 12": "noise", "3. Before you start": "heading", "2.1 Parts": "heading", "A. Overview": "heading",
    "Safety": "heading", "SAFETY INSTRUCTIONS": "heading", "This is a plain sentence, as it ends.": "text", "the machine can be moved by two people": "text", "清洁说明": "heading",
    "这是一个很长的句子，它超过了十八个字符，所以不是标题": "text", "visit manualslib.com for more": "noise", "1 2 on 3 of 4": "noise", "�� broken": "noise", "Read the cleaning part now": "heading",
    "###$$$%%%^^^&&&***": "noise", "Title Case Words Here": "heading", "x" * 120: "text",
}


def test_line_kinds(spark):
    df = spark.createDataFrame([(k, line) for k, line in enumerate(LINES)], "id long, line string")
    found = {r.line: r.kind for r in df.select("line", pages.line_kind(F.col("line"), ("safety", "cleaning")).alias("kind")).collect()}
    assert found == LINES


def plain_usefulness(text, asked):
    t = re.sub(r"\s+", " ", text.lower()).strip()
    if not t:
        return 0.0
    share = len({w for w in re.findall("[a-z0-9㐀-鿿]+", t) if len(w) > 1} & asked) / max(1, len(asked))
    score = min(0.4, share) + min(0.36, 0.12 * sum(bool(re.search(p, t)) for p in compaction.DEFINITIONS))
    score += min(0.12, 0.04 * sum(bool(re.search(p, t)) for p in compaction.ACTIONS)) if share >= 0.35 else 0
    return max(0.0, score - (0.2 if "source: http" in t[:180] or "navigation" in t[:180] else 0))


def plain_compacted(text, asked, target):
    pieces = [p.strip() for p in re.split(r"(?<=[。.!?！？；;])\s+", re.sub(r"\s+", " ", text).strip()) if p.strip()]
    if (len(text) + 3) // 4 <= target or len(pieces) < 2:
        return text

    def score(s):
        met = len(set(re.findall("[a-z0-9㐀-鿿]{2,}", s.lower())) & asked)
        return met / max(1, len(asked)) + min(0.24, 0.08 * met) + 0.5 * plain_usefulness(s, asked)

    order = sorted(range(len(pieces)), key=lambda k: (-score(pieces[k]), k))
    kept = []
    for k in order:
        if len(kept) < 3 and (not kept or score(pieces[k]) >= max(0.2, 0.45 * score(pieces[order[0]]))):
            joined = " ".join(pieces[j] for j in sorted([*kept, k]))
            if max(1, (len(joined) + 3) // 4) <= target:
                kept.append(k)
    return " ".join(pieces[k] for k in sorted(kept)) or text


def test_compaction(spark):
    texts = [
        "The pump is a part of the machine. Clean the filter weekly! It must be dry. Nothing else here. If the pump stops, open the lid and click the switch; then wait. " * 3,
        "short text", "one single sentence without any stop " * 20, "navigation source: http://x. The filter means much. " * 12, "", "word. " * 200,
    ]
    asked = {"pump", "filter", "lid", "clean"}
    rows = spark.createDataFrame([(1, k, t, sorted(asked)) for k, t in enumerate(texts)], "query_id long, node_id long, text string, asked array<string>")
    for target in (20, 60):
        found = {r.node_id: r.content for r in compaction.compacted(rows, target).collect()}
        assert found == {k: plain_compacted(t, asked, target) for k, t in enumerate(texts)}
    for r in rows.select("text", compaction.usefulness(F.col("text"), F.col("asked")).alias("u")).collect():
        assert abs(r.u - plain_usefulness(r.text, asked)) < 1e-9


def test_breaker(spark):
    calls = [("a", float(t), f) for t, f in ((0, True), (1, True), (2, True), (3, False), (31.5, False), (33, True), (34, True), (35, True), (36, True), (70, True))] + [("b", 1.0, False)]
    found = serving.breaker(spark.createDataFrame(calls, "key string, at double, failed boolean"))
    assert [r.state for r in found.where("key = 'a'").orderBy("at").collect()] == ["failed"] * 3 + ["rejected"] * 2 + ["failed"] * 3 + ["rejected", "failed"]
    assert [r.state for r in found.where("key = 'b'").collect()] == ["ok"]
