"""Set-similarity joins, suggestions, drift and routing against brute force."""

import collections
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from sparkmere import catalogue
from sparkmere.operators import governance, routing, setjoin
from tests.compare import of_duckdb, of_spark

catalogue.load_all()


def sets_of(rng, n, words):
    weights = np.arange(1, len(words) + 1.0) ** -1.2
    return {k: sorted(set(rng.choice(words, rng.integers(0, 8), p=weights / weights.sum()).tolist())) for k in range(n)}


def test_similar_sets(spark):
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(30)]
    left, right = sets_of(rng, 150, words), sets_of(rng, 200, words)
    a, b = (spark.createDataFrame(list(s.items()), "id long, tokens array<string>") for s in (left, right))
    for least in (0.5, 0.67, 0.8, 1.0):
        found = sorted((r.left, r.right, r.shared, round(r.share, 9)) for r in setjoin.similar_sets(a, b, least).collect())
        want = [(i, j, len({*x} & {*y}), round(len({*x} & {*y}) / len({*x} | {*y}), 9)) for i, x in left.items() for j, y in right.items() if x and y and len({*x} & {*y}) / len({*x} | {*y}) >= least]
        assert found == sorted(want) and want
        found = sorted((r.left, r.right) for r in setjoin.similar_sets(a, b, least, containment=True).collect())
        assert found == sorted((i, j) for i, x in left.items() for j, y in right.items() if x and len({*x} & {*y}) / len(x) >= least)
    assert setjoin.similar_sets(a.limit(0), b, 0.5).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_near_canonical(spark):
    names = ["water-tank", "water-tanks", "tank-water", "a-b-c-d-e", "b-a-c-d-e", "a-b-c-d", "steam", "steamer", "stream", "abcd", "abcde", "filter-long-name", "long-filter-name", "x", "hose-2", "hose-22"]
    rng = np.random.default_rng(1)
    names += ["".join(rng.choice(list("ab-"), rng.integers(3, 8))).strip("-") or "z" for _ in range(60)]
    names = sorted(set(names))
    tags, canonical = names[::2] + names[1::4], names[1::2]

    def first(tag):
        for c in sorted(canonical):
            if c == tag:
                continue
            parts = {*tag.split("-")}, {*c.split("-")}
            if len(tag) >= 5 and len(c) >= 5 and (tag.startswith(c) or c.startswith(tag)) or len(tag) >= 5 and distance(tag, c) <= 2 or len(parts[0] & parts[1]) / len(parts[0] | parts[1]) >= 0.8:
                return c

    found = governance.near_canonical(spark.createDataFrame([(t,) for t in tags], "tag string"), spark.createDataFrame([(c,) for c in canonical], "tag string"))
    assert {r.tag: r.canonical for r in found.collect()} == {t: first(t) for t in tags if first(t)}


def plain_parts(value):
    value = re.sub(r"[\s_]+", "-", (value or "").strip().lower())
    return [p for p in re.sub("-+", "-", re.sub("[^a-z0-9:-]+", "-", value)).split("-") if p]


def is_useful(t):
    model = re.search("[a-z]", t) and re.search("[0-9]", t)
    return bool(t) and t not in governance.TAG_STOP_WORDS and (len(t) >= 3 or bool(model)) and not re.fullmatch(r"v?\d+(-\d+)*", t)


def plain_suggestions(fields, existing, held):
    sources, every = collections.defaultdict(set), set()
    for source, value in fields.items():
        parts = plain_parts(value)
        every.update(parts)
        for p in filter(is_useful, parts):
            sources[p].add(source)
        words = [p for p in parts if is_useful(p) or re.search("[a-z]", p) and re.search("[0-9]", p)]
        for a, b in zip(words, words[1:]):
            if any(x not in governance.TAG_STOP_WORDS and not re.fullmatch(r"v?\d+", x) for x in (a, b)):
                sources[f"{a}-{b}"].add(source)
    for tag in existing:
        if tag in every or len({*tag.split("-")} & every) / len({*tag.split("-")}) >= 0.67:
            sources[tag].add("existing_tags")
    out = []
    for tag, own in sources.items():
        if tag in held or not is_useful(tag):
            continue
        score = sum(governance.SOURCE_WEIGHTS.get(s, 0.05) for s in own) + 0.05 * (len(own) - 1) + (min(0.12, 0.02 * existing[tag]) if "existing_tags" in own else 0)
        out.append((-round(min(score, 0.99) + 1e-9, 3), tag, sorted(own)))
    return sorted(out)[:8]


def test_suggestions(spark):
    drafts = [(1, "Pump Guide WM-8000 v2", "manuals/pump_guide.pdf", "the pump water tank"), (2, None, "", "tank x5 v5 and 12 e5 hose water"), (3, "the of", "a", None), (4, "Water: tank_hose", "pump", "pump pump water-tank")]
    existing = {"water-tank": 9, "pump": 1, "pump-hose-tank": 3, "steam-engine": 5, "wm-8000": 2, "tank": 7}
    held = [(4, "pump"), (1, "water")]
    df = spark.createDataFrame(drafts, "doc_id long, title string, path string, sample string")
    fields = {"title": "title", "source_file": "path", "text_sample": "sample"}
    found = governance.suggestions(df, fields, spark.createDataFrame(list(existing.items()), "tag string, n long"), spark.createDataFrame(held, "doc_id long, tag string")).collect()
    for doc, *values in drafts:
        got = [(-r.score, r.tag, r.sources) for r in sorted(found, key=lambda r: r["rank"]) if r.doc_id == doc]
        assert got == plain_suggestions(dict(zip(fields, values)), existing, {t for d, t in held if d == doc})


def test_suggestions_look_for_parts_in_few_drafts(spark, monkeypatch):
    """Drafts with enough tags in use among those that they name aren't searched; what is found is what a plain account finds."""
    rng = np.random.default_rng(4)
    words = ["w1x", "v2", "12", "the", "of", *(f"word{k}" for k in range(40))]
    text = lambda n: " ".join(rng.choice(words, n))
    drafts = [(k, text(4), "kb_" + str(rng.choice(words)), text(int(rng.integers(0, 60)))) for k in range(60)]
    existing = {f"{a}-{b}": int(rng.integers(1, 9)) for a, b in rng.choice(words, (300, 2))} | {"-".join(rng.choice(words, 4)): 2 for _ in range(60)} | {str(w): 3 for w in words[3:9]} | {"word1--word2": 4}
    held = [(k, f"word{k % 40}") for k in range(60)]
    fields, searched, plain = {"title": "title", "source_file": "path", "brand": "sample"}, [], governance._held_in
    monkeypatch.setattr(governance, "_held_in", lambda tags, parts: searched.append(parts.count()) or plain(tags, parts))
    df = spark.createDataFrame(drafts, "doc_id long, title string, path string, sample string").repartition(3)
    tags = spark.createDataFrame(list(existing.items()), "tag string, n long")
    for taken in ([], held):
        found = governance.suggestions(df, fields, tags, spark.createDataFrame(taken, "doc_id long, tag string") if taken else None).collect()
        for doc, *values in drafts:
            got = [(-r.score, r.tag, r.sources) for r in sorted(found, key=lambda r: r["rank"]) if r.doc_id == doc]
            assert got == plain_suggestions(dict(zip(fields, values)), existing, {t for d, t in taken if d == doc})
    assert all(0 < n < 60 for n in searched)


def test_suggestions_take_rows_of_one_id_together(spark, tmp_path):
    rows = [(2, "red pump\nwater", "web"), (2, "red pump\nhose 12", "web"), (3, "pump of red hose water", None), (None, "Red Pump", "wiki"), (4, None, "web")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert of_spark(catalogue.QUERIES["tag_suggest"](spark, str(tmp_path))) == of_duckdb(db, catalogue.ORACLES["tag_suggest"])


def test_drift(spark):
    stats = spark.createDataFrame([("a", "canonical", "a", 2, 2), ("b", "synonym", "a", 1, 1), ("c", "deprecated", None, 3, 0), ("d", "unknown", None, 1, 2), ("e", "unknown", None, 0, 4)], "tag string, status string, target string, manuals long, graph long")
    near = spark.createDataFrame([("d", "a"), ("e", "a")], "tag string, canonical string")
    found = lambda strict: sorted(tuple(r) for r in governance.drift(stats, near, strict).collect())
    drifted = [("warning", "GRAPH_LIBRARY_TAG_DRIFT", t, t, n) for t, n in (("c", 3), ("d", 1), ("e", 0))]
    used = lambda s: [("warning", "SYNONYM_IN_USE", "b", "a", 1), (s, "DEPRECATED_TAG_IN_USE", "c", "c", 3), (s, "UNKNOWN_TAG", "d", "d", 1), ("info", "LIKELY_DUPLICATE_TAG", "d", "a", 1)]
    assert found(False) == sorted(drifted + used("warning")) and found(True) == sorted(drifted + used("error"))
    uses = spark.createDataFrame([(7, "b"), (7, "c"), (7, "c"), (8, "d"), (8, "a"), (9, "")], "manual long, tag string")
    messages = governance.validation_messages(uses, stats.select("tag", "status", "target"), True)
    assert sorted((r.manual, r.tag, r.code, r.severity, r.canonical) for r in messages.collect()) == [(7, "b", "TAG_SYNONYM_USED", "warning", "a"), (7, "c", "TAG_DEPRECATED", "error", None), (8, "d", "TAG_UNKNOWN", "error", None)]


def test_routes(spark):
    asked = {
        "": "no_retrieval", None: "no_retrieval", " Hello ": "no_retrieval", "hello there": "single_shot", "What time is IT now": "no_retrieval", "compare both": "multi_hop", "x vs y": "multi_hop",
        "clean it, then dry it": "multi_hop", "error E05 on WM-8000": "multi_hop", "error E05 and e05": "single_shot", "洗衣机和冰箱的区别": "multi_hop", "谢谢": "no_retrieval", "how do I clean it": "single_shot",
    }
    df = spark.createDataFrame([(q,) for q in asked], "q string")
    assert {r.q: r.r for r in df.select("q", routing.route(F.col("q")).alias("r")).collect()} == asked
    assert df.select(routing.route(F.lit("how"), most_values=F.lit(2)).alias("r")).head().r == "multi_hop"
    looks = {"Show me": True, "where  is": False, "Where is it": True, "按钮在哪": True, "the button": True, "clean": False}
    df = spark.createDataFrame([(q,) for q in looks], "q string")
    assert {r.q: r.v for r in df.select("q", routing.visual(F.col("q")).alias("v")).collect()} == looks


def test_usage_lists_no_tag_in_one_task(spark):
    """Counts and smallest manuals against a plain account; no window sorts all manuals of a tag, and none are listed."""
    rows = [(tag, k * 7 % 1000, k % 3 != 0) for k in range(5000) for tag in ("a", "b") if tag == "a" or k % 100 == 0] + [(None, 4, None), ("c", 9, None)]
    found = governance.usage(spark.createDataFrame(rows, "tag string, manual long, active boolean"))
    want = {}
    for tag, manual, active in rows:
        own = want.setdefault(tag, {})
        own[manual] = own.get(manual) or active
    told = {t: (len(m), sum(x is True for x in m.values()), sum(x is False for x in m.values()), ",".join(map(str, sorted(m)[:5]))) for t, m in want.items()}
    assert {r.tag: (r.manuals, r.active, r.inactive, r.examples) for r in found.collect()} == told
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
