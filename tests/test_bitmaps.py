"""The bitmap index and narrowing against sets of numbers."""

import collections

import numpy as np
from pyspark.sql import functions as F

from sparkmere.operators import bitmaps, narrowing


def plain_pairs(rows):
    for node, brand, tags, attributes in rows:
        for field, value in [("brand", brand), *(("tags", t) for t in tags or []), *((f, v) for k, vs in (attributes or {}).items() for v in vs or [] for f in (k, f"attributes.{k}"))]:
            if node is not None and value is not None and value.strip():
                yield node, field, "-".join(value.lower().split())


def test_bitmap_index(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(int(k) * 37 - 500, rng.choice(["Acme", "Big Co", " ", "Zed"]).item(), rng.choice(["x", "y", "z w"], 2).tolist(), {"hue": rng.choice(["Red", "blue"], 2).tolist()}) for k in range(3000)]
    rows += [(None, "Acme", [], None), (7, None, None, {"hue": None}), (8, "Acme", [None, "x", "x"], {"hue": ["Red", "red"]})]
    nodes = spark.createDataFrame(rows, "node_id long, brand string, tags array<string>, attributes map<string, array<string>>")
    held = collections.defaultdict(set)
    for node, field, value in plain_pairs(rows):
        held[field, value].add(node)
    for dense in (bitmaps.DENSE, 40):
        monkeypatch.setattr(bitmaps, "DENSE", dense)
        index = bitmaps.bitmap_index(bitmaps.metadata_pairs(nodes, narrowing.normalized_text, ["brand"], {"tags": "tags"}, "attributes"))
        sizes = {(r.field, r.normal): r.n for r in index.groupBy("field", "normal").agg(F.sum("n").alias("n")).collect()}
        assert sizes == {k: len(v) for k, v in held.items() if v}
        assert index.where("(places IS NULL) = (bits IS NULL) OR (n >= {}) = (bits IS NULL)".format(dense)).count() == 0
        wanted = {1: [("brand", "acme")], 2: [("brand", "acme"), ("brand", "zed"), ("tags", "x")], 3: [("hue", "red"), ("tags", "z-w"), ("brand", "big-co")], 4: [("brand", "none")], 5: [("brand", "none"), ("tags", "x")], 6: [("attributes.hue", "blue"), ("attributes.hue", "red")]}
        found = bitmaps.count_under(spark.createDataFrame([(k, *w) for k, ws in wanted.items() for w in ws], "key long, field string, normal string"), index)
        want = {}
        for key, ws in wanted.items():
            fields = {f: set().union(*(held[g, v] for g, v in ws if g == f)) for f, _ in ws}
            want[key] = len(set.intersection(*fields.values()))
        assert {r.key: r.n for r in found.collect()} == {k: n for k, n in want.items() if n}
    assert bitmaps.bitmap_index(bitmaps.metadata_pairs(nodes.limit(0), narrowing.normalized_text, ["brand"])).count() == 0


def test_long_names_are_detected(spark):
    values = [("brand", "The Very Long Name Of A Brand Co"), ("brand", "long name"), ("category", "ice maker"), ("model", "WM-8000")]
    table = spark.createDataFrame([(f, v, v.lower().replace(" ", "-")) for f, v in values], "field string, value string, normal string").withColumn("nodes", F.lit(1))
    aliases = narrowing.alias_table(table, spark.createDataFrame([("冰 块", "ice maker", 0)], "alias string, category string, place int"))
    asked = [(1, "is the very long name of a brand co here"), (2, "a long  Name_ice"), (3, "ice-maker wm8000"), (4, "wm_8000x, very long"), (5, "有冰块吗"), (6, ""), (7, None), (8, "long-names")]
    found = narrowing.detected(spark.createDataFrame(asked, "query_id long, text string"), aliases)
    got = collections.defaultdict(dict)
    for r in found.collect():
        got[r.query_id][r.field] = r.value
    assert got == {1: {"brand": "long name"}, 2: {"brand": "long name"}, 3: {"category": "ice maker", "model": "WM-8000"}, 5: {"category": "ice maker"}}
    told = {}
    for brand in ("hard", "boost", "hard_if_unique"):
        rows = spark.createDataFrame([(1, "x", None)], "query_id long, text string, explicit map<string, string>")
        named = spark.createDataFrame([(1, "brand", "long name", "long-name"), (1, "category", "ice maker", "ice-maker")], "query_id long, field string, value string, normal string")
        index = bitmaps.bitmap_index(spark.createDataFrame([(1, "brand", "long-name"), (1, "category", "ice-maker"), (2, "category", "ice-maker")], "node_id long, field string, normal string"))
        r = narrowing.narrowing(rows, named, table, index, brand=brand, category="boost" if brand == "boost" else "hard").head()
        told[brand] = (r.hard, r.boost, r["mode"], r.candidates)
    both = {"brand": "long-name", "category": "ice-maker"}
    assert told["hard"] == (both, {}, "hard_filter", 1) and told["boost"] == ({}, both, "boost", None)
    assert told["hard_if_unique"] == ({"category": "ice-maker"}, {"brand": "long-name"}, "mixed", 2)
