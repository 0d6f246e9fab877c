"""Chunkers against a plain Python account of their rules."""

import re

import pytest
from pyspark.sql import functions as F

from sparkmere.functions import chunking as fn
from sparkmere.operators import chunks
from sparkmere.sources import parsers

SF = "/root/testdata/sf0.001"
ODD = ["", " \n ", "one", "a. b! c? " * 80, "第一句。第二句！第三句？" * 60, "x" * 1200, "para one\n\npara two\n \n" + "long words here " * 60 + "\n\nend", "mixed 句子。next one. 完", None]


def cut(text, n):
    return [text] if len(text) <= n else [p for p in (text[k : k + n].strip() for k in range(0, len(text), n)) if p]


def plain_paragraphs(text, n):
    out = []
    for p in (p.strip() for p in re.split(r"\n\s*\n", text)):
        if p and out and len(out[-1]) + len(p) + 2 <= n:
            out[-1] += "\n\n" + p
        elif p:
            out.append(p)
    return out


def plain_sentences(text, n):
    if len(text) <= n:
        return [text]
    units = [u for u in (u.strip() for u in re.split(r"(?<=[。！？.!?])\s+|(?<=[。！？])", text.strip())) if u]
    if len(units) < 2:
        return cut(text, n)
    out, is_open = [], False
    for u in units:
        if len(u) > n:
            out += cut(u, n)
            is_open = False
            continue
        more = out[-1] + (" " if out[-1][-1].isascii() and u[0].isascii() else "") + u if is_open else None
        if more is not None and len(more) <= n:
            out[-1] = more
        else:
            out.append(u)
        is_open = True
    return [x.strip() for x in out if x.strip()]


def plain_overlap(parts, overlap, n):
    room, out = min(overlap, max(n // 3, 1)), parts[:1]
    for before, own in zip(parts, parts[1:], strict=False):
        tail = before.strip()
        if len(before) > room:
            window = before[-room:]
            options = [window.split(b, 1)[1].strip() for b in fn.TAIL_BOUNDARIES if b in window]
            tail = next((o for o in options if o), window.strip())
        out.append((tail + ("\n" if "\n" in tail + own else " ") + own).strip() if tail else own)
    return out


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame([(-1 - k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd).cache()


@pytest.mark.parametrize("size", [60, 500])
def test_packing(docs, size):
    text = F.col("text")
    found = docs.select("text", fn.packed_paragraphs(text, size).alias("p"), fn.packed_sentences(text, size).alias("s"), fn.split_text(text, size, 40).alias("o")).where("text IS NOT NULL")
    for r in found.collect():
        assert r.p == plain_paragraphs(r.text, size)
        assert r.s == plain_sentences(r.text, size)
        whole = [x.strip() for p in plain_paragraphs(r.text, size) for x in plain_sentences(p, size) if x.strip()]
        assert r.o == plain_overlap(whole, 40, size)


def test_tables(spark):
    rows = "\n".join(f"| {k} | cell {k} |" for k in range(12))
    text = f"before. \n| a | b |\n|---|:---:|\n{rows}\nafter\n| no table |\nend"
    long = "| h | i |\n|---|---|\n| " + "y" * 100 + " | z |\n| 1 | 2 |"
    df = spark.createDataFrame([(1, text), (2, long), (3, "| a |\n| b |")], "id long, text string")
    found = {r.id: r.p for r in df.select("id", fn.split_text(F.col("text"), 60).alias("p")).collect()}
    assert found[1][0] == "before." and found[1][-1] == "after\n| no table |\nend"
    assert all(p.startswith("| a | b |\n|---|:---:|\n") and len(p) <= 60 for p in found[1][1:-1])
    assert [line for p in found[1][1:-1] for line in p.split("\n")[2:]] == rows.split("\n")
    assert "".join(found[2]).count("y") == 100 and found[2][-1] == "| h | i |\n|---|---|\n| 1 | 2 |"
    assert found[3] == ["| a |\n| b |"]


def test_postprocess(spark):
    text = "intro\n# One\n" + "A sentence of some length. " * 40 + "\n## Two\nshort\n# Three\nx"
    sections = parsers.markdown_sections(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    pathed = chunks.heading_paths(sections)
    assert [r.path for r in pathed.orderBy("section").collect()] == [[""], ["One"], ["One", "Two"], ["Three"]]
    parts = chunks.split_chunks(pathed.withColumnRenamed("section", "chunk"), 500)
    merged = chunks.merge_short(parts, 200).orderBy("number").collect()
    assert [r.path for r in merged] == [[""], ["One"], ["One"], ["One", "Two"], ["Three"]]
    assert merged[2].text.count("A sentence") + merged[1].text.count("A sentence") == 40 and merged[1].reason == "sentence_boundary" and merged[3].reason is None
