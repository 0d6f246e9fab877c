"""Secret scans with multipart credential linking.

One pass over the whole texts finds the strong ("base") spans, which are always reported, and weak parts: account
identifiers, key-like strings and endpoints. Weak parts mean little alone. They are linked by an interval join: parts are
cut into buckets of SCOPE code points, each bucket keeps the first and last place of each role, and a part is
joined with its own and the two neighbouring buckets, which decides exactly whether a complementary part starts within SCOPE. A part meets three rows at
most, however many parts a document has. Reported are a key beside an identifier or endpoint, an identifier beside a secret, and an
endpoint beside both.

Cases: null and empty texts have no spans; repeated rows and null doc_ids are told apart by a row number and each gives a row; an empty
table gives no rows; other columns are left aside, whatever their names.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmere.llm.common import saved

SCOPE = 300
#: Base kinds in the order in which ties of start are listed, then the linked kinds.
KINDS = ("assign", "access", "hex", "identifier", "key", "endpoint")
ROLES = {"assign": "secret", "hex": "secret", "key": "secret", "access": "identifier", "identifier": "identifier", "endpoint": "endpoint"}
WORDS = ("passw", "secret", "token", "api")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a shorter run would be dropped
IDENTIFIER = re.compile(r"""(?i:client_?id|user_?name|user|login|account|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]{3,})""", re.ASCII)
ENDPOINT = re.compile(r"""(?:https?|ftp|postgres|mysql|mongodb|redis|amqp)://[^\s"'<>]+""")
KEY = re.compile(r"[A-Za-z0-9+/=_-]{16,}")
KEY_ENTROPY = 3.0


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the strong kinds, in order of start, then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


def looks_like_key(value: str) -> bool:
    counts = Counter(value)
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    return bits >= KEY_ENTROPY and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def weak_parts(text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), "identifier", m.end()) for m in IDENTIFIER.finditer(text)]
        found += [(m.start(), "endpoint", m.end()) for m in ENDPOINT.finditer(text)]
    covered = sorted((a, b) for a, _, b in [*base, *found])
    starts, reach = [a for a, _ in covered], list(accumulate((b for _, b in covered), max))  # reach: the furthest end so far
    for m in KEY.finditer(text):
        before = bisect_left(starts, m.end())  # so many covered spans start before the key's end
        if looks_like_key(m[0]) and not (before and reach[before - 1] > m.start()):
            found.append((m.start(), "key", m.end()))
    return sorted(found)


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))


def _scanned(batches):
    for batch in batches:
        base, weak = [], []
        for text in batch.column(2).to_pylist():
            own = base_spans(text) if text else []
            base.append([{"start": a, "kind": k, "end": b} for a, k, b in own])
            weak.append([{"start": a, "kind": k, "end": b} for a, k, b in weak_parts(text, own)] if text else [])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base, SPANS), pa.array(weak, SPANS)], names=["row", "doc_id", "base", "weak"])


def linked(scanned: DataFrame) -> DataFrame:
    """row, linked: the weak parts with a complementary part in scope."""
    role = F.element_at(F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair)), F.col("part.kind"))
    parts = scanned.select("row", F.explode(F.concat("base", "weak")).alias("part"))
    parts = parts.select("row", "part", F.col("part.start").alias("at"), role.alias("role"), F.floor(F.col("part.start") / SCOPE).alias("bucket"))
    roles = sorted(set(ROLES.values()))
    ends = [f(F.when(F.col("role") == r, F.col("at"))).alias(f"{n}_{r}") for r in roles for n, f in (("first", F.min), ("last", F.max))]
    buckets = parts.groupBy("row", "bucket").agg(*ends).withColumn("beside", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    buckets = buckets.withColumn("bucket", F.col("bucket") + F.col("beside"))
    weak = parts.where(F.col("part.kind").isin("identifier", "key", "endpoint"))
    met = weak.join(buckets, ["row", "bucket"])

    def near(r: str):  # beside 1: the bucket before this one
        return F.when(F.col("beside") == 0, F.col(f"first_{r}").isNotNull()).when(F.col("beside") == 1, F.col(f"last_{r}") >= F.col("at") - SCOPE).otherwise(F.col(f"first_{r}") <= F.col("at") + SCOPE)

    near_by = met.groupBy("row", "part").agg(*(F.max(F.coalesce(near(r), F.lit(False))).alias(f"near_{r}") for r in roles))
    kind = F.col("part.kind")
    complete = (
        F.when(kind == "key", F.col("near_identifier") | F.col("near_endpoint"))
        .when(kind == "identifier", F.col("near_secret"))
        .otherwise(F.col("near_secret") & F.col("near_identifier"))
    )
    return near_by.where(complete).groupBy("row").agg(F.collect_list("part").alias("linked"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base, spans: arrays of (start, kind, end) of every row, base spans and all spans."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    spans = "array<struct<start:int,kind:string,end:int>>"
    scanned = saved(texts.mapInArrow(_scanned, f"row long, doc_id long, base {spans}, weak {spans}"))
    links = linked(scanned.where("size(weak) > 0"))
    order = F.create_map(*(F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)))
    every = F.concat("base", F.coalesce("linked", F.array().cast(spans)))
    keyed = F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), F.element_at(order, s["kind"]).alias("no"), s["end"].alias("end"), s["kind"].alias("kind"))))
    spans_ = F.transform(keyed, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return scanned.join(links, "row", "left").select("doc_id", "base", spans_.alias("spans"))


def secret_report(docs: DataFrame) -> DataFrame:
    def joined(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scan(docs).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
