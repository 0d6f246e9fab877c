"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Every shard owns several points of a 64-bit ring; the arc before a point belongs to its shard. A row's place is the hash of
its doc_id. Shards have capacities; the rows of an arc that its shard can't take continue clockwise, arc by arc, to the
next shard with room. Which rows continue is settled on counts alone: how many rows lie in each arc (shards x points numbers,
whatever the size of the table) gives a list of segments "rows a to b of this arc go to that shard from slot s on", and a bounded broadcast
join reads a row's shard and slot from its rank within the arc. With no slack the capacities sum to the number of rows, so counts differ
by one at most (law ``rows``).

Cases: a null doc_id is placed by its text; null texts have size 8 and checksum 0; equal doc_ids share a place but are ranked by
their texts; wholly equal rows are interchangeable, each has its own slot; an empty table gives no rows; other columns are left aside.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmere.llm.common import saved

#: Each arc's rows are ranked in so many parts, so that a hot place is not ranked in one task.
PARTS = 8
CELL_BITS = 52


def ring_points(shards: int, points: int) -> list[tuple[int, int]]:
    """(place, shard), in order of place; a shard's points don't depend on the number of shards."""
    return sorted((xxhash.xxh64_intdigest(f"shard {s} point {p}") - 2**63, s) for s in range(shards) for p in range(points))


def _arc_cells(ring: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(cell, low, high, arc): the ring's arcs cut at the borders of 4096 equal cells, for an equi-join by cell."""
    places = [place for place, _ in ring]
    spans = [(low + 1, high, k + 1) for k, (low, high) in enumerate(zip(places, places[1:], strict=False))]
    spans += [(-(2**63), places[0], 0), (places[-1] + 1, 2**63 - 1, 0)]
    cells = []
    for low, high, arc in spans:
        for cell in range(low >> CELL_BITS, (high >> CELL_BITS) + 1):
            cells.append((cell, max(low, cell << CELL_BITS), min(high, ((cell + 1) << CELL_BITS) - 1), arc))
    return [c for c in cells if c[1] <= c[2]]


def segments(counts: list[int], owners: list[int], capacities: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, from, to, shard, first slot): rounds of clockwise overflow over the number of rows in each arc."""
    taken, used, found = [0] * len(counts), [0] * len(capacities), []
    left = [a for a, n in enumerate(counts) if n]
    for step in range(len(counts)):
        if not left:
            break
        for arc in left:
            shard = owners[(arc + step) % len(owners)]
            n = min(counts[arc] - taken[arc], capacities[shard] - used[shard])
            if n > 0:
                found.append((arc, taken[arc], taken[arc] + n, shard, used[shard]))
                taken[arc] += n
                used[shard] += n
        left = [a for a in left if taken[a] < counts[a]]
    return found


def placed(docs: DataFrame, ring: list[tuple[int, int]]) -> DataFrame:
    """doc_id, size, text_crc32, place, part, arc of every row."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    place = F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(F.xxhash64("doc_id"))
    slim = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), place.alias("place"))
    slim = slim.withColumns({"part": F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(PARTS)).cast("int"), "cell": F.shiftright("place", CELL_BITS)})
    cells = spark.createDataFrame(_arc_cells(ring), "cell long, low long, high long, arc int")
    return slim.join(F.broadcast(cells), "cell").where(F.col("place").between(F.col("low"), F.col("high"))).drop("cell", "low", "high")


def shard(docs: DataFrame, shards: int = 24, points: int = 64, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot. slack: how far a shard may exceed the mean number of rows."""
    spark = docs.sparkSession
    ring = ring_points(shards, points)
    slim = saved(placed(docs, ring))
    counts = {(r["arc"], r["part"]): r["count"] for r in slim.groupBy("arc", "part").count().collect()}  # shards x points x PARTS numbers at most
    arcs = [sum(counts.get((a, p), 0) for p in range(PARTS)) for a in range(len(ring))]
    rows = sum(arcs)
    if slack:
        capacities = [-int(-rows * (1 + slack) // shards)] * shards
    else:
        capacities = [rows // shards + (s < rows % shards) for s in range(shards)]
    by_arc: dict[int, list] = {}
    for arc, low, high, to, slot in segments(arcs, [s for _, s in ring], capacities):
        by_arc.setdefault(arc, []).append((low, high, to, slot))
    plan = []
    for arc, own in by_arc.items():
        start = 0
        for part in range(PARTS):
            end = start + counts.get((arc, part), 0)
            plan += [(arc, part, max(low, start) - start, min(high, end) - start, to, slot + max(low, start) - low) for low, high, to, slot in own if max(low, start) < min(high, end)]
            start = end
    plan_rows = spark.createDataFrame(plan, "arc int, part int, low long, high long, shard int, slot0 long")
    rank = F.row_number().over(Window.partitionBy("arc", "part").orderBy("place", "doc_id", "text_crc32", "size")) - 1
    ranked = slim.withColumn("rank", rank.cast("long"))
    inside = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    found = ranked.join(F.broadcast(plan_rows), ["arc", "part"]).where(inside)
    return found.select("doc_id", "size", "text_crc32", "shard", (F.col("slot0") + F.col("rank") - F.col("low")).alias("slot"))


def shard_report(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The sharding of all rows under the law of equal counts."""
    none: Column = F.lit(None).cast("int")
    return shard(docs, shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", none.alias("grown_shard"))
