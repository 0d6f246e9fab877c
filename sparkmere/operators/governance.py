"""Tag governance: resolution against a policy, usage, drift, near-canonical names, rewrites and suggestions."""

from __future__ import annotations

import heapq
import re
import zlib
from functools import lru_cache, reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmere.functions.text import normalized_tag
from sparkmere.operators.setjoin import similar_sets
from sparkmere.plans.saving import saved

MOST = 0.99


def resolved(tags: DataFrame, canonical: DataFrame, synonyms: DataFrame, deprecated: DataFrame) -> DataFrame:
    """tag, status, target of each tag (tag): canonical, synonym, deprecated or unknown. synonyms: tag, target; the others: tag."""
    joined = tags.select("tag").join(canonical.select("tag", F.lit(True).alias("is_canonical")), "tag", "left")
    joined = joined.join(synonyms.select("tag", "target"), "tag", "left").join(deprecated.select("tag", F.lit(True).alias("is_deprecated")), "tag", "left")
    status = F.when(F.col("is_canonical"), "canonical").when(F.col("target").isNotNull(), "synonym").when(F.col("is_deprecated"), "deprecated").otherwise("unknown")
    target = F.when(F.col("is_canonical"), F.col("tag")).otherwise(F.col("target"))
    return joined.select("tag", status.alias("status"), target.alias("target"))


def _told(examples: int):
    """tag, manuals, active, inactive, few of each batch (tag, manual, active): counts, and the smallest manuals of each tag."""

    def run(batches):
        for batch in batches:
            rows = pa.Table.from_batches([batch]).append_column("inactive", pc.invert(batch.column("active"))).sort_by("manual")
            found = rows.group_by("tag", use_threads=False).aggregate([("manual", "count", pc.CountOptions(mode="all")), ("active", "sum"), ("inactive", "sum"), ("manual", "list")])
            sums = [found[c].cast(pa.int64()) for c in ("manual_count", "active_sum", "inactive_sum")]
            yield from pa.table([found["tag"], *sums, pc.list_slice(found["manual_list"], 0, examples)], names=["tag", "manuals", "active", "inactive", "few"]).to_batches()

    return run


def usage(uses: DataFrame, examples: int = 5) -> DataFrame:
    """tag, manuals, active, inactive, examples (smallest manuals) of uses (manual, tag, active).

    Each batch of distinct uses hands on its counts and its smallest manuals, so that no tag's manuals are sorted or listed in one task. Uses are dealt
    before they are made distinct: few repeat within a task that reads them, and its table of keys would grow with what it reads.
    """
    once = uses.repartition("tag", "manual").groupBy("tag", "manual").agg(F.max("active").alias("active"))
    kind = once.schema["manual"].dataType.simpleString()
    told = once.select("tag", "manual", "active").mapInArrow(_told(examples), f"tag string, manuals long, active long, inactive long, few array<{kind}>")
    few = F.slice(F.array_sort(F.flatten(F.collect_list("few"))), 1, examples)
    return told.groupBy("tag").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("manuals", "active", "inactive")), F.array_join(few, ",").alias("examples"))


# Fixed values of the governance behaviour.
IN_USE = {"unknown": "UNKNOWN_TAG", "synonym": "SYNONYM_IN_USE", "deprecated": "DEPRECATED_TAG_IN_USE"}
IN_METADATA = {"unknown": "TAG_UNKNOWN", "synonym": "TAG_SYNONYM_USED", "deprecated": "TAG_DEPRECATED"}


def _coded(status: Column, codes: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in codes.items() for x in pair)), status)


def _severity(status: Column, strict: bool) -> Column:
    """Synonyms are warnings always, unknown and deprecated tags errors in strict mode."""
    return F.when(F.lit(strict) & (status != "synonym"), "error").otherwise("warning")


def drift(stats: DataFrame, near: DataFrame, strict: bool = False) -> DataFrame:
    """severity, code, tag, canonical, count of what is wrong with the tags in use.

    stats: tag, status, target, manuals (how many manuals have it), graph (how many manuals of the graph have it). Tags that manuals have must be canonical;
    tags of another count in the graph drift; unknown tags close to a canonical one (near: tag, canonical) are likely duplicates.
    """
    own = stats.select("tag", "status", F.coalesce("target", "tag").alias("canonical"), "manuals", "graph")
    used = own.where((F.col("status") != "canonical") & (F.col("manuals") > 0)).select(_severity(F.col("status"), strict).alias("severity"), _coded(F.col("status"), IN_USE).alias("code"), "tag", "canonical", F.col("manuals").alias("count"))
    apart = own.where("manuals != graph").select(F.lit("warning").alias("severity"), F.lit("GRAPH_LIBRARY_TAG_DRIFT").alias("code"), "tag", "canonical", F.col("manuals").alias("count"))
    alike = own.where("status = 'unknown' AND manuals > 0").drop("canonical").join(near.select("tag", "canonical"), "tag")
    alike = alike.select(F.lit("info").alias("severity"), F.lit("LIKELY_DUPLICATE_TAG").alias("code"), "tag", "canonical", F.col("manuals").alias("count"))
    return used.unionByName(apart).unionByName(alike)


def tag_counts(library: DataFrame, graph: DataFrame) -> DataFrame:
    """tag, manuals, graph: how many manuals have each tag (manual, tag) in the library and in the graph."""
    every = library.select("manual", "tag", F.lit(1).alias("own"), F.lit(0).alias("other")).distinct().unionByName(graph.select("manual", "tag", F.lit(0).alias("own"), F.lit(1).alias("other")).distinct())
    return every.where("tag <> ''").groupBy("tag").agg(F.sum("own").alias("manuals"), F.sum("other").alias("graph"))


def validation_messages(uses: DataFrame, resolved_tags: DataFrame, strict: bool = False) -> DataFrame:
    """manual, tag, code, severity, canonical: what is wrong with the tags of each manual's metadata (manual, tag); rows of resolved tell a tag's status."""
    once = uses.where("tag <> ''").select("manual", "tag").distinct()
    found = once.join(resolved_tags, "tag").where("status != 'canonical'")
    canonical = F.when(F.col("status") == "unknown", F.lit(None)).otherwise(F.col("target"))
    return found.select("manual", "tag", _coded(F.col("status"), IN_METADATA).alias("code"), _severity(F.col("status"), strict).alias("severity"), canonical.alias("canonical"))


def deletions(name: Column, distance: int) -> Column:
    """The name and all that is left of it after up to distance deletions: names within that edit distance have one of these in common."""

    def shorter(x: Column) -> Column:
        return F.when(F.length(x) > 0, F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))).otherwise(F.array().cast("array<string>"))

    found = last = F.array(name)
    for _ in range(distance):
        last = F.array_distinct(F.flatten(F.transform(last, shorter)))
        found = F.concat(found, last)
    return F.array_distinct(found)


def near_canonical(tags: DataFrame, canonical: DataFrame, distance: int = 2, least: int = 5, alike: float = 0.8) -> DataFrame:
    """tag, canonical: the first canonical name, in order, within an edit distance, or of which one is a prefix of the other, or with nearly the same parts.

    Candidates meet by equi-joins: on whole names that are a prefix of the other for prefixes, on deletions for edits, on the rarest parts for parts; then the
    condition decides.
    """
    own, names = tags.select("tag").distinct(), canonical.select(F.col("tag").alias("canonical")).distinct()
    starts = lambda c: F.transform(F.sequence(F.lit(least), F.length(c)), lambda n: F.substring(c, F.lit(1), n))
    long = [d.where(F.length(c) >= least) for d, c in ((own, "tag"), (names, "canonical"))]
    prefix = long[0].withColumn("key", F.explode(starts(F.col("tag")))).join(long[1], F.col("key") == F.col("canonical")).select("tag", "canonical")
    prefix = prefix.unionByName(long[1].withColumn("key", F.explode(starts(F.col("canonical")))).join(long[0], F.col("key") == F.col("tag")).select("tag", "canonical"))
    edits = [d.withColumn("key", F.explode(deletions(F.col(c), distance))) for d, c in ((long[0], "tag"), (names, "canonical"))]
    close = edits[0].join(edits[1], "key").select("tag", "canonical").distinct().where(F.levenshtein("tag", "canonical", distance) >= 0)
    parts = [d.select(F.col(c).alias("id"), F.split(c, "-").alias("tokens")) for d, c in ((own, "tag"), (names, "canonical"))]
    same = similar_sets(*parts, alike).select(F.col("left").alias("tag"), F.col("right").alias("canonical"))
    return prefix.unionByName(close).unionByName(same).where("tag != canonical").groupBy("tag").agg(F.min("canonical").alias("canonical"))


def rewritten(tags: Column, sources: Column, target: Column) -> Column:
    """A manual's tags without the sources and with the target at the end, each once, if it had any of them."""
    return F.when(F.arrays_overlap(tags, sources), F.array_distinct(F.concat(F.array_except(tags, sources), F.array(target)))).otherwise(tags)


# Fixed values of the suggestions.
SOURCE_WEIGHTS = {
    "existing_tags": 0.6, "source_file": 0.25, "title": 0.25, "product_category": 0.2, "brand": 0.15, "product_name": 0.15, "product_model": 0.15, "notes": 0.1,
    "text_sample": 0.1, "graph_facets": 0.1,
}
TAG_STOP_WORDS = ("a", "an", "and", "by", "for", "from", "guide", "manual", "of", "on", "or", "pdf", "the", "to", "txt", "use", "user", "with")
VERSION = r"^v?[0-9]+(-[0-9]+)*$"
OTHER_WEIGHT, SEVERAL, PER_USE, MOST_USES, OVERLAP = 0.05, 0.05, 0.02, 0.12, 0.67
SMALL = 1e-9
#: The most that a tag in use scores which no field names.
KNOWN = 0.72


#: Positions of the bitmap of tags in use: SLOTS for each tag, between the least and the most as powers of two (4 KB and 32 MB).
SLOTS, LEAST_BITS, MOST_BITS = 16, 15, 28
BUCKET = 1 << 15
DRAFTS_AT_ONCE = 256

_PART = re.compile("[a-z0-9:]+")
_VERSION = re.compile(VERSION)


def useful(tag: Column) -> Column:
    """Whether a tag says anything: no stop word, no version, three characters or more unless it looks like a model."""
    return (tag != "") & ~tag.isin(*TAG_STOP_WORDS) & ((F.length(tag) >= 3) | tag.rlike("[a-z]") & tag.rlike("[0-9]")) & ~tag.rlike(VERSION)


@lru_cache(1 << 17)
def _kind(part: str) -> tuple[bool, bool, bool]:
    """Whether a part is useful, is a word of phrases, and makes a phrase telling."""
    model = any("a" <= c <= "z" for c in part) and any("0" <= c <= "9" for c in part)
    telling = part not in TAG_STOP_WORDS and not _VERSION.match(part)
    own = telling and (len(part) >= 3 or model)
    return own, own or model, telling


def _parts(value: str | None) -> list[str]:
    """The parts of a text normalised as a tag, in order."""
    return _PART.findall((value or "").lower())


def _names(value: str | None) -> set[str]:
    """The tags that a text names: its useful parts, and phrases of two such parts or models in a row, one of them telling."""
    each = [(part, *_kind(part)) for part in _parts(value)]
    words = [(part, telling) for part, _, word, telling in each if word]
    return {part for part, own, _, _ in each if own} | {f"{a}-{b}" for (a, x), (b, y) in pairwise(words) if x or y}


def _gathered(drafts: DataFrame, columns: list[str]) -> DataFrame:
    """doc_id, rows: the rows (columns f0, f1 ...) of each doc_id. Only rows whose doc_id occurs twice are shuffled."""
    rows = drafts.select("doc_id", F.struct(*(F.col(c).cast("string").alias(f"f{k}") for k, c in enumerate(columns))).alias("row"))
    often = saved(drafts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("other")))
    met = F.col("doc_id").eqNullSafe(F.col("other"))
    alone = rows.join(often, met, "left_anti").select("doc_id", F.array("row").alias("rows"))
    return alone.unionByName(rows.join(often, met, "left_semi").groupBy("doc_id").agg(F.collect_list("row").alias("rows")))


def _told_by(sources: list[str], known, k: int | None):
    """doc_id, tag, named of gathered drafts: the tags that they name, with a bit for each source.

    With known, the bitmap of tags in use, only such tags and the best k of the others are handed on; known may hold tags that aren't in use.
    """
    score = [_plain_score([s for j, s in enumerate(sources) if mask >> j & 1]) for mask in range(1 << len(sources))]

    def run(batches):
        bits = known and known.value
        for batch in batches:
            for start in range(0, batch.num_rows, DRAFTS_AT_ONCE):
                part = batch.slice(start, DRAFTS_AT_ONCE)
                at, tags, named = [], [], []
                for i, rows in enumerate(part.column("rows").to_pylist()):
                    found: dict[str, int] = {}
                    for row in rows:
                        for j in range(len(sources)):
                            for tag in _names(row[f"f{j}"]):
                                found[tag] = found.get(tag, 0) | 1 << j
                    if bits is not None and k is not None:
                        place = np.fromiter((zlib.crc32(tag.encode()) for tag in found), np.int64, len(found)) & (len(bits) * 8 - 1)
                        held = (bits[place >> 3] >> (place & 7) & 1).tolist()
                        others = heapq.nsmallest(k, ((-score[mask], tag) for (tag, mask), h in zip(found.items(), held) if not h))
                        found = {tag: mask for (tag, mask), h in zip(found.items(), held) if h} | {tag: found[tag] for _, tag in others}
                    at += [i] * len(found)
                    tags += found.keys()
                    named += found.values()
                ids = part.column("doc_id").take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(tags, pa.string()), pa.array(named, pa.int32())], ["doc_id", "tag", "named"])

    return run


def _all_parts(count: int):
    """doc_id, tokens: the different parts of all texts of gathered drafts."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, DRAFTS_AT_ONCE):
                part = batch.slice(start, DRAFTS_AT_ONCE)
                tokens = [list({p for row in rows for j in range(count) for p in _parts(row[f"f{j}"])}) for rows in part.column("rows").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(tokens, pa.list_(pa.string()))], ["doc_id", "tokens"])

    return run


def _bitmap(tags: DataFrame):
    """A broadcast bitmap with the crc32 of every tag, in its lower bits."""
    size = 1 << min(MOST_BITS, max(LEAST_BITS, (tags.count() * SLOTS).bit_length()))
    place = F.crc32(F.encode("tag", "UTF-8")).bitwiseAND(F.lit(size - 1))
    buckets = tags.groupBy(F.shiftright(place, 15).alias("bucket")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(BUCKET - 1))).alias("bits")).collect()
    bits = np.zeros(size // 8, np.uint8)
    for row in buckets:
        bits[row["bucket"] * BUCKET // 8 :][: BUCKET // 8] = np.frombuffer(row["bits"], np.uint8)
    return tags.sparkSession.sparkContext.broadcast(bits)


def named(drafts: DataFrame, fields: dict[str, str]) -> DataFrame:
    """doc_id, tag: the tags that the fields (columns by source) of each draft name, each once."""
    schema = f"doc_id {drafts.schema['doc_id'].dataType.simpleString()}, tag string, named int"
    return _gathered(drafts, list(fields.values())).mapInArrow(_told_by(list(fields), None, None), schema).select("doc_id", "tag")


def _plain_score(sources: list[str]) -> float:
    """The score of a tag that is not in use, by sources."""
    return round(min(MOST, sum(SOURCE_WEIGHTS.get(s, OTHER_WEIGHT) for s in sorted(sources)) + SEVERAL * (len(sources) - 1)) + SMALL, 3)


def _scored(rows: DataFrame) -> DataFrame:
    """doc_id, tag, score, sources of rows with sources and uses: the weights of the sources add up, with something for several sources and for use."""
    weights = F.create_map(*(F.lit(x) for pair in SOURCE_WEIGHTS.items() for x in pair))
    total = F.aggregate("sources", F.lit(0.0), lambda s, x: s + F.coalesce(F.try_element_at(weights, x), F.lit(OTHER_WEIGHT)))
    uses = F.when(F.array_contains("sources", "existing_tags"), F.least(F.lit(MOST_USES), PER_USE * F.col("uses"))).otherwise(0.0)
    score = F.least(F.lit(MOST), total + SEVERAL * (F.size("sources") - 1) + uses)
    return rows.where(useful(F.col("tag"))).select("doc_id", "tag", F.round(score + SMALL, 3).alias("score"), "sources")


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "tag"))).where(F.col("rank") <= k)


def _held_in(tags: DataFrame, parts: DataFrame) -> DataFrame:
    """doc_id, tag, uses: the tags in use (tag, uses) of which the parts (doc_id, tokens) of a draft hold OVERLAP, by a prefix join on their rarest parts."""
    often = saved(parts.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("often")))
    split = tags.select("tag", "uses", F.explode(F.array_distinct(F.split("tag", "-"))).alias("token")).join(often, "token", "left")
    asked = split.groupBy("tag").agg(F.first("uses").alias("uses"), F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "token"))).alias("all"))
    asked = asked.withColumn("least", F.ceil(OVERLAP * F.size("all") - SMALL).cast("int")).withColumn("head", F.slice("all", F.lit(1), F.size("all") - F.col("least") + 1))
    asked = asked.where(F.size(F.filter("all", lambda x: x["often"] > 0)) >= F.col("least"))
    asked = asked.select("tag", "uses", "least", F.transform("all", lambda x: x["token"]).alias("wanted"), F.explode("head").alias("one")).select("tag", "uses", "least", "wanted", F.col("one.token").alias("token"))
    met = asked.join(parts.select("doc_id", F.explode("tokens").alias("token")), "token").drop("token")
    whole = met.join(parts.select(F.col("doc_id").alias("of"), "tokens"), F.col("doc_id").eqNullSafe(F.col("of")))
    return whole.where(F.size(F.array_intersect("wanted", "tokens")) >= F.col("least")).select("doc_id", "tag", "uses")


def suggestions(drafts: DataFrame, fields: dict[str, str], existing: DataFrame, held: DataFrame | None = None, k: int = 8) -> DataFrame:
    """doc_id, tag, score, sources, rank: the best tags for each draft (doc_id and the columns that fields names by source).

    A source names the tags in its text. A tag in use (existing: tag, n) is named by existing_tags if it is a part of any field's text, or has OVERLAP of its
    parts there. The weights of the sources add up, with something for several sources and for use. Tags that the draft has already (held: doc_id, tag) aren't
    suggested.

    A tag that a field names has all its parts there, so that for those tags an equal tag in use is looked up. Tags in use that no field names score less than
    KNOWN at most: they are looked for by their parts in those drafts only that don't have k better ones.
    """
    tags = saved(existing.where("tag <> ''").groupBy("tag").agg(F.max("n").alias("uses")))
    gathered = _gathered(drafts, list(fields.values()))
    sources = list(fields)
    doc_id = drafts.schema["doc_id"].dataType.simpleString()
    told = gathered.mapInArrow(_told_by(sources, _bitmap(tags), k if held is None else None), f"doc_id {doc_id}, tag string, named int")
    own = [F.when(F.col("named").bitwiseAND(F.lit(1 << j)) != 0, F.lit(s)) for j, s in enumerate(sources)]
    used = F.when(F.col("used"), F.lit("existing_tags"))
    looked_up = told.join(tags.withColumn("used", F.lit(True)), "tag", "left").withColumn("sources", F.array_sort(F.array_distinct(F.array_compact(F.array(*own, used)))))

    def free(rows: DataFrame) -> DataFrame:
        if held is None:
            return rows
        taken = held.select(F.col("doc_id").alias("of"), F.col("tag").alias("taken"))
        return rows.join(taken, (F.col("doc_id") == F.col("of")) & (F.col("tag") == F.col("taken")), "left_anti")

    best = saved(_ranked(free(_scored(looked_up)), k).drop("rank"))
    settled = saved(best.where(F.col("score") > KNOWN).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(F.col("doc_id").alias("of")))
    unsettled = gathered.join(settled, F.col("doc_id").eqNullSafe(F.col("of")), "left_anti")
    parts = saved(unsettled.mapInArrow(_all_parts(len(sources)), f"doc_id {doc_id}, tokens array<string>"))
    known = _held_in(tags, parts).withColumn("sources", F.array(F.lit("existing_tags")))
    every = best.unionByName(free(_scored(known))).groupBy("doc_id", "tag").agg(F.max(F.struct("score", "sources")).alias("best"))
    return _ranked(every.select("doc_id", "tag", "best.score", "best.sources"), k)


def policy_faults(synonyms: DataFrame, canonical: DataFrame, deprecated: DataFrame) -> DataFrame:
    """code, tag of what is wrong with a policy: synonyms (tag, target), canonical tags (tag), deprecated tags (tag, replacement).

    Targets are followed by doubling: each round every pointer takes the place of its target's pointer, so that rounds are the logarithm of the longest
    chain. A pointer that still is a synonym afterwards runs in a cycle.
    """
    names = canonical.select("tag").distinct()
    chains = saved(synonyms.select("tag", "target"))
    for _ in range(chains.count().bit_length() + 1):
        following = chains.select(F.col("tag").alias("target"), F.col("target").alias("further"))
        chains = saved(chains.join(following, "target", "left").select("tag", F.coalesce("further", "target").alias("target")))
    in_cycle = chains.join(synonyms.select(F.col("tag").alias("target")), "target", "left_semi").select("tag")
    dangling = chains.join(in_cycle, "tag", "left_anti").join(names.withColumnRenamed("tag", "target"), "target", "left_anti").select("tag")
    known = names.unionByName(synonyms.select("tag")).withColumnRenamed("tag", "replacement")
    lost = deprecated.where(F.trim(F.col("replacement").cast("string")) != "").join(known, "replacement", "left_anti").select("tag")
    parts = {
        "alias_is_canonical": synonyms.join(names, "tag", "left_semi").select("tag"), "synonym_cycle": in_cycle, "target_not_canonical": dangling,
        "deprecated_is_canonical": deprecated.join(names, "tag", "left_semi").select("tag"), "replacement_not_canonical": lost,
    }
    return reduce(DataFrame.unionByName, (d.select(F.lit(code).alias("code"), "tag") for code, d in parts.items()))
