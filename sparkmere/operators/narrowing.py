"""Metadata narrowing: an alias table of field values, what each query names of it, and the filters that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmere.operators.bitmaps import count_under
from sparkmere.operators.setjoin import similar_sets
from sparkmere.plans.saving import saved

CJK = "[一-鿿]"
ACTIVE = ("", "active")
#: Rows that a task writes out for its keys, tasks at most, and bases of a list on average, where keys meet the bases of their realm.
PAIRS_OF_TASK, MOST_TASKS, LISTED = 4_000_000, 10_000, 100_000


def normalized_text(value: Column) -> Column:
    """Lower case with single hyphens for white space and underscores."""
    hyphened = F.regexp_replace(F.lower(F.trim(value)), r"[\s_]+", "-")
    return F.regexp_replace(F.regexp_replace(hyphened, "-+", "-"), "^-+|-+$", "")


def plain_identifier(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), "[^a-z0-9]+", "")


def is_active(status: Column) -> Column:
    """Null, empty and active; everything else has been retired."""
    return F.lower(F.trim(F.coalesce(status, F.lit("")))).isin(*ACTIVE)


def allowed(kb: Column, kbs: Column, scope: Column, wanted: str, revoked: Column) -> Column:
    """Whether a key may use a knowledge base: not revoked, holding the wanted scope, with the base (or *) among its bases."""
    return ~F.coalesce(revoked, F.lit(False)) & F.array_contains(scope, wanted) & (F.array_contains(kbs, kb) | F.array_contains(kbs, "*"))


def allowed_of_realm(keys: DataFrame, bases: DataFrame, wanted: str) -> DataFrame:
    """key_id, kb, allowed of each key (key_id, realm, kbs, scope, revoked) and each base of its realm (kb, realm, name, as keys hold it).

    A key is decided on once for each name in its realm, and a row for each base is only written out: their number grows with the product of both tables. So keys are
    dealt into tasks of about PAIRS_OF_TASK rows, and bases of a name come in lists of LISTED on average at most.
    """
    sizes = keys.groupBy("realm").agg(F.count(F.lit(1)).alias("keys")).join(bases.groupBy("realm").agg(F.count(F.lit(1)).alias("bases")), "realm")
    pairs, most = sizes.agg(F.sum(F.col("keys").cast("double") * F.col("bases")), F.max("bases")).head()
    tasks = int(min(MOST_TASKS, max(keys.sparkSession.sparkContext.defaultParallelism, (pairs or 0) // PAIRS_OF_TASK)))
    part = F.pmod(F.xxhash64("kb"), F.lit(-(-(most or 1) // LISTED)))
    # collect_list leaves out nulls, so that bases are held as structs.
    lists = saved(bases.groupBy("realm", "name", part.alias("part")).agg(F.collect_list(F.struct("kb")).alias("bases")))
    met = keys.repartition(tasks, "key_id").join(lists, "realm")
    decided = met.select("key_id", allowed(F.col("name"), F.col("kbs"), F.col("scope"), wanted, F.col("revoked")).alias("allowed"), "bases")
    return decided.select("key_id", F.explode("bases").alias("base"), "allowed").select("key_id", "base.kb", "allowed")


def metadata_values(nodes: DataFrame, fields: list[str]) -> DataFrame:
    """field, value, normal, nodes: the distinct values of each field, by their normal form; the least spelling stands for all."""
    each = nodes.select("node_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("x")).select("node_id", "x.*")
    each = each.where("value IS NOT NULL AND trim(value) <> ''").withColumn("normal", normalized_text(F.col("value")))
    return each.groupBy("field", "normal").agg(F.min("value").alias("value"), F.count(F.lit(1)).alias("nodes"))


def alias_table(values: DataFrame, synonyms: DataFrame) -> DataFrame:
    """alias, field, normal, value, place: every value under its own name (place null) and categories under their synonyms (alias, category, place)."""
    own = values.select(F.col("normal").alias("alias"), "field", "normal", "value", F.lit(None).cast("int").alias("place"))
    more = synonyms.select(normalized_text(F.col("alias")).alias("alias"), normalized_text(F.col("category")).alias("normal"), "place")
    named = more.join(values.where("field = 'category'"), "normal").select("alias", "field", "normal", "value", "place")
    return own.unionByName(named)


def detected(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """query_id, field, value, normal: what each query (query_id, text) names: of each field the first value.

    A model counts if its plain form equals a token's; other values as whole runs of words, of any length: a value is looked up by the rarest of its words, and
    then for itself. Terms in CJK are looked for as parts of the text, by their first character. Of models and brands the first in order of normal form wins, of categories first the synonyms in their order.
    """
    plain = F.transform(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9][A-Za-z0-9._-]*"), F.lit(0)), plain_identifier)
    tokens = queries.select("query_id", F.explode(F.array_distinct(plain)).alias("plain")).where("plain <> ''")
    models = aliases.where("field = 'model'").withColumn("plain", plain_identifier(F.col("value"))).where("plain <> ''")
    by_model = tokens.join(models, "plain").select("query_id", "field", "value", "normal", "place")
    others = aliases.where("field <> 'model'")
    plain_text = queries.select("query_id", normalized_text(F.col("text")).alias("flat"))
    words = others.where("alias <> ''").select(F.col("alias").alias("id"), F.split("alias", "-").alias("tokens")).distinct()
    met = similar_sets(words, plain_text.select(F.col("query_id").alias("id"), F.split("flat", "-").alias("tokens")), 1.0, containment=True)
    met = met.select(F.col("left").alias("alias"), F.col("right").alias("query_id")).join(plain_text, "query_id")
    framed = lambda c: F.concat(F.lit("-"), c, F.lit("-"))
    by_run = met.where(F.contains(framed("flat"), framed("alias"))).join(others, "alias").select("query_id", "field", "value", "normal", "place")
    cjk = others.where(F.col("alias").rlike(CJK)).withColumn("part", F.replace("alias", F.lit("-"), F.lit("")))
    flat = queries.select("query_id", F.replace(normalized_text(F.col("text")), F.lit("-"), F.lit("")).alias("flat")).where(F.col("flat").rlike(CJK))
    grams = flat.select("query_id", "flat", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("flat")), lambda i: F.substring("flat", i, F.lit(1))))).alias("gram"))
    by_part = grams.join(cjk.withColumn("gram", F.substring("part", 1, 1)), "gram").where(F.contains("flat", "part")).select("query_id", "field", "value", "normal", "place")
    order = Window.partitionBy("query_id", "field").orderBy(F.col("place").asc_nulls_last(), "normal")
    every = by_model.unionByName(by_run).unionByName(by_part)
    return every.withColumn("k", F.row_number().over(order)).where("k = 1").select("query_id", "field", "value", "normal")


def narrowing(queries: DataFrame, found: DataFrame, values: DataFrame, index: DataFrame, least: int = 1, category: str = "hard", brand: str = "hard_if_unique") -> DataFrame:
    """query_id, hard, boost (maps field -> normal value), mode, candidates, reason of every query (query_id, text, explicit map).

    A model filters hard, a category by policy (hard or boost), a brand by policy (hard, hard_if_unique: if there is one brand only, or boost). index is the
    bitmap index of the nodes, by which the nodes under filters are counted. A hard value that contradicts an explicit one, or fewer than
    least nodes under all filters, leaves the boosts alone, and reason tells why.
    """
    one_brand = values.where("field = 'brand'").agg((F.count(F.lit(1)) == 1).alias("one_brand"))
    by_policy = {"category": F.lit(category == "hard"), "brand": F.lit(brand == "hard") | (F.lit(brand == "hard_if_unique") & F.col("one_brand"))}
    hard = (F.col("field") == "model") | ((F.col("field") == "category") & by_policy["category"]) | ((F.col("field") == "brand") & by_policy["brand"])
    marked = found.join(F.broadcast(one_brand)).withColumn("hard", hard)  # a single row

    def as_map(condition: Column) -> Column:
        return F.map_from_entries(F.array_sort(F.collect_list(F.when(condition, F.struct("field", "normal")))))

    told = marked.groupBy("query_id").agg(as_map(F.col("hard")).alias("hard"), as_map(~F.col("hard")).alias("boost"))
    empty = F.create_map().cast("map<string,string>")
    own = queries.join(told, "query_id", "left").withColumns({"hard": F.coalesce("hard", empty), "boost": F.coalesce("boost", empty), "explicit": F.coalesce("explicit", empty)})
    clash = F.filter(F.map_keys("hard"), lambda k: F.col("explicit")[k].isNotNull() & (normalized_text(F.col("explicit")[k]) != F.col("hard")[k]))
    own = own.withColumn("clash", F.array_sort(clash)).withColumn("wanted", F.map_concat(F.map_filter("explicit", lambda k, _: ~F.array_contains(F.map_keys("hard"), k)), F.col("hard")))
    counted = own.where(F.size("hard") > 0).select("query_id", "wanted").join(candidates(own.where(F.size("hard") > 0), index), "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("candidates"))
    own = own.join(counted, "query_id", "left")
    few = F.coalesce(F.col("candidates") < least, F.lit(False))
    reason = F.when(F.size("clash") > 0, F.concat(F.lit("conflicts_with_explicit_filter:"), F.array_join("clash", ","))).when(few, "empty_candidate_fallback")
    own = own.withColumn("reason", reason).withColumn("hard", F.when(F.col("reason").isNull(), F.col("hard")).otherwise(empty))
    mode = F.when((F.size("hard") > 0) & (F.size("boost") > 0), "mixed").when(F.size("hard") > 0, "hard_filter").when(F.size("boost") > 0, "boost").otherwise("none")
    return own.select("query_id", "explicit", "hard", "boost", mode.alias("mode"), F.when(F.size("clash") == 0, F.col("candidates")).alias("candidates"), "reason")


def candidates(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """query_id, n: how many nodes hold all wanted values (query_id, wanted map), by a bitmap index. Queries with equal filters are counted once."""
    sets = wanted.select(F.array_sort(F.map_entries("wanted")).alias("filters")).distinct().withColumn("key", F.xxhash64(F.to_json("filters")))
    asked = sets.select("key", F.explode("filters").alias("f")).select("key", F.col("f.key").alias("field"), normalized_text(F.col("f.value")).alias("normal"))
    counts = count_under(asked, index)
    return wanted.select("query_id", F.xxhash64(F.to_json(F.array_sort(F.map_entries("wanted")))).alias("key")).join(counts, "key").select("query_id", "n")


def merged_filters(decisions: DataFrame) -> DataFrame:
    """query_id, filters: the explicit filters and, without a fallback, the hard ones over them."""
    over = F.map_concat(F.map_filter("explicit", lambda k, _: ~F.array_contains(F.map_keys("hard"), k)), F.col("hard"))
    return decisions.select("query_id", F.when(F.col("reason").isNull(), over).otherwise(F.col("explicit")).alias("filters"))


def governed_tags(wanted: DataFrame, policy: DataFrame) -> DataFrame:
    """query_id, tags: of each wanted tag (query_id, tag) its canonical name by policy (tag, canonical) and itself, sorted."""
    named = wanted.join(policy.select("tag", "canonical"), "tag", "left")
    both = named.select("query_id", F.explode(F.array_compact(F.array("tag", "canonical"))).alias("tag"))
    return both.groupBy("query_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
