from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmere.catalogue import query
from sparkmere.operators import bitmaps, narrowing
from sparkmere.sources.tables import manuals, table

SYNONYMS = [("fridge", "small", 1), ("冰箱", "economy", 2), ("oven", "no such category", 3)]


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), F.concat(F.lit("MX-"), "p_partkey").alias("model"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 20th part stands for a question: about its model, about its brand and type, by a synonym, in Chinese, or about nothing."""
    turn = F.col("p_partkey") / 20 % 5
    text = (
        F.when(turn == 0, F.concat(F.lit("How do I reset the mx_"), "p_partkey", F.lit(" and mx-"), "p_partkey", F.lit("?")))
        .when(turn == 1, F.concat(F.lit("Is "), "p_brand", F.lit(" sold  in "), "p_type", F.lit(" or in PROMO")))
        .when(turn == 2, "Cheap Fridge or oven please")
        .when(turn == 3, "我的冰箱怎么办")
        .otherwise("nothing named here")
    )
    explicit = F.when(F.col("p_partkey") % 3 == 0, F.create_map(F.lit("category"), F.lit(" Promo ")))
    return table(spark, sf_dir, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), text.alias("text"), explicit.alias("explicit"))


DETECTED = r"""
q AS (SELECT p_partkey AS query_id, CASE (p_partkey // 20) % 5 WHEN 0 THEN 'How do I reset the mx_' || p_partkey || ' and mx-' || p_partkey || '?' WHEN 1 THEN 'Is ' || p_brand || ' sold  in ' || p_type || ' or in PROMO'
  WHEN 2 THEN 'Cheap Fridge or oven please' WHEN 3 THEN '我的冰箱怎么办' ELSE 'nothing named here' END AS text, CASE WHEN p_partkey % 3 = 0 THEN 'promo' END AS ecat FROM part WHERE p_partkey % 20 = 0),
nq AS (SELECT *, trim(regexp_replace(regexp_replace(lower(trim(text)), '[\s_]+', '-', 'g'), '-+', '-', 'g'), '-') AS t FROM q),
al AS (SELECT DISTINCT lower(p_brand) AS alias, 'brand' AS field, lower(p_brand) AS normal, NULL::INT AS place FROM part UNION ALL SELECT DISTINCT lower(p_type), 'category', lower(p_type), NULL FROM part
  UNION ALL SELECT * FROM (VALUES ('fridge', 'category', 'small', 1), ('冰箱', 'category', 'economy', 2)) v(a, f, n, p) WHERE n IN (SELECT lower(p_type) FROM part)),
dm AS (SELECT query_id, min('mx-' || p_partkey) AS normal FROM nq JOIN part ON list_contains(list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9._-]*'), lambda x: regexp_replace(lower(x), '[^a-z0-9]+', '', 'g')), 'mx' || p_partkey) GROUP BY ALL),
det AS (SELECT query_id, field, normal FROM nq JOIN al ON CASE WHEN alias = '冰箱' THEN contains(replace(t, '-', ''), alias) ELSE regexp_matches(t, '(^|-)' || regexp_escape(alias) || '($|-)') END
  QUALIFY row_number() OVER (PARTITION BY query_id, field ORDER BY place NULLS LAST, normal) = 1 UNION ALL SELECT query_id, 'model', normal FROM dm),
dec AS (SELECT q.query_id, ecat, max(CASE WHEN field = 'model' THEN normal END) AS model, max(CASE WHEN field = 'category' THEN normal END) AS category, max(CASE WHEN field = 'brand' THEN normal END) AS brand FROM q LEFT JOIN det USING (query_id) GROUP BY ALL),
cnt AS (SELECT d.*, (model IS NOT NULL OR category IS NOT NULL) AS some_hard, coalesce(category <> ecat, false) AS clash,
  (SELECT count(*) FROM part p WHERE (d.model IS NULL OR 'mx-' || p.p_partkey = d.model) AND (coalesce(d.category, d.ecat) IS NULL OR lower(p_type) = coalesce(d.category, d.ecat))) AS n FROM dec d),
fin AS (SELECT *, CASE WHEN clash THEN 'conflicts_with_explicit_filter:category' WHEN some_hard AND n < 1 THEN 'empty_candidate_fallback' END AS reason FROM cnt)
"""


@query(f"WITH {DETECTED} SELECT query_id, field, normal FROM det")
def narrowing_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir)[1].select("query_id", "field", "normal")


def found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    values = narrowing.metadata_values(nodes(spark, sf_dir), ["model", "brand", "category"])
    aliases = narrowing.alias_table(values, spark.createDataFrame(SYNONYMS, "alias string, category string, place int"))
    return values, narrowing.detected(asked(spark, sf_dir), aliases)


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, named = found(spark, sf_dir)
    return narrowing.narrowing(asked(spark, sf_dir), named, values, part_index(spark, sf_dir))


def part_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitmaps.bitmap_index(bitmaps.metadata_pairs(nodes(spark, sf_dir), narrowing.normalized_text, ["model", "brand", "category"]))


@query("""WITH x AS (SELECT p_partkey AS id, unnest(['model', 'brand', 'category']) AS field, unnest(['mx-' || p_partkey, lower(p_brand), lower(p_type)]) AS normal FROM part),
l AS (SELECT l_orderkey AS id, 'tags' AS field, l_partkey::VARCHAR AS normal FROM lineitem UNION SELECT l_orderkey, 'attributes.flag', lower(l_returnflag) FROM lineitem UNION SELECT l_orderkey, 'flag', lower(l_returnflag) FROM lineitem)
SELECT 'part' AS kind, field, normal, CASE WHEN id > 0 THEN 1 + (id - 1) // 32768 ELSE id // 32768 END AS bucket, count(*) AS n FROM x GROUP BY ALL UNION ALL SELECT 'order', field, normal, CASE WHEN id > 0 THEN 1 + (id - 1) // 32768 ELSE id // 32768 END, count(*) FROM l GROUP BY ALL""")
def metadata_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with their scalar fields, orders with their parts as tags and the return flags of their lines as an attribute."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("node_id")).agg(F.collect_set("l_partkey").alias("tags"), F.create_map(F.lit("flag"), F.collect_set("l_returnflag")).alias("attributes"))
    orders = bitmaps.bitmap_index(bitmaps.metadata_pairs(lines, narrowing.normalized_text, lists={"tags": "tags"}, attributes="attributes"))
    both = part_index(spark, sf_dir).withColumn("kind", F.lit("part")).unionByName(orders.withColumn("kind", F.lit("order")))
    return both.select("kind", "field", "normal", "bucket", "n")


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS id, l_returnflag AS f, l_linestatus AS s FROM lineitem),
w AS (SELECT s_suppkey AS query_id, ['A', 'N', 'R'][1 + s_suppkey % 3] AS a, ['A', 'N', 'R'][1 + (s_suppkey // 3) % 3] AS b, ['F', 'O'][1 + s_suppkey % 2] AS s FROM supplier)
SELECT query_id, count(DISTINCT x.id) AS n FROM w LEFT JOIN (SELECT x.id, x.f, y.s FROM l x JOIN l y USING (id)) x ON x.f IN (w.a, w.b) AND x.s = w.s GROUP BY query_id""")
def filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders have a line with one of two return flags and a line of a status, for each supplier's filters."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("node_id")).agg(F.collect_set("l_returnflag").alias("flags"), F.collect_set("l_linestatus").alias("states"))
    index = bitmaps.bitmap_index(bitmaps.metadata_pairs(lines, narrowing.normalized_text, lists={"flag": "flags", "status": "states"}))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"))
    flag, status = (F.array(*map(F.lit, values)) for values in (("a", "n", "r"), ("f", "o")))
    at = lambda values, k: F.get(values, k.cast("int"))
    wants = F.array(*(F.struct(F.lit(f).alias("field"), v.alias("normal")) for f, v in (("flag", at(flag, F.col("key") % 3)), ("flag", at(flag, F.floor(F.col("key") / 3) % 3)), ("status", at(status, F.col("key") % 2)))))
    counts = bitmaps.count_under(supplier.select("key", F.explode(wants).alias("w")).select("key", "w.field", "w.normal"), index)
    return supplier.join(counts, "key", "left").select(F.col("key").alias("query_id"), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {DETECTED} SELECT query_id, CASE WHEN reason IS NULL THEN model END AS model, CASE WHEN reason IS NULL THEN category END AS category, brand,
CASE WHEN reason IS NULL AND some_hard THEN CASE WHEN brand IS NULL THEN 'hard_filter' ELSE 'mixed' END WHEN brand IS NOT NULL THEN 'boost' ELSE 'none' END AS mode, CASE WHEN some_hard AND NOT clash THEN n END AS candidates, reason FROM fin""")
def narrowing_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = decisions(spark, sf_dir)
    return told.select("query_id", F.col("hard")["model"].alias("model"), F.col("hard")["category"].alias("category"), F.col("boost")["brand"].alias("brand"), "mode", "candidates", "reason")


@query(f"""WITH {DETECTED} SELECT query_id, concat_ws(',', CASE WHEN reason IS NULL AND category IS NOT NULL THEN 'category=' || category WHEN ecat IS NOT NULL THEN 'category= Promo ' END,
CASE WHEN reason IS NULL THEN 'model=' || model END) AS filters FROM fin""")
def narrowing_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = narrowing.merged_filters(decisions(spark, sf_dir))
    return merged.select("query_id", F.array_join(F.transform(F.array_sort(F.map_entries("filters")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("filters"))


@query("SELECT DISTINCT lower(p_brand) AS alias, 'brand' AS field, lower(p_brand) AS normal FROM part UNION ALL SELECT DISTINCT lower(p_type), 'category', lower(p_type) FROM part UNION ALL SELECT a, 'category', n FROM (VALUES ('fridge', 'small'), ('冰箱', 'economy')) v(a, n) WHERE n IN (SELECT lower(p_type) FROM part)")
def narrowing_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = narrowing.metadata_values(nodes(spark, sf_dir), ["brand", "category"])
    return narrowing.alias_table(values, spark.createDataFrame(SYNONYMS, "alias string, category string, place int")).select("alias", "field", "normal")


@query("""WITH w AS (SELECT l_orderkey AS query_id, l_partkey AS tag FROM lineitem), n AS (SELECT query_id, tag FROM w UNION SELECT query_id, tag // 10 * 10 FROM w WHERE tag % 10 IN (1, 2))
SELECT query_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM n GROUP BY ALL""")
def governed_filter_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts stand for tags; those that end in 1 or 2 are synonyms of the ten below."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("tag")).distinct()
    policy = table(spark, sf_dir, "part").where("p_partkey % 10 in (1, 2)").select(F.col("p_partkey").alias("tag"), (F.floor(F.col("p_partkey") / 10) * 10).alias("canonical"))
    return narrowing.governed_tags(lines, policy).withColumn("tags", F.array_join(F.col("tags").cast("array<string>"), ","))


@query("SELECT o_orderkey AS manual, CASE o_orderstatus WHEN 'O' THEN ' Active ' WHEN 'P' THEN '' ELSE 'archived' END IN (' Active ', '') AS active FROM orders")
def active_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("status") == "O", " Active ").when(F.col("status") == "P", "").otherwise("archived")
    return manuals(spark, sf_dir).select("manual", narrowing.is_active(status).alias("active"))


@query("""SELECT c_custkey AS key_id, s_suppkey AS kb, c_custkey % 11 <> 0 AND c_custkey % 2 = 0 AND (s_suppkey % 5 = c_custkey % 5 OR c_custkey % 13 = 0) AS allowed FROM customer, supplier WHERE c_nationkey = s_nationkey""")
def acl_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand for keys and suppliers of their nation for the bases that they ask for."""
    key = F.col("c_custkey")
    kbs = F.when(key % 13 == 0, F.array(F.lit("*"))).otherwise(F.array(F.concat(F.lit("group-"), key % 5)))
    scope = F.when(key % 2 == 0, F.array(F.lit("search"), F.lit("read"))).otherwise(F.array(F.lit("read")))
    keys = table(spark, sf_dir, "customer").select(key.alias("key_id"), F.col("c_nationkey").alias("realm"), kbs.alias("kbs"), scope.alias("scope"), F.when(key % 11 == 0, True).alias("revoked"))
    bases = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("kb"), F.col("s_nationkey").alias("realm"), F.concat(F.lit("group-"), F.col("s_suppkey") % 5).alias("name"))
    return narrowing.allowed_of_realm(keys, bases, "search")
