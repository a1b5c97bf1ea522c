"""The registered queries over the driver's tables, each with its SQL.

Every query applies one of the library's operators to whole tables.  The SQL is written
for DuckDB and says the same thing independently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratawise.functions import fuzzy, text, values
from stratawise.operators import aggregate, diff, hierarchy, integrity, lint, lookup, options, packaging, precedence, staging, validate
from stratawise.session import table
from stratawise.sources import binary_tree, loca, stats_text, trees

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


c = F.col


# --- lookups and precedence ---------------------------------------------------------------------------


@query("""
WITH u AS (SELECT 0 AS r, lower(s_name) AS uuid, s_name AS display FROM supplier
           UNION ALL SELECT 1, lower(c_name), coalesce(nullif(c_mktsegment, ''), c_name) FROM customer),
     f AS (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY r, display) AS k FROM u)
SELECT uuid, display, r AS source FROM f WHERE k = 1 ORDER BY uuid LIMIT 50 OFFSET 20""")
def section_entries_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of entries from two sources, the first of which wins by key."""
    a = table(spark, d, "supplier").select(F.lower("s_name").alias("uuid"), c("s_name").alias("display"))
    b = table(spark, d, "customer").select(F.lower("c_name").alias("uuid"), lookup.display_name(c("c_mktsegment"), key=c("c_name")).alias("display"))
    both = precedence.ranked_union([("supplier", a), ("customer", b)])
    won = precedence.first_wins(both, ["uuid"], [c("_rank"), c("display")])
    return lookup.page(won.select("uuid", "display", c("_rank").alias("source")), ["uuid"], 20, 50)


@query("""
SELECT p_brand, p_partkey, p_type FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY
  CASE WHEN p_type LIKE '%BRASS%' THEN 0 WHEN p_type LIKE '%STEEL%' THEN 1 ELSE 2 END, p_retailprice DESC, p_partkey) AS k FROM part) WHERE k = 1""")
def main_table_topk(spark: SparkSession, d: str) -> DataFrame:
    order = F.when(c("p_type").contains("BRASS"), 0).when(c("p_type").contains("STEEL"), 1).otherwise(2)
    return precedence.first_wins(table(spark, d, "part"), ["p_brand"], [order, c("p_retailprice").desc(), c("p_partkey")]).select("p_brand", "p_partkey", "p_type")


@query("""
SELECT c_nationkey, c_mktsegment, c_custkey, c_name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS k FROM customer) WHERE k = 1""")
def entries_by_folder_distinct(spark: SparkSession, d: str) -> DataFrame:
    return precedence.first_wins(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], [c("c_custkey")]).select("c_nationkey", "c_mktsegment", "c_custkey", "c_name")


@query("""
SELECT p_partkey, source, pos - 1 AS pos, trim(w) AS item FROM (
  SELECT p_partkey, CASE WHEN trim(p_type) <> '' THEN 'p_type' ELSE 'p_name' END AS source,
         list_filter(string_split(CASE WHEN trim(p_type) <> '' THEN p_type ELSE p_name END, ' '), lambda x: trim(x) <> '') AS ws
  FROM part) t, LATERAL (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS pos)""")
def list_items_explode(spark: SparkSession, d: str) -> DataFrame:
    """The list items of every part."""
    return lookup.list_items(table(spark, d, "part"), "p_partkey", ["p_type", "p_name"], " ").withColumn("pos", c("pos").cast("long"))


@query("SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL AND event_type <> '' ORDER BY 1")
def distinct_selector_ids(spark: SparkSession, d: str) -> DataFrame:
    return lookup.distinct_values(table(spark, d, "events"), "event_type")


@query("SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_nationkey) AS items FROM nation GROUP BY 1")
def value_lists(spark: SparkSession, d: str) -> DataFrame:
    return lookup.value_lists(table(spark, d, "nation"), "n_regionkey", "n_nationkey", "n_name").withColumn("items", F.array_join("items", ";"))


@query("""
WITH u AS (SELECT 0 AS r, CAST(c_custkey AS VARCHAR) AS id, c_name AS label FROM customer
           UNION ALL SELECT 1, CAST(s_suppkey AS VARCHAR), s_name || ' (supplier)' FROM supplier
           UNION ALL SELECT 2, CAST(n_nationkey AS VARCHAR), n_name FROM nation)
SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r) AS k FROM u) WHERE k = 1 ORDER BY label, id""")
def progression_union_first_wins(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(c("c_custkey").cast("string").alias("id"), c("c_name").alias("label"))
    b = table(spark, d, "supplier").select(c("s_suppkey").cast("string").alias("id"), F.concat("s_name", F.lit(" (supplier)")).alias("label"))
    n = table(spark, d, "nation").select(c("n_nationkey").cast("string").alias("id"), c("n_name").alias("label"))
    return precedence.union_first_wins([("customer", a), ("supplier", b), ("nation", n)], ["id"]).select("id", "label").orderBy("label", "id")


@query("""
WITH l AS (SELECT l_orderkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1),
     o AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F')
SELECT l_partkey, l_orderkey, o_orderstatus FROM l JOIN o ON l_orderkey = o_orderkey""")
def icon_atlas_join(spark: SparkSession, d: str) -> DataFrame:
    """The first line of each part, then the match test: a first line without a match hides later ones."""
    lines = table(spark, d, "lineitem").select(c("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linenumber")
    orders = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus")
    joined = lookup.first_then_join(lines, "l_partkey", [c("o_orderkey"), c("l_linenumber")], orders, [c("o_orderstatus")], "o_orderkey")
    return joined.select("l_partkey", c("o_orderkey").alias("l_orderkey"), "o_orderstatus")


@query("""
SELECT o_orderkey, coalesce(n, 0) AS n_children, coalesce(ids, '') AS children FROM orders LEFT JOIN (
  SELECT l_orderkey, count(*) AS n, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS ids FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def children_group_join(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(c("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linenumber")
    out = lookup.with_children(table(spark, d, "orders").select("o_orderkey"), lines, "o_orderkey", "l_partkey", "l_linenumber")
    return out.select("o_orderkey", "n_children", F.coalesce(F.array_join(c("children").cast("array<string>"), ","), F.lit("")).alias("children"))


@query("""
SELECT n_name AS table_name, coalesce(k.n, 0) AS n_children FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) k ON n_nationkey = c_nationkey
WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0 AND s_nationkey IS NOT NULL)""")
def available_sections(spark: SparkSession, d: str) -> DataFrame:
    nation, links = table(spark, d, "nation"), table(spark, d, "supplier").where("s_acctbal < 0").select(c("s_nationkey").alias("n_nationkey"))
    top = nation.join(links, "n_nationkey", "left_anti")
    counts = table(spark, d, "customer").groupBy(c("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_children"))
    return top.join(counts, "n_nationkey", "left").na.fill(0, ["n_children"]).select(c("n_name").alias("table_name"), "n_children")


@query("""
SELECT p_partkey, field, value FROM (SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size FROM part) UNPIVOT (value FOR field IN (p_name, p_brand, p_type, p_size))""")
def stat_map_fields(spark: SparkSession, d: str) -> DataFrame:
    return lookup.unpivot_fields(table(spark, d, "part"), "p_partkey", ["p_name", "p_brand", "p_type", "p_size"])


@query("""
SELECT 'group' AS kind, r_name AS label, r_name AS name FROM region UNION ALL SELECT 'resource', n_name, n_name FROM nation ORDER BY 1, 2, 3""")
def cost_resources_sort(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "region").select(c("r_name").alias("name"))
    b = table(spark, d, "nation").select(c("n_name").alias("name"))
    return lookup.tagged_options([("group", a), ("resource", b)], ["name"], "name").select("kind", "label", "name")


@query("""
SELECT 'main' AS _db, s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT 'mods', c_custkey, c_name FROM customer WHERE c_acctbal > 5000""")
def cross_source_union_all(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "supplier").select(c("s_suppkey").alias("id"), c("s_name").alias("name"))
    b = table(spark, d, "customer").where("c_acctbal > 5000").select(c("c_custkey").alias("id"), c("c_name").alias("name"))
    return precedence.ranked_union([("main", a), ("mods", b)]).select("_db", "id", "name")


@query("""
SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000 UNION ALL SELECT c_nationkey FROM customer WHERE c_acctbal > 9500)""")
def cross_source_exists(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "supplier").where("s_acctbal > 9000").select(c("s_nationkey").alias("n_nationkey")).union(table(spark, d, "customer").where("c_acctbal > 9500").select("c_nationkey"))
    return table(spark, d, "nation").join(keys, "n_nationkey", "left_semi").select("n_nationkey", "n_name")


# --- integrity ---------------------------------------------------------------------------------------------


@query("""
SELECT DISTINCT l_partkey AS value FROM lineitem WHERE l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)
AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size BETWEEN 3 AND 10)""")
def fk_unresolved(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return integrity.unresolved(table(spark, d, "lineitem"), "l_partkey", part.where("p_size > 10"), "p_partkey", [part.where("p_size BETWEEN 3 AND 10")])


@query("""
SELECT CASE WHEN a.p_partkey IS NOT NULL THEN 'main' WHEN b.p_partkey IS NOT NULL THEN 'fallback' ELSE 'unresolved' END AS status, count(*) AS rows
FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 10) a ON l_partkey = a.p_partkey LEFT JOIN (SELECT p_partkey FROM part WHERE p_size BETWEEN 3 AND 12) b ON l_partkey = b.p_partkey GROUP BY 1""")
def fk_report(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return integrity.reference_report(table(spark, d, "lineitem"), "l_partkey", part.where("p_size > 10"), "p_partkey", [("fallback", part.where("p_size BETWEEN 3 AND 12"))])


@query("""
WITH t AS (SELECT c_custkey AS id, c_name AS name, 1 AS version FROM customer WHERE c_custkey % 3 <> 0)
SELECT * FROM t UNION ALL SELECT DISTINCT o_custkey, NULL, 0 FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT id FROM t)""")
def orphan_backfill(spark: SparkSession, d: str) -> DataFrame:
    target = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(c("c_custkey").alias("id"), c("c_name").alias("name"), F.lit(1).alias("version"))
    return integrity.backfill(target, "id", [(table(spark, d, "orders"), "o_custkey")], version=0)


@query("""
SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC NULLS LAST, event_id) AS k FROM events) WHERE k = 1""")
def insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    return precedence.first_wins(table(spark, d, "events"), ["user_id", "event_type"], [c("value").desc_nulls_last(), c("event_id")]).select("user_id", "event_type", "event_id")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (
  SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1)""")
def subtree_skip(spark: SparkSession, d: str) -> DataFrame:
    """Lines stay only when their order survived precedence among its customer's orders."""
    won = precedence.first_wins(table(spark, d, "orders"), ["o_custkey"], [c("o_totalprice").desc(), c("o_orderkey")]).select(c("o_orderkey").alias("l_orderkey"))
    return precedence.keep_under_survivors(table(spark, d, "lineitem"), won, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 7 = 0 THEN 'over' ELSE 'base' END AS origin FROM orders""")
def overlay_baseline(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "orders").select("o_orderkey", c("o_orderstatus").alias("status"), F.lit("base").alias("origin"))
    over = base.where("o_orderkey % 7 = 0").withColumns({"status": F.lit("X"), "origin": F.lit("over")})
    return precedence.overlay(base, over, ["o_orderkey"])


# --- diff ----------------------------------------------------------------------------------------------------


@query("""
WITH mine AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_name || '!' ELSE p_name END AS p_name, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part),
     base AS (SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 11 <> 0)
SELECT m.p_partkey, CASE WHEN b.p_partkey IS NULL THEN 'New' ELSE 'Modified' END AS change,
  CASE WHEN b.p_partkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN m.p_name IS DISTINCT FROM b.p_name THEN 'p_name' END, CASE WHEN m.p_size IS DISTINCT FROM b.p_size THEN 'p_size' END) END AS fields
FROM mine m LEFT JOIN base b ON m.p_partkey = b.p_partkey WHERE b.p_partkey IS NULL OR m.p_name IS DISTINCT FROM b.p_name OR m.p_size IS DISTINCT FROM b.p_size""")
def diff_new_modified(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    mine = part.withColumns({"p_name": F.when(c("p_partkey") % 5 == 0, F.concat("p_name", F.lit("!"))).otherwise(c("p_name")), "p_size": F.when(c("p_partkey") % 7 == 0, c("p_size") + 1).otherwise(c("p_size"))})
    return diff.diff_columns(mine, part.where("p_partkey % 11 <> 0"), "p_partkey", ["p_name", "p_size"]).withColumn("fields", F.array_join("fields", ","))


@query(r"""
WITH w AS (SELECT conv_id, turn, list_filter(list_transform(string_split(coalesce(text, ''), ' '), lambda x: trim(x)), lambda x: x <> '') AS ws FROM conversations),
     p AS (SELECT a.conv_id, a.turn, a.ws AS mine, b.ws AS base FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1)
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(mine, lambda x: NOT list_contains(base, x)))), ' ') AS added,
       array_to_string(list_sort(list_distinct(list_filter(base, lambda x: NOT list_contains(mine, x)))), ' ') AS removed FROM p""")
def diff_delimited_sets(spark: SparkSession, d: str) -> DataFrame:
    """Words of each turn that the turn before lacks, and the other way round."""
    t = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.max("text").alias("mine"))
    before = t.select("conv_id", (c("turn") + 1).alias("turn"), c("mine").alias("base"))
    added, removed = diff.diff_delimited(c("mine"), c("base"), " ")
    return t.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.array_join(added, " ").alias("added"), F.array_join(removed, " ").alias("removed"))


@query("""
WITH m AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber % 2 = 1), b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber % 2 = 0),
     x AS (SELECT l_partkey, 'a' AS k, l_suppkey FROM (FROM m EXCEPT FROM b) UNION ALL SELECT l_partkey, 'r', l_suppkey FROM (FROM b EXCEPT FROM m))
SELECT l_partkey, coalesce(string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) FILTER (k = 'a'), '') AS added,
       coalesce(string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) FILTER (k = 'r'), '') AS removed FROM x GROUP BY 1""")
def diff_children_sets(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber")
    out = diff.diff_children(lines.where("l_linenumber % 2 = 1"), lines.where("l_linenumber % 2 = 0"), "l_partkey", "l_suppkey")
    return out.select("l_partkey", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


@query("""
WITH f AS (SELECT p_partkey, field, value FROM (SELECT p_partkey, p_brand, p_type FROM part) UNPIVOT (value FOR field IN (p_brand, p_type)))
SELECT a.p_partkey, a.field, b.value AS before, a.value AS after FROM f a JOIN f b ON b.p_partkey = a.p_partkey - 1 AND a.field = b.field WHERE a.value IS DISTINCT FROM b.value""")
def diff_generic_map(spark: SparkSession, d: str) -> DataFrame:
    """Attributes of each part against those of the part before it."""
    maps = lookup.field_map(table(spark, d, "part"), "p_partkey", ["p_brand", "p_type"])
    as_attributes = maps.select("p_partkey", c("fields").alias("attributes"))
    before = maps.select((c("p_partkey") + 1).alias("p_partkey"), c("fields").alias("attributes"))
    out = diff.diff_section(as_attributes, before, diff.SECTION_RULES["generic"], "p_partkey")
    return out.where("change = 'Modified'").select("p_partkey", "field", "before", "after")


@query("""
WITH f AS (SELECT p_partkey, field, value FROM (SELECT p_partkey, p_name, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END AS p_brand, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END AS p_type FROM part) UNPIVOT (value FOR field IN (p_name, p_brand, p_type))),
     k AS (SELECT p_partkey FROM part WHERE p_partkey - 1 IN (SELECT p_partkey FROM part)),
     ch AS (SELECT * FROM f WHERE p_partkey IN (FROM k)), pa AS (SELECT p_partkey + 1 AS p_partkey, field, value FROM f WHERE p_partkey + 1 IN (FROM k))
SELECT CASE WHEN c.value IS NULL THEN 'inherited' WHEN p.value IS NULL THEN 'new' WHEN p.value = c.value THEN 'inherited' ELSE 'overridden' END AS status, count(*) AS n
FROM ch c FULL JOIN pa p ON c.p_partkey = p.p_partkey AND c.field = p.field GROUP BY 1""")
def inheritance_fields(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_name", F.when(c("p_partkey") % 4 != 0, c("p_brand")).alias("p_brand"), F.when(c("p_partkey") % 3 != 0, c("p_type")).alias("p_type"))
    maps = lookup.field_map(part, "p_partkey", ["p_name", "p_brand", "p_type"])
    up = maps.select((c("p_partkey") + 1).alias("p_partkey"), c("fields").alias("up"))
    return maps.join(up, "p_partkey").select(F.explode(F.map_values(diff.compare_inheritance(c("up"), c("fields")))).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query("""
WITH f AS (SELECT p_partkey, field, value FROM (SELECT p_partkey, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size FROM part) UNPIVOT (value FOR field IN (p_brand, p_type, p_size)))
SELECT a.p_partkey, a.field, a.value FROM f a LEFT JOIN f b ON b.p_partkey = a.p_partkey // 2 AND a.field = b.field WHERE b.value IS NULL OR a.value <> b.value""")
def strip_inherited(spark: SparkSession, d: str) -> DataFrame:
    maps = lookup.field_map(table(spark, d, "part"), "p_partkey", ["p_brand", "p_type", "p_size"]).withColumn("parent", F.floor(c("p_partkey") / 2))
    out = diff.strip_inherited(maps, maps.select("p_partkey", "fields"), "p_partkey", "parent")
    return out.select("p_partkey", F.explode("fields").alias("field", "value"))


@query("""
WITH a AS (SELECT p_partkey AS path, sha256(p_name || CASE WHEN p_partkey % 10 = 0 THEN '2' ELSE '' END) AS h FROM part WHERE p_partkey % 4 <> 0), b AS (SELECT p_partkey AS path, sha256(p_name) AS h FROM part WHERE p_partkey % 3 <> 0)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'create' WHEN a.path IS NULL THEN 'delete' WHEN a.h = b.h THEN 'unchanged' ELSE 'update' END AS action FROM a FULL JOIN b ON a.path = b.path""")
def file_delta(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(c("p_partkey").alias("path"), c("p_name").alias("content"))
    planned = part.where("path % 4 <> 0").withColumn("content", F.when(c("path") % 10 == 0, F.concat("content", F.lit("2"))).otherwise(c("content")))
    return diff.file_delta(planned, part.where("path % 3 <> 0"))


@query("SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_quantity > 5")
def orphan_files(spark: SparkSession, d: str) -> DataFrame:
    kept = table(spark, d, "lineitem").where("l_quantity > 5").select(c("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").distinct().join(kept, "o_orderkey", "left_anti")


# --- staging -------------------------------------------------------------------------------------------------


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    flag = lambda m, r: F.when(c("event_id") % m == r, 1).otherwise(0)
    return table(spark, d, "events").select("event_id", "event_type", flag(5, 0).alias("_is_new"), flag(3, 0).alias("_is_modified"), flag(7, 0).alias("_is_deleted"))


@query("""
SELECT event_type, count(*) AS total, count(*) FILTER (event_id % 7 <> 0) AS live, count(*) FILTER (event_id % 5 = 0) AS new, count(*) FILTER (event_id % 3 = 0 AND event_id % 5 <> 0) AS modified, count(*) FILTER (event_id % 7 = 0) AS deleted FROM events GROUP BY 1""")
def staging_sections(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.section_counts(_flagged(spark, d), ["event_type"], c("_is_new") == 1, c("_is_modified") == 1, c("_is_deleted") == 1)


@query("""
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'deleted' WHEN event_id % 5 = 0 THEN 'new' ELSE 'modified' END AS change FROM events WHERE event_id % 7 = 0 OR event_id % 5 = 0 OR event_id % 3 = 0""")
def staging_changes(spark: SparkSession, d: str) -> DataFrame:
    return staging.changes(_flagged(spark, d)).select("event_id", "change")


@query("""
WITH RECURSIVE ops AS (SELECT user_id AS k, event_id, CASE event_id % 3 WHEN 0 THEN 'delete' WHEN 1 THEN 'upsert' ELSE 'undelete' END AS op, event_type AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
  s0 AS (SELECT DISTINCT user_id AS k, user_id % 2 = 0 AS there, 'base' AS v FROM events),
  run AS (SELECT k, 0::BIGINT AS n, there, 0 AS isnew, 0 AS ismod, 0 AS isdel, v FROM s0
    UNION ALL SELECT r.k, r.n + 1,
      CASE WHEN o.op = 'upsert' THEN true WHEN o.op = 'delete' AND r.there AND r.isnew = 1 THEN false ELSE r.there END,
      CASE WHEN o.op = 'upsert' AND NOT r.there THEN 1 WHEN o.op = 'delete' AND r.there AND r.isnew = 1 THEN 0 ELSE r.isnew END,
      CASE WHEN o.op = 'upsert' AND NOT r.there THEN 0 WHEN o.op = 'upsert' AND r.isnew = 0 THEN 1 WHEN o.op = 'delete' AND r.there AND r.isnew = 1 THEN 0 ELSE r.ismod END,
      CASE WHEN o.op = 'upsert' THEN 0 WHEN o.op = 'delete' AND r.there AND r.isnew = 0 THEN 1 WHEN o.op = 'undelete' AND r.there THEN 0 WHEN o.op = 'delete' THEN 0 ELSE r.isdel END,
      CASE WHEN o.op = 'upsert' THEN o.v ELSE r.v END FROM run r JOIN ops o ON o.k = r.k AND o.n = r.n + 1)
SELECT k, v, isnew AS _is_new, ismod AS _is_modified, isdel AS _is_deleted FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC) AS z FROM run) WHERE z = 1 AND there""")
def staging_apply_batch(spark: SparkSession, d: str) -> DataFrame:
    """Ordered operations from events folded into the state of each user's row."""
    events = table(spark, d, "events")
    rows = staging.with_flags(events.select(c("user_id").alias("k")).distinct().where("k % 2 = 0").withColumn("v", F.lit("base")))
    op = F.when(c("event_id") % 3 == 0, "delete").when(c("event_id") % 3 == 1, "upsert").otherwise("undelete")
    ops = events.select(c("event_id").alias("seq"), op.alias("op"), c("user_id").cast("string").alias("key"), F.create_map(F.lit("v"), c("event_type")).alias("row"))
    return staging.fold(rows, ops, "k")


def _journal(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    boundary = c("event_id") % 50 == 0
    return e.select(c("event_id").alias("id"), F.when(boundary, "mark").alias("label"), F.when(~boundary, c("event_type")).alias("table_name"), c("user_id").cast("string").alias("pk_value"), c("event_id").cast("string").alias("old_row"), (c("event_id") + 1).cast("string").alias("new_row"))


@query("""
SELECT id, CAST(undo_group AS BIGINT) AS undo_group FROM (SELECT event_id AS id, event_id % 50 = 0 AS b, sum(CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS undo_group FROM events) WHERE NOT b""")
def undo_groups(spark: SparkSession, d: str) -> DataFrame:
    return staging.undo_groups(_journal(spark, d)).select("id", "undo_group")


@query("""
SELECT event_type AS table_name, CAST(user_id AS VARCHAR) AS pk_value, CAST(max(event_id) + 1 AS VARCHAR) AS image FROM events WHERE event_id % 50 <> 0 AND event_id > 500 GROUP BY 1, 2""")
def redo_state(spark: SparkSession, d: str) -> DataFrame:
    """The image that redo restores for every row changed after a pointer."""
    return staging.images(_journal(spark, d).where("table_name is not null AND id > 500"), redo=True)


@query("SELECT event_id AS id FROM events ORDER BY event_id DESC LIMIT 500")
def journal_compact(spark: SparkSession, d: str) -> DataFrame:
    return staging.compacted(_journal(spark, d), 500).select("id")


@query("SELECT event_type, count(*) AS rows FROM events WHERE user_id IS NULL OR user_id % 10 <> 3 GROUP BY 1")
def purge_source(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("user_id IS NULL OR user_id % 10 <> 3").groupBy("event_type").agg(F.count("*").alias("rows"))


# --- aggregation ---------------------------------------------------------------------------------------------


@query("""
WITH f AS (SELECT event_type, unnest(json_keys(props)) AS attribute, props FROM events WHERE props IS NOT NULL), v AS (SELECT event_type, attribute, props->>attribute AS value FROM f),
     t AS (SELECT event_type, count(*) AS total FROM events WHERE props IS NOT NULL GROUP BY 1),
     n AS (SELECT event_type, attribute, count(*) AS n, list_sort(list_distinct(list(value) FILTER (value IS NOT NULL AND value <> '')))[1:5] AS ex FROM v GROUP BY 1, 2)
SELECT event_type, attribute, n, round(n / total, 6) AS frequency, array_to_string(ex, '|') AS examples FROM n JOIN t USING (event_type)""")
def infer_schema_stats(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("props is not null").select("event_type", F.from_json("props", "map<string,string>").alias("props"))
    out = aggregate.infer_schema(e, "event_type", "props")
    return out.select("event_type", "attribute", "n", "frequency", F.array_join("examples", "|").alias("examples"))


@query("""
SELECT l_returnflag, l_linestatus, l_tax, count(*) AS n, min(l_orderkey) AS first_key, greatest(0, 6 * count(*) - (6 + 2 * count(*))) AS lines_saved FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) >= 3""")
def anchor_groups(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.anchors(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_tax"], "l_orderkey", 3)


@query("""
SELECT CASE WHEN regexp_matches(upper(substr(w, 1, 1)), '^[A-Z]$') THEN upper(substr(w, 1, 1)) ELSE '#' END AS bucket, count(*) AS n FROM (SELECT coalesce(regexp_extract(text, '^\\S+'), '') AS w FROM documents) GROUP BY 1""".replace("\\\\", "\\"))
def group_alpha(spark: SparkSession, d: str) -> DataFrame:
    first = F.regexp_extract(F.coalesce("text", F.lit("")), r"^\S+", 0)
    return table(spark, d, "documents").groupBy(aggregate.alphabet_bucket(first).alias("bucket")).agg(F.count("*").alias("n"))


@query(r"""
SELECT CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE coalesce(try_cast(nullif(regexp_extract(p_name || ' Lv ' || CAST(p_size % 6 AS VARCHAR), '(?i)\b(?:lv|level)\s*([0-9]+)', 1), '') AS INT), -1) END AS level, count(*) AS n FROM part GROUP BY 1""")
def group_level(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    label = F.concat("p_name", F.lit(" Lv "), (c("p_size") % 6).cast("string"))
    return p.groupBy(aggregate.level_bucket(F.when(c("p_partkey") % 2 == 0, c("p_size").cast("string")), label).alias("level")).agg(F.count("*").alias("n"))


@query("""
SELECT CASE WHEN c_acctbal > 8000 THEN 'ADDED' WHEN c_acctbal < 0 THEN 'NEW' ELSE 'AUTO' END AS tag, count(*) AS n FROM customer GROUP BY 1""")
def group_tag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy(aggregate.tag_bucket(c("c_acctbal") > 8000, c("c_acctbal") < 0).alias("tag")).agg(F.count("*").alias("n"))


@query("""
WITH l AS (SELECT r_name || '/' || n_name AS p, r_name AS r, count(c_custkey) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT p AS folder, CAST(n AS BIGINT) AS total FROM l UNION ALL SELECT r, CAST(sum(n) AS BIGINT) FROM l GROUP BY 1""")
def folder_rollup(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "customer").groupBy(c("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    nation = table(spark, d, "nation").join(table(spark, d, "region"), c("n_regionkey") == c("r_regionkey"))
    return aggregate.roll_up(nation.join(counts, "n_nationkey").select(F.concat_ws("/", "r_name", "n_name").alias("path"), "n"), "path", "n")


@query("""
SELECT section, count(*) AS files FROM (SELECT unnest(list_filter([CASE WHEN regexp_matches(url, '[0-9]') THEN 'numbered' END, CASE WHEN regexp_matches(url, '^https') THEN 'secure' END, CASE WHEN regexp_matches(url, '/[^/]+/[^/]+/') THEN 'deep' END], lambda x: x IS NOT NULL)) AS section FROM pages) GROUP BY 1""")
def pak_section_counts(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.path_sections(table(spark, d, "pages"), "url", {"numbered": "[0-9]", "secure": "^https", "deep": "/[^/]+/[^/]+/"})


@query("""
WITH RECURSIVE up AS (SELECT p_partkey AS node, p_partkey // 2 AS ancestor, 1 AS distance FROM part WHERE p_partkey // 2 > 0 UNION ALL SELECT node, ancestor // 2, distance + 1 FROM up WHERE ancestor // 2 > 0 AND distance < 10)
SELECT node, ancestor, distance FROM up WHERE ancestor IN (SELECT p_partkey FROM part)""")
def hierarchy_tree(spark: SparkSession, d: str) -> DataFrame:
    """All ancestors of each part in a tree of halved keys, ten hops at most."""
    edges = table(spark, d, "part").select("p_partkey", F.when(c("p_partkey") > 1, F.floor(c("p_partkey") / 2)).alias("parent"))
    return hierarchy.with_ancestors(edges, "p_partkey", "parent", 10)


@query("""
SELECT r_name || '_' || b AS id, p AS part, r_regionkey * 10 + k AS link FROM region, (VALUES ('M', 0), ('F', 1)) m(b, k), (VALUES ('visual'), ('preset')) q(p)""")
def cross_presets(spark: SparkSession, d: str) -> DataFrame:
    matrix = spark.createDataFrame([("M", 0), ("F", 1)], "b string, k int")
    out = hierarchy.cross_rows(table(spark, d, "region"), matrix, F.lit("visual"), F.lit("preset"))
    return out.select(F.concat_ws("_", "r_name", "m.b").alias("id"), "part", (c("r_regionkey") * 10 + c("m.k")).alias("link"))


@query("""
SELECT CASE WHEN source IN ('src0', 'src1') THEN 'first' WHEN source = 'src2' THEN 'second' ELSE 'english' END AS target, count(*) AS entries FROM documents GROUP BY 1""")
def loca_split_plan(spark: SparkSession, d: str) -> DataFrame:
    groups = spark.createDataFrame([("src0", "first"), ("src1", "first"), ("src2", "second")], "source string, label string")
    return table(spark, d, "documents").join(groups, "source", "left").groupBy(F.coalesce("label", F.lit("english")).alias("target")).agg(F.count("*").alias("entries"))


@query("""
SELECT n_regionkey, string_agg('new entry "' || n_name || '"' || chr(10) || 'data "Key" "' || n_nationkey || '"', chr(10) ORDER BY n_name) AS content, count(*) AS parts FROM nation GROUP BY 1""")
def export_render(spark: SparkSession, d: str) -> DataFrame:
    block = F.concat(F.lit('new entry "'), c("n_name"), F.lit('"\ndata "Key" "'), c("n_nationkey").cast("string"), F.lit('"'))
    return aggregate.concatenated(table(spark, d, "nation").withColumn("content", block), ["n_regionkey"], "n_name", "content")


# --- lint ------------------------------------------------------------------------------------------------------

_RULES = [
    {"name": "pair", "pattern": "(the|der|que) ([a-z]+)", "message": "article before $2"},
    {"name": "short", "pattern": "^.{1,40}$", "message": "short line"},
    {"name": "comma", "pattern": ",", "message": "no comma", "negate": True},
]
_LINT_SQL = r"""
WITH l AS (SELECT conv_id, turn, line, pos AS line_no FROM (SELECT conv_id, turn, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations) t, LATERAL (SELECT unnest(ls) AS line, CAST(generate_subscripts(ls, 1) AS BIGINT) AS pos)),
     f AS (SELECT *, 'pair' AS rule, 'article before ' || regexp_extract(line, '(the|der|que) ([a-z]+)', 2) AS message FROM l WHERE regexp_matches(line, '(the|der|que) ([a-z]+)')
       UNION ALL SELECT *, 'short', 'short line' FROM l WHERE regexp_matches(line, '^.{1,40}$') UNION ALL SELECT *, 'comma', 'no comma' FROM l WHERE NOT regexp_matches(line, ','))
"""


def _lint_lines(spark: SparkSession, d: str) -> DataFrame:
    conv = table(spark, d, "conversations").withColumn("place", F.struct("conv_id", "turn"))
    return lint.lines(conv, "place", "text")


@query(_LINT_SQL + "SELECT conv_id, turn, line_no, rule, message FROM f")
def lint_lines(spark: SparkSession, d: str) -> DataFrame:
    return lint.apply_line_rules(_lint_lines(spark, d), _RULES).select("place.conv_id", "place.turn", c("line_no").cast("long").alias("line_no"), "rule", "message")


@query(_LINT_SQL + """, o AS (SELECT conv_id, turn, line_no, 'comma' AS rule FROM l WHERE line LIKE '%the%' UNION SELECT conv_id, turn, line_no + 1, 'comma' FROM l WHERE line LIKE '%the%')
SELECT rule, count(*) AS n FROM f ANTI JOIN o USING (conv_id, turn, line_no, rule) GROUP BY 1""")
def lint_suppressed(spark: SparkSession, d: str) -> DataFrame:
    """Findings left when lines with "the" disable the comma rule for themselves and the next line."""
    rows = _lint_lines(spark, d)
    found = lint.apply_line_rules(rows, _RULES)
    marked = rows.withColumn("line", F.when(c("line").contains("the"), "lint-disable: comma").otherwise(""))
    return lint.suppressed(found, marked, "place").groupBy("rule").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (1, 2, 4) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def goal_parent_check(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "customer").where("c_acctbal > 0")
    return integrity.unknown_references(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", names, "c_custkey", [1, 2, 4]).select("o_orderkey", "o_custkey")


@query("""
SELECT s_suppkey, c_custkey FROM (SELECT s_suppkey, c_custkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY c_custkey) AS k FROM supplier LEFT JOIN customer ON (s_suppkey = c_custkey AND c_custkey % 3 = 0) OR (s_nationkey = c_nationkey AND c_custkey % 50 = 1 AND c_custkey % 3 = 0)) WHERE k = 1""")
def deps_first_match(spark: SparkSession, d: str) -> DataFrame:
    """The first customer equal by key or by nation; suppliers without one stay."""
    known = table(spark, d, "customer").where("c_custkey % 3 = 0").select("c_custkey", F.when(c("c_custkey") % 50 == 1, c("c_nationkey")).alias("c_nation"))
    left = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", c("s_suppkey").alias("s_own"))
    return lookup.first_match_or(left, known, [("s_own", "c_custkey"), ("s_nationkey", "c_nation")], "s_suppkey", "c_custkey").select("s_suppkey", "c_custkey")


# --- scalars ---------------------------------------------------------------------------------------------------


@query(r"""
WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'True' WHEN 1 THEN '+' || event_id WHEN 2 THEN event_id || '.5' WHEN 3 THEN ' ' || event_id WHEN 4 THEN 'NaN' ELSE '' END AS t FROM events)
SELECT event_id, CAST(CASE WHEN lower(t) = 'true' OR t = '1' THEN 1 ELSE 0 END AS BIGINT) AS b, CASE WHEN regexp_matches(t, '^[+-]?[0-9]+$') THEN CAST(replace(t, '+', '') AS BIGINT) END AS i,
  CASE WHEN NOT regexp_matches(t, '^[+-]?[0-9]+$') THEN t END AS i_raw, CASE WHEN regexp_matches(t, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$') THEN CAST(replace(t, '+', '') AS DOUBLE) END AS f, nullif(t, '') AS k FROM t""")
def coerce_types(spark: SparkSession, d: str) -> DataFrame:
    m, i = c("event_id") % 6, c("event_id").cast("string")
    t = F.when(m == 0, "True").when(m == 1, F.concat(F.lit("+"), i)).when(m == 2, F.concat(i, F.lit(".5"))).when(m == 3, F.concat(F.lit(" "), i)).when(m == 4, "NaN").otherwise("")
    rows = table(spark, d, "events").select("event_id", t.alias("t"))
    whole, raw = values.coerce(c("t"), "int64")
    return rows.select("event_id", values.coerce(c("t"), "bool")[0].alias("b"), whole.alias("i"), raw.alias("i_raw"), values.coerce(c("t"), "double")[0].alias("f"), values.null_key(c("t")).alias("k"))


@query(r"""
SELECT p_partkey, regexp_replace(p_name, '[^A-Za-z0-9_]', '_', 'g') AS id, upper(substr(p_type, 1, 1)) || substr(p_type, 2) AS cap, CASE WHEN length(p_brand) > 1 THEN regexp_replace(p_brand, 's$', '') ELSE p_brand END AS single,
  '#' || lpad(to_hex(p_partkey % 16777216), 6, '0') || 'FF' AS color, length(list_filter(list_transform(string_split(p_name, ' '), lambda x: trim(x)), lambda x: x <> '')) AS words FROM part""")
def scalar_strings(spark: SparkSession, d: str) -> DataFrame:
    argb = F.concat(F.lit("#FF"), F.lpad(F.hex(c("p_partkey") % 16777216), 6, "0"))
    return table(spark, d, "part").select(
        "p_partkey", text.sanitize_id(c("p_name")).alias("id"), text.capitalize_first(c("p_type")).alias("cap"), text.singularize(c("p_brand")).alias("single"),
        text.bgra_to_rgba(argb).alias("color"), F.size(text.split_delimited(c("p_name"), " ")).cast("long").alias("words"),
    )


@query("""
SELECT l_orderkey, l_linenumber, CAST((l_linenumber::BIGINT << 55) | ((l_partkey % 200)::BIGINT << 47) | ((l_suppkey % 60000)::BIGINT << 31) | l_orderkey AS BIGINT) AS packed,
  l_linenumber || '.' || (l_partkey % 200) || '.' || (l_suppkey % 60000) || '.' || l_orderkey AS dotted FROM lineitem""")
def version_codec(spark: SparkSession, d: str) -> DataFrame:
    """Dotted versions packed into 64 bits and unpacked again."""
    dotted = F.concat_ws(".", c("l_linenumber").cast("string"), (c("l_partkey") % 200).cast("string"), (c("l_suppkey") % 60000).cast("string"), c("l_orderkey").cast("string"))
    packed = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", values.version_number(dotted).alias("packed"))
    return packed.withColumn("dotted", values.version_text(c("packed")))


@query("""
SELECT p_partkey, CAST(pos - 1 AS BIGINT) AS pos, name, params FROM (SELECT p_partkey, unnest([1, 2]) AS pos, unnest(['SelectSpells', 'AddBoost']) AS name, unnest([p_brand || '|' || p_size, p_type]) AS params FROM part)""")
def selector_parse(spark: SparkSession, d: str) -> DataFrame:
    """Selector texts built from parts and parsed back."""
    built = F.concat_ws(";", text.selector_text(F.lit("SelectSpells"), F.array(c("p_brand"), c("p_size").cast("string"))), text.selector_text(F.lit("AddBoost"), F.array(c("p_type"))))
    rows = table(spark, d, "part").select("p_partkey", F.posexplode(text.parse_selectors(built)).alias("pos", "s"))
    return rows.select("p_partkey", c("pos").cast("long").alias("pos"), c("s.name").alias("name"), F.array_join("s.params", "|").alias("params"))


@query("""
SELECT o_orderkey, coalesce(nullif(a.t, ''), nullif(b.t, ''), CAST(o_custkey AS VARCHAR)) AS resolved FROM orders
LEFT JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS t FROM customer WHERE c_custkey % 2 = 0) a ON o_custkey = a.k LEFT JOIN (SELECT c_custkey AS k, c_mktsegment AS t FROM customer WHERE c_custkey % 3 = 0) b ON o_custkey = b.k""")
def handle_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Texts of handles from two tables in order; empty texts count as missing."""
    cust = table(spark, d, "customer").withColumn("handle", c("c_custkey").cast("string"))
    own = cust.where("c_custkey % 2 = 0").select("handle", F.when(c("c_custkey") % 4 == 0, "").otherwise(c("c_name")).alias("text"))
    other = cust.where("c_custkey % 3 = 0").select("handle", c("c_mktsegment").alias("text"))
    orders = table(spark, d, "orders").select("o_orderkey", F.concat(c("o_custkey").cast("string"), F.lit("|")).alias("raw"), c("o_custkey").cast("string").alias("plain"))
    out = lookup.resolve_handle(orders, "raw", [own, other])
    return out.select("o_orderkey", F.when(c("resolved") == c("raw"), c("plain")).otherwise(c("resolved")).alias("resolved"))


_STARTS = "CASE WHEN {0} = 1 OR regexp_matches(substr(p_name, {0} - 1, 1), '[ _-]') OR (substr(p_name, {0} - 1, 1) = lower(substr(p_name, {0} - 1, 1)) AND substr(p_name, {0}, 1) = upper(substr(p_name, {0}, 1))) THEN 10 ELSE 0 END"


@query(f"""
WITH a AS (SELECT p_partkey, p_name, lower(p_name) AS low, instr(lower(p_name), 'a') AS i FROM part), b AS (SELECT *, CASE WHEN i > 0 AND instr(substr(low, i + 1), 'r') > 0 THEN i + instr(substr(low, i + 1), 'r') END AS j FROM a)
SELECT p_partkey, p_name, CAST(2 + CASE WHEN j = i + 1 THEN 5 ELSE 0 END + {_STARTS.format('i')} + {_STARTS.format('j')} + CASE WHEN starts_with(low, 'ar') THEN 20 ELSE 0 END AS INT) AS score FROM b WHERE j IS NOT NULL""")
def fuzzy_rank(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose name holds the query's letters in order, best first."""
    scored = table(spark, d, "part").select("p_partkey", "p_name", fuzzy.fuzzy_score(c("p_name"), "ar").alias("score"))
    return scored.where("score is not null").orderBy(c("score").desc(), "p_partkey")


@query("""
WITH l AS (SELECT conv_id, turn, role, text, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS header FROM conversations)
SELECT conv_id, header, count(*) AS replies FROM l WHERE role <> 'user' AND header IS NOT NULL GROUP BY 1, 2""")
def stats_text_parse(spark: SparkSession, d: str) -> DataFrame:
    """Header carried down over lines: the user turn that each other turn stands under."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, d, "conversations").withColumn("header", F.last(F.when(c("role") == "user", c("turn")), ignorenulls=True).over(w))
    return rows.where("role <> 'user' AND header is not null").groupBy("conv_id", "header").agg(F.count("*").alias("replies"))


@query("""
SELECT n_regionkey, n_name AS list_key, i AS index, 'v' || i AS value FROM nation, (SELECT unnest([0, 1, 2]) AS i)""")
def stats_value_lists(spark: SparkSession, d: str) -> DataFrame:
    """Value-list texts rendered from nations, one a region, and read back by the grammar."""
    body = F.concat(F.lit('valuelist "'), c("n_name"), F.lit('"\nvalue "v0" : 0\nvalue "v1" : 1\nvalue "v2"\n'))
    docs = aggregate.concatenated(table(spark, d, "nation").withColumn("content", body), ["n_regionkey"], "n_name", "content")
    out = stats_text.value_lists(docs.select(c("n_regionkey").cast("string").alias("path"), c("content").alias("text")))
    return out.select(c("path").cast("int").alias("n_regionkey"), "list_key", "index", "value")


# --- further operators -----------------------------------------------------------------------------------------


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM orders WHERE NOT (o_orderkey % 5 = 0 AND o_orderkey % 2 = 0)""")
def overlay_tombstones(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "orders").select("o_orderkey", c("o_orderstatus").alias("status"))
    over = base.where("o_orderkey % 5 = 0").withColumns({"status": F.lit("X"), "gone": c("o_orderkey") % 2 == 0})
    return precedence.overlay_tombstones(base, over, ["o_orderkey"], "gone")


@query("""
SELECT n_nationkey AS id, CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier) THEN 'supplier' WHEN n_nationkey IN (SELECT c_nationkey FROM customer) THEN 'customer' ELSE 'nation' END AS winner FROM nation""")
def last_wins_union(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "nation").select(c("n_nationkey").alias("id"))
    a = table(spark, d, "customer").select(c("c_nationkey").alias("id")).join(own, "id", "left_semi")
    b = table(spark, d, "supplier").select(c("s_nationkey").alias("id")).join(own, "id", "left_semi")
    return precedence.last_wins(precedence.ranked_union([("nation", own), ("customer", a), ("supplier", b)], tag="winner"), ["id"], ["_rank"]).select("id", "winner")


@query("""
SELECT o_orderpriority AS section, count(*) AS entries, count(*) FILTER (o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)) AS lost,
  CAST(round(100.0 * count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)) / count(*)) AS INT) AS fidelity FROM orders GROUP BY 1""")
def round_trip_fidelity(spark: SparkSession, d: str) -> DataFrame:
    """Orders by priority, and those that come back with a large line."""
    own = table(spark, d, "orders").select(c("o_orderpriority").alias("section"), c("o_orderkey").alias("entry"))
    back = table(spark, d, "lineitem").where("l_quantity > 45").select(c("l_orderkey").alias("entry")).distinct().join(own, "entry")
    return diff.round_trip(own, back, "section", "entry")


@query("""
SELECT event_type AS module, count(*) AS rows, count(DISTINCT user_id) AS files, round(count(*) / count(DISTINCT user_id), 2) AS average FROM events GROUP BY 1""")
def source_summary(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.source_summary(table(spark, d, "events").withColumnRenamed("event_type", "module"), "module", "user_id")


@query("""
WITH u AS (SELECT 0 AS r, 'package' AS source, CAST(s_suppkey AS VARCHAR) AS id, s_name AS label FROM supplier WHERE s_suppkey % 2 = 0
           UNION ALL SELECT 1, 'baseline', CAST(s_suppkey AS VARCHAR), 'old ' || s_name FROM supplier UNION ALL SELECT 2, 'other0', CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 9 = 0 THEN '' ELSE c_name END FROM customer)
SELECT id, coalesce(nullif(label, ''), 'Unnamed') AS label, source FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r) AS k FROM u) WHERE k = 1""")
def section_options(spark: SparkSession, d: str) -> DataFrame:
    sup = table(spark, d, "supplier").select(c("s_suppkey").cast("string").alias("id"), c("s_name").alias("label"))
    cust = table(spark, d, "customer").select(c("c_custkey").cast("string").alias("id"), F.when(c("c_custkey") % 9 == 0, "").otherwise(c("c_name")).alias("label"))
    return options.section_options(sup.where("CAST(id AS int) % 2 = 0"), sup.withColumn("label", F.concat(F.lit("old "), "label")), [cust])


@query("""
SELECT n_name AS name, 'vanilla' AS layer FROM nation WHERE n_nationkey % 4 <> 0 UNION ALL SELECT lower(n_name), 'group' FROM nation WHERE n_nationkey % 4 = 0 AND n_nationkey % 3 <> 0""")
def cost_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Names overlaid without regard to case; a deleted row of a later layer removes its name."""
    base = table(spark, d, "nation").select(c("n_name").alias("name"), "n_nationkey")
    over = base.where("n_nationkey % 4 = 0").select(F.lower("name").alias("name"), "n_nationkey", F.when(c("n_nationkey") % 3 == 0, 1).otherwise(0).alias("_is_deleted"))
    return options.cost_options(base, over.where("false"), over).select("name", "layer")


@query("""
WITH f AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Public/M/Lists/L' || p_partkey || '.SpellLists.lsx' WHEN 1 THEN 'Public/M/RootTemplates/' || p_partkey || '.lsf' WHEN 2 THEN 'a/' || p_partkey || '.lsf.lsf' ELSE 'a/MultiEffectInfos/x/' || p_partkey || '.lsx' END AS path FROM part)
SELECT path, CASE p_partkey % 4 WHEN 0 THEN 'Public/M/Lists/SpellLists.lsx' WHEN 1 THEN 'Public/M/RootTemplates/_merged.lsf' WHEN 2 THEN 'a/' || p_partkey || '.lsf' ELSE 'a/MultiEffectInfos/' || p_partkey || '.lsx' END AS target,
  CASE p_partkey % 4 WHEN 0 THEN 'regions' WHEN 1 THEN 'templates' WHEN 2 THEN 'extension' ELSE 'effects' END AS rule FROM f""")
def packaging_rewrites(spark: SparkSession, d: str) -> DataFrame:
    k, m = c("p_partkey").cast("string"), c("p_partkey") % 4
    path = F.when(m == 0, F.concat(F.lit("Public/M/Lists/L"), k, F.lit(".SpellLists.lsx"))).when(m == 1, F.concat(F.lit("Public/M/RootTemplates/"), k, F.lit(".lsf"))).when(m == 2, F.concat(F.lit("a/"), k, F.lit(".lsf.lsf"))).otherwise(F.concat(F.lit("a/MultiEffectInfos/x/"), k, F.lit(".lsx")))
    return packaging.rewrites(table(spark, d, "part").select(path.alias("path")))


@query("""
WITH k AS (SELECT CAST(o_custkey AS VARCHAR) AS key, o_orderstatus AS section FROM orders), g AS (SELECT key, count(*) AS n, count(DISTINCT section) AS s FROM k GROUP BY 1)
SELECT 'not a guid' AS problem, count(*) AS n FROM k UNION ALL SELECT 'repeated in its section', count(*) FROM g WHERE n > s HAVING count(*) > 0 UNION ALL SELECT 'also in another section', count(*) FROM g WHERE s > 1 HAVING count(*) > 0""")
def entry_validation(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "orders").select(c("o_custkey").cast("string").alias("k"), "o_orderstatus")
    return validate.entries(own, "k", "o_orderstatus").groupBy("problem").agg(F.count("*").alias("n"))


@query("""
WITH h AS (SELECT r_name AS node, lower(r_name) LIKE '%am%' AS m, r_name AS r FROM region UNION ALL SELECT r_name || '/' || n_name, lower(n_name) LIKE '%am%', r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT node, m AS matched FROM h WHERE m OR (node = r AND r IN (SELECT r FROM h WHERE m)) OR (node <> r AND r IN (SELECT r FROM h WHERE node = r AND m) AND r NOT IN (SELECT r FROM h WHERE node <> r AND m))""")
def tree_search(spark: SparkSession, d: str) -> DataFrame:
    """Regions and nations as a tree: names with "am", their ancestors, and all below a matching folder without a matching child."""
    both = table(spark, d, "nation").join(table(spark, d, "region"), c("n_regionkey") == c("r_regionkey"))
    return lookup.search_tree(both.select(F.concat_ws("/", "r_name", "n_name").alias("path")), "am")


@query("""
SELECT p_brand AS path, p_name || ' ' || p_partkey AS name, 'Part' AS type, p_type AS kind, CAST(p_size AS VARCHAR) AS size FROM part""")
def stats_entries_parse(spark: SparkSession, d: str) -> DataFrame:
    """Stats texts, one a brand, rendered from parts and read back."""
    block = F.concat(F.lit('new entry "'), c("p_name"), F.lit(" "), c("p_partkey").cast("string"), F.lit('"\ntype "Part"\ndata "Kind" "'), c("p_type"), F.lit('"\ndata "Size" "0"\ndata "Size" "'), c("p_size").cast("string"), F.lit('"\n'))
    files = aggregate.concatenated(table(spark, d, "part").withColumn("text", block), ["p_brand"], "p_partkey", "text")
    out = stats_text.entries(files.select(c("p_brand").alias("path"), "text"))
    return out.select("path", "name", "type", F.element_at("data", "Kind").alias("kind"), F.element_at("data", "Size").alias("size"))


@query("""
SELECT 'h' || doc_id AS contentuid, CAST(CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 1 END AS BIGINT) AS version, source || ' <' || lang || '> & "x"' AS text FROM documents WHERE doc_id IS NOT NULL""")
def loca_xml_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Localisation lists, one a source, rendered as XML and read back."""
    rows = table(spark, d, "documents").where("doc_id is not null").select("source", F.concat(F.lit("h"), c("doc_id").cast("string")).alias("contentuid"), F.when(c("doc_id") % 2 == 0, 3).alias("version"), F.concat(c("source"), F.lit(" <"), c("lang"), F.lit('> & "x"')).alias("text"))
    line = F.concat(F.lit('<content contentuid="'), c("contentuid"), F.lit('" version="'), F.coalesce("version", F.lit(1)).cast("string"), F.lit('">'), text.escape_xml(c("text")), F.lit("</content>"))
    files = aggregate.concatenated(rows.withColumn("line", line), ["source"], "contentuid", "line")
    return loca.read_xml(files.select(c("source").alias("path"), c("line").alias("text"))).select("contentuid", "version", "text")


@query("""
SELECT l_orderkey, l_linenumber, CAST(pos - 1 AS BIGINT) AS pos, res AS resource, qty AS quantity, lvl AS level FROM (
  SELECT l_orderkey, l_linenumber, unnest([1, 2]) AS pos, unnest([l_returnflag, l_linestatus]) AS res, unnest([CAST(l_partkey AS VARCHAR), '']) AS qty, unnest(['1:' || l_linenumber, '']) AS lvl FROM lineitem)""")
def costs_parse(spark: SparkSession, d: str) -> DataFrame:
    """Cost texts built from every line and parsed; a level keeps its inner colon."""
    return _parsed_costs(table(spark, d, "lineitem"))


def _parsed_costs(lines: DataFrame) -> DataFrame:
    built = F.concat(c("l_returnflag"), F.lit(":"), c("l_partkey").cast("string"), F.lit(":1:"), c("l_linenumber").cast("string"), F.lit("; ;"), c("l_linestatus"))
    rows = lines.select("l_orderkey", "l_linenumber", F.posexplode(values.parse_costs(built)).alias("pos", "x"))
    return rows.select("l_orderkey", "l_linenumber", c("pos").cast("long").alias("pos"), "x.resource", "x.quantity", "x.level")


@query("""
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN event_id % 4 = 0 THEN 'guid' WHEN event_id % 4 = 1 THEN 'bool' WHEN event_id % 4 = 2 THEN 'int32' ELSE 'FixedString' END AS kind FROM events) GROUP BY 1""")
def inferred_types(spark: SparkSession, d: str) -> DataFrame:
    m = c("event_id") % 4
    key = F.when(m == 0, "UUID").otherwise("Field")
    value = F.when(m == 1, "False").when(m == 2, (-c("event_id")).cast("string")).otherwise(F.concat(c("event_type"), F.lit("_x")))
    return table(spark, d, "events").groupBy(values.infer_type(key, value).alias("kind")).agg(F.count("*").alias("n"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 21.0::DOUBLE ELSE 1.0::DOUBLE END AS ratio FROM part""")
def contrast_ratios(spark: SparkSession, d: str) -> DataFrame:
    """White on black for even keys, equal colours for odd ones."""
    fg = F.when(c("p_partkey") % 2 == 0, "#ffffff").otherwise("#123456")
    bg = F.when(c("p_partkey") % 2 == 0, "#000000").otherwise("#123456")
    return table(spark, d, "part").select("p_partkey", F.round(text.contrast_ratio(fg, bg), 4).alias("ratio"))


@query("""
SELECT r_name AS region, n_name AS uuid, CAST(n_nationkey AS VARCHAR) AS key FROM nation JOIN region ON n_regionkey = r_regionkey""")
def tree_entries(spark: SparkSession, d: str) -> DataFrame:
    """Tree documents, one a region, built from nations and flattened to entries."""
    node = F.concat(F.lit('<node id="N"><attribute id="UUID" type="guid" value="'), text.escape_xml(c("n_name")), F.lit('"/><attribute id="Key" type="int32" value="'), c("n_nationkey").cast("string"), F.lit('"/></node>'))
    both = table(spark, d, "nation").join(table(spark, d, "region"), c("n_regionkey") == c("r_regionkey")).withColumn("x", node)
    docs = aggregate.concatenated(both, ["r_name"], "n_name", "x", "")
    files = docs.select(c("r_name").alias("path"), F.concat(F.lit('<save><region id="'), c("r_name"), F.lit('"><node id="root"><children>'), c("x"), F.lit("</children></node></region></save>")).alias("text"))
    return trees.entries(trees.read(files)).select("region", "uuid", F.element_at("attributes", "Key")["value"].alias("key"))


@query("""
SELECT n_name AS path, 'N' AS node_id, CAST(n_nationkey AS VARCHAR) AS key FROM nation""")
def binary_tree_read(spark: SparkSession, d: str) -> DataFrame:
    """Binary documents, one a nation, written and read back."""
    make = F.udf(lambda n, k: bytearray(binary_tree.write([("R", [{"id": "N", "attributes": {"UUID": ("FixedString", n), "Key": ("int32", str(k))}}])])), "binary")
    files = table(spark, d, "nation").select(c("n_name").alias("path"), make("n_name", "n_nationkey").alias("content"))
    return binary_tree.read(files).where("node_id = 'N'").select("path", "node_id", F.element_at("attrs", "Key")["value"].alias("key"))
