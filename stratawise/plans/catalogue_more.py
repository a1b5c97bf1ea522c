"""Further registered queries, each with its SQL; they are added to the catalogue's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratawise.functions import labels, text, values
from stratawise.operators import aggregate, config, diff, hierarchy, integrity, lint, lookup, options, packaging, precedence, staging, validate
from stratawise.plans import references
from stratawise.plans.catalogue import ORACLES, QUERIES, _flagged, _journal, query
from stratawise.session import table
from stratawise.sources import export, files, loca, manifest, stats_text, trees

c = F.col


# --- section comparisons: one query a section ------------------------------------------------------------------

#: What each section's query compares: delimited fields, scalars and flags, child groups.
_COMPARED = {
    "progression": ([("Boosts", ";"), ("PassivesAdded", ";"), ("PassivesRemoved", ";"), ("Selectors", ";")], ["AllowImprovement", "IsMulticlass"], ["SubClasses"]),
    "list": ([("Abilities", ";"), ("Equipment", ";"), ("Passives", ","), ("Skills", ","), ("Spells", ";")], [], []),
    "race": ([], [], ["EyeColors", "SkinColors", "HairColors", "TattooColors", "MakeupColors", "LipsMakeupColors", "HairGrayingColors", "HairHighlightColors", "HornColors", "HornTipColors", "Gods", "ExcludedGods", "Visuals", "Tags"]),
    "feat": ([("PassivesAdded", ";"), ("Selectors", ";")], ["AllowImprovement", "CanBeTakenMultipleTimes"], []),
    "origin": ([("Passives", ";")], ["BodyShape", "BodyType", "VoiceTableUUID", "AppearanceLocked"], ["AppearanceTags", "ReallyTags"]),
    "background": ([("Passives", ";")], ["Hidden"], ["Tags"]),
    "action_resource": ([], ["Name", "MaxLevel", "ReplenishType", "DiceType", "MaxValue", "IsHidden", "IsSpellResource", "PartyActionResource", "ShowOnActionResourcePanel", "UpdatesSpellPowerLevel"], []),
    "action_resource_group": ([("ActionResourceDefinitions", ";")], [], []),
    "class_description": (
        [],
        ["BaseHp", "HpPerLevel", "SpellCastingAbility", "PrimaryAbility", "ClassHotbarColumns", "CommonHotbarColumns", "ItemsHotbarColumns", "LearningStrategy", "MulticlassSpellcasterModifier", "AnimationSetPriority",
         "CharacterCreationPose", "ClassEquipment", "SoundClassType", "ProgressionTableUUID", "SpellList", "ParentGuid", "Name", "CanLearnSpells", "MustPrepareSpells", "HasGod", "IsDefaultForUseSpellAction"],
        ["Tags"],
    ),
}


def _section_sql(delimited: list, scalars: list, children: list) -> str:
    out = ["SELECT p_partkey, 'New' AS change, '' AS field, '' AS added, '' AS removed, '' AS before, '' AS after FROM part WHERE p_partkey % 11 = 0"]
    k = "FROM part WHERE p_partkey % 11 <> 0 AND"
    out += [f"SELECT p_partkey, 'Modified', '{f}', 'a' || p_partkey % 3, 'a' || (p_partkey + {i + 1}) % 3, '', '' {k} (p_partkey + {i + 1}) % 3 <> p_partkey % 3" for i, (f, _) in enumerate(delimited)]
    out += [f"SELECT p_partkey, 'Modified', '{f}', '', '', '{f}:' || p_size || 'x', '{f}:' || p_size {k} (p_partkey + {i}) % 3 = 0 AND (p_partkey + {i}) % 5 <> 0" for i, f in enumerate(scalars)]
    out += [f"SELECT p_partkey, 'Modified', '{f}', 'g' || p_partkey % 2, 'g' || (p_partkey + {i + 1}) % 2, '', '' {k} (p_partkey + {i + 1}) % 2 <> p_partkey % 2" for i, f in enumerate(children)]
    return " UNION ALL ".join(out)


def _section_diff(name: str, delimited: list, scalars: list, children: list):
    def run(spark: SparkSession, d: str) -> DataFrame:
        k, size = c("p_partkey"), c("p_size").cast("string")

        def side(mine: bool) -> DataFrame:
            pairs = []
            for i, (f, by) in enumerate(delimited):
                own = k % 3 if mine else (k + i + 1) % 3
                pairs += [F.lit(f), F.concat(F.lit("a"), own.cast("string"), F.lit(f"{by} c{by} "))]
            for i, f in enumerate(scalars):
                value = F.concat(F.lit(f"{f}:"), size)
                pairs += [F.lit(f), F.when((k + i) % 5 != 0, value) if mine else F.when((k + i) % 3 == 0, F.concat(value, F.lit("x"))).otherwise(value)]
            groups = [x for i, g in enumerate(children) for x in (F.lit(g), F.array(F.concat(F.lit("g"), ((k if mine else k + i + 1) % 2).cast("string")), F.lit("same")))]
            attributes = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
            return table(spark, d, "part").select("p_partkey", attributes.alias("attributes"), (F.create_map(*groups) if groups else F.create_map().cast("map<string,array<string>>")).alias("children"))

        out = diff.diff_section(side(True), side(False).where("p_partkey % 11 <> 0"), diff.SECTION_RULES[name], "p_partkey")
        text_of = lambda x: F.coalesce(F.array_join(x, ","), F.lit(""))
        return out.select("p_partkey", "change", F.coalesce("field", F.lit("")).alias("field"), text_of("added").alias("added"), text_of("removed").alias("removed"), F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"))

    run.__doc__ = f"Every part as an entry of the section {name}, compared with a baseline that lacks some and differs in others."
    return run


for _name, _parts in _COMPARED.items():
    QUERIES[f"diff_{_name}"] = _section_diff(_name, *_parts)
    ORACLES[f"diff_{_name}"] = _section_sql(*_parts)


# --- references -------------------------------------------------------------------------------------------------


@query("""
WITH p AS (SELECT p_partkey, p_partkey % 12 AS m FROM part)
SELECT p_partkey, CASE m WHEN 0 THEN 'Races__Race.UUID' WHEN 1 THEN 'Races__Race.UUID' WHEN 2 THEN 'SpellLists.UUID' WHEN 3 THEN 'unresolved' WHEN 4 THEN 'unresolved' WHEN 5 THEN NULL WHEN 6 THEN 'self.UUID'
  WHEN 7 THEN NULL WHEN 8 THEN 'Tags__Tags.UUID' WHEN 9 THEN 'MultiEffectInfos__MultiEffectInfos.UUID' WHEN 10 THEN 'FactionContainer.UUID' ELSE NULL END AS target FROM p""")
def fk_rules(spark: SparkSession, d: str) -> DataFrame:
    """Columns made from parts, and the table and key that the rules name for them."""
    rows = [
        ("T", "N", "RaceUUID", "guid"), ("T", "N", "raceuuid", "FixedString"), ("T", "N", "SpellList", "guid"), ("T", "N", "FooUUID", "guid"), ("T", "N", "BarTemplate", "guid"), ("T", "N", "BarTemplate", "FixedString"),
        ("T", "N", "ParentGuid", "guid"), ("T", "N", "RaceUUID", "int32"), ("T", "Tags", "Object", "guid"), ("DeathEffects", "N", "Cold", "guid"), ("FactionManager", "N", "Target", "guid"), ("T", "N", "UUID", "guid"),
    ]
    pick = F.element_at(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("t", "n", "c", "d"), r, strict=True)]) for r in rows]), (c("p_partkey") % 12 + 1).cast("int"))
    own = table(spark, d, "part").select("p_partkey", pick.alias("x"))
    return own.select("p_partkey", references.target_column(c("x.t"), c("x.n"), c("x.c"), c("x.d")).alias("target"))


@query("""
SELECT 'duplicate key' AS problem, count(*) AS n FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0
UNION ALL SELECT 'null o_custkey', count(*) FROM orders WHERE o_custkey IS NULL HAVING count(*) > 0""")
def integrity_check(spark: SparkSession, d: str) -> DataFrame:
    return integrity.integrity_check(table(spark, d, "orders"), ["o_custkey"])


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def uuid_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    return integrity.duplicates(table(spark, d, "orders"), ["o_custkey"])


@query(r"""
WITH r AS (SELECT p_partkey, 'mod' || p_partkey % 40 || '.lua' AS target FROM part UNION ALL SELECT p_partkey, 'lib/' || p_partkey % 7 FROM part)
SELECT p_partkey, target FROM r WHERE target NOT IN (SELECT 'mod' || p_size || '.lua' FROM part UNION ALL SELECT 'lib/1')""")
def unresolved_requires(spark: SparkSession, d: str) -> DataFrame:
    """Paths that scripts require and no known script has."""
    k = c("p_partkey")
    code = F.concat(F.lit('Ext.Require("mod'), (k % 40).cast("string"), F.lit('.lua")\nlocal x = require("lib/'), (k % 7).cast("string"), F.lit('")'))
    scripts = table(spark, d, "part").select("p_partkey", code.alias("text"))
    known = table(spark, d, "part").select(F.concat(F.lit("mod"), c("p_size").cast("string"), F.lit(".lua")).alias("key")).union(spark.createDataFrame([("lib/1",)], "key string"))
    return lookup.unresolved_requires(scripts, "p_partkey", known)


# --- lookups over whole tables ----------------------------------------------------------------------------------


@query("SELECT 'region' AS table_name, EXISTS (SELECT 1 FROM region) AS has_data UNION ALL SELECT 'none', false UNION ALL SELECT 'events', EXISTS (SELECT 1 FROM events) UNION ALL SELECT 'part', EXISTS (SELECT 1 FROM part)")
def has_data(spark: SparkSession, d: str) -> DataFrame:
    frames = [(t, table(spark, d, t)) for t in ("region", "events", "part")]
    return lookup.existence([*frames, ("none", table(spark, d, "region").where("false"))])


@query("SELECT event_type AS type, CAST(event_id AS VARCHAR) AS name FROM events UNION ALL SELECT 'Part', p_name || p_partkey FROM part")
def stat_entries(spark: SparkSession, d: str) -> DataFrame:
    """Names of all tables of stats, by name."""
    kinds = [r[0] for r in table(spark, d, "events").select("event_type").distinct().orderBy("event_type").collect()]
    e = table(spark, d, "events").withColumn("_entry_name", c("event_id").cast("string"))
    own = [(k, e.where(c("event_type").eqNullSafe(F.lit(k)))) for k in kinds]
    return lookup.stat_entries([*own, ("Part", table(spark, d, "part").withColumn("_entry_name", F.concat("p_name", c("p_partkey").cast("string"))))])


@query("SELECT doc_id, lang AS handle, coalesce(text, '') AS text FROM documents ORDER BY handle")
def localization_map(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", c("lang").alias("contentuid"), "text")
    return docs.select("doc_id").join(loca.map_of(docs.select(c("doc_id").cast("string").alias("contentuid"), "text")), c("doc_id").cast("string") == c("handle")).join(docs.select("doc_id", c("contentuid").alias("lang")), "doc_id").select("doc_id", c("lang").alias("handle"), "text")


@query("""
SELECT p_partkey, key AS field, value FROM (SELECT p_partkey, unnest(['p_brand', 'p_name', 'p_size']) AS key, unnest([coalesce(p_brand, ''), coalesce(p_name, ''), coalesce(CAST(p_size AS VARCHAR), '')]) AS value FROM part)""")
def raw_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows as attribute maps without internal columns."""
    own = table(spark, d, "part").select(c("p_partkey").alias("_key"), "p_brand", "p_name", "p_size")
    return lookup.raw_rows(own, "_key").select(c("_key").alias("p_partkey"), F.explode("attributes").alias("field", "value"))


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS uuid, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 1 THEN c_name || ' Lv' || c_nationkey ELSE c_name END AS display,
  CASE WHEN c_custkey % 2 = 0 THEN '#' || lpad(CAST(c_nationkey AS VARCHAR), 6, '0') || 'FF' END AS color, CASE WHEN c_custkey % 5 <> 0 THEN 'p' || c_nationkey END AS parent_id FROM customer""")
def vanilla_entries(spark: SparkSession, d: str) -> DataFrame:
    k = c("c_custkey")
    own = table(spark, d, "customer").select(
        "c_custkey", F.when(k % 3 == 0, F.concat("c_mktsegment", F.lit(";2"))).otherwise("").alias("display"), "c_name", F.when(k % 3 == 1, c("c_nationkey")).alias("level"), F.lit("note").alias("comment"),
        F.when(k % 2 == 0, F.concat(F.lit("#FF"), F.lpad(c("c_nationkey").cast("string"), 6, "0"))).otherwise("#12").alias("color"), F.when(k % 5 != 0, F.concat(F.lit("p"), c("c_nationkey").cast("string"))).otherwise("").alias("parent"),
    )
    return lookup.section_entries(own, "c_custkey", "display", "c_name", "level", "comment", "color", "parent")


@query("""
SELECT c_nationkey, coalesce(nullif(n, ''), s) AS name, nullif(col, '') AS color FROM (SELECT c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END AS n, c_mktsegment AS s, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '#1' END AS col,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer) WHERE k = 1""")
def entries_by_folder(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.when(c("c_custkey") % 2 == 0, "").otherwise(c("c_name")).alias("Name"), c("c_mktsegment").alias("DisplayName"), F.when(c("c_custkey") % 3 == 0, "").otherwise("#1").alias("Color"))
    return lookup.entries_by_folder(own, "c_nationkey", ["Name", "DisplayName"], ["Color"], [c("c_custkey")])


@query("SELECT DISTINCT name FROM (SELECT p_brand AS name FROM part UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT n_name FROM nation) WHERE name <> '' ORDER BY 1")
def icon_names(spark: SparkSession, d: str) -> DataFrame:
    """Distinct names over several tables."""
    return options.names_union([table(spark, d, "part").select(c("p_brand").alias("name")), table(spark, d, "customer").select(c("c_mktsegment").alias("name")), table(spark, d, "nation").select(c("n_name").alias("name"))], "name")


@query("SELECT s_name FROM supplier ORDER BY 1")
def equipment_names(spark: SparkSession, d: str) -> DataFrame:
    return lookup.page(table(spark, d, "supplier").select("s_name"), ["s_name"])


@query("""
WITH l AS (SELECT r_name AS parent, n_name AS child FROM nation JOIN region ON n_regionkey = r_regionkey), t AS (SELECT r_name AS table_name, 1 AS row_count FROM region UNION ALL SELECT n_name, n_nationkey FROM nation)
SELECT t.table_name, t.row_count, count(l.child) AS n_children, CAST(coalesce(sum(x.row_count), 0) AS BIGINT) AS child_rows FROM t LEFT JOIN l ON l.parent = t.table_name LEFT JOIN t x ON x.table_name = l.child
WHERE t.table_name NOT IN (SELECT child FROM l) GROUP BY 1, 2""")
def sections_with_children(spark: SparkSession, d: str) -> DataFrame:
    """Top-level tables with their number of child tables and child rows."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    links = nation.join(region, c("n_regionkey") == c("r_regionkey")).select(c("r_name").alias("parent"), c("n_name").alias("child"))
    tables = region.select(c("r_name").alias("table_name"), F.lit(1).cast("long").alias("row_count")).union(nation.select("n_name", c("n_nationkey").cast("long")))
    return lookup.available_sections(tables, links)


@query("""
SELECT region_id, table_name, row_count FROM (SELECT p_brand AS region_id, CAST(p_partkey AS VARCHAR) AS table_name, p_size AS row_count, row_number() OVER (PARTITION BY p_brand ORDER BY
  CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END, p_size DESC, CAST(p_partkey AS VARCHAR)) AS k FROM part) WHERE k = 1""")
def main_tables(spark: SparkSession, d: str) -> DataFrame:
    parents = F.when(c("p_partkey") % 3 == 0, "a__b").when(c("p_partkey") % 3 == 1, "a__root").otherwise("")
    own = table(spark, d, "part").select(c("p_brand").alias("region_id"), c("p_partkey").cast("string").alias("table_name"), c("p_size").alias("row_count"), parents.alias("parent_tables"))
    return precedence.main_table(own).select("region_id", "table_name", "row_count")


@query("""
SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) OR n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9500)""")
def keys_in_sources(spark: SparkSession, d: str) -> DataFrame:
    """Keys that some source has."""
    a = table(spark, d, "supplier").where("s_acctbal > 9000").select(c("s_nationkey").alias("n_nationkey"))
    b = table(spark, d, "customer").where("c_acctbal > 9500").select(c("c_nationkey").alias("n_nationkey"))
    return precedence.present_in(table(spark, d, "nation").select("n_nationkey"), "n_nationkey", [a, b])


@query("""
WITH u AS (SELECT 0 AS r, CAST(s_suppkey AS VARCHAR) AS name, s_nationkey AS kind FROM supplier UNION ALL SELECT 1, CAST(c_custkey AS VARCHAR), c_nationkey FROM customer)
SELECT name, kind FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY r DESC) AS k FROM u) WHERE k = 1""")
def stats_later_wins(spark: SparkSession, d: str) -> DataFrame:
    """Entries of all tables by name, of which a later table's counts."""
    a = table(spark, d, "supplier").select(c("s_suppkey").cast("string").alias("name"), c("s_nationkey").alias("kind"))
    b = table(spark, d, "customer").select(c("c_custkey").cast("string").alias("name"), c("c_nationkey").alias("kind"))
    return precedence.last_wins(precedence.ranked_union([("a", a), ("b", b)]), ["name"], ["_rank"]).select("name", "kind")


@query("""
SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r) AS k FROM (SELECT 0 AS r, coalesce(nullif(CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 't' || s_nationkey END, ''), CAST(s_suppkey AS VARCHAR)) AS id, min(s_name) AS label FROM supplier GROUP BY 2
  UNION ALL SELECT 1, 't' || n_nationkey, n_name FROM nation)) WHERE k = 1""")
def voice_table_ids(spark: SparkSession, d: str) -> DataFrame:
    """The table key, else the own key; the first by name wins within a source, the first source overall."""
    s = table(spark, d, "supplier").select(F.coalesce(F.nullif(F.when(c("s_suppkey") % 4 == 0, "").otherwise(F.concat(F.lit("t"), c("s_nationkey").cast("string"))), F.lit("")), c("s_suppkey").cast("string")).alias("id"), c("s_name").alias("label"))
    n = table(spark, d, "nation").select(F.concat(F.lit("t"), c("n_nationkey").cast("string")).alias("id"), c("n_name").alias("label"))
    return precedence.union_first_wins([("own", s), ("other", n)], ["id"], [c("label")]).select("id", "label")


@query("""
SELECT 'click' AS like_, event_id FROM events WHERE event_type LIKE 'c%' AND event_id % 7 <> 0 UNION ALL SELECT 'gone', event_id FROM events WHERE event_type LIKE 'c%' AND event_id % 7 = 0""")
def authored_and_deleted_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys by a pattern, live ones and deleted ones."""
    rows = _flagged(spark, d)
    live = lookup.keys_like(rows, "event_type", "c%", deleted=False).select(F.lit("click").alias("like_"), "event_id")
    return live.union(lookup.keys_like(rows, "event_type", "c%", deleted=True).select(F.lit("gone").alias("like_"), "event_id"))


@query("SELECT event_id FROM events WHERE event_type LIKE '%e%' AND event_id % 7 <> 0 AND (event_id % 5 = 0 OR event_id % 3 = 0) AND CAST(event_id AS VARCHAR) LIKE '%5'")
def changed_script_keys(spark: SparkSession, d: str) -> DataFrame:
    """Changed live keys by a pattern and an extension."""
    return lookup.keys_like(_flagged(spark, d), "event_type", "%e%", deleted=False, changed=True).where(c("event_id").cast("string").endswith("5")).select("event_id")


@query("""
SELECT r_name, id, part, parent FROM region, (VALUES ('M', 0), ('F', 1)) m(b, k), LATERAL (SELECT r_name || '_' || b AS id, unnest(['row', 'visual']) AS part, CASE WHEN k = 0 THEN 'male' ELSE 'female' END AS parent)""")
def guardian_rows(spark: SparkSession, d: str) -> DataFrame:
    """A pair of rows for each body, whose parent goes by the body's type."""
    matrix = spark.createDataFrame([(0,), (1,)], "k int")
    out = hierarchy.cross_rows(table(spark, d, "region"), matrix, F.lit("row"), F.lit("visual"))
    return out.select("r_name", F.concat_ws("_", "r_name", labels.body_suffix(c("m.k"))).alias("id"), "part", F.when(c("m.k") == 0, "male").otherwise("female").alias("parent"))


@query("""
WITH s AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 100 = 0), e AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent FROM part),
 a AS (SELECT DISTINCT node // (1 << h) AS node FROM s, range(1, 11) t(h) WHERE node // (1 << h) > 0),
 sp AS (SELECT node, min(r) AS r FROM (SELECT node, 0 AS r FROM s UNION ALL SELECT node, 1 FROM a) GROUP BY 1),
 al AS (SELECT node, min(r) AS r FROM (FROM sp UNION ALL SELECT e.node, 2 FROM e JOIN sp ON e.parent = sp.node) GROUP BY 1)
SELECT al.node, e.parent, CASE r WHEN 0 THEN 'seed' WHEN 1 THEN 'ancestor' ELSE 'child' END AS role FROM al LEFT JOIN e ON al.node = e.node""")
def race_tree(spark: SparkSession, d: str) -> DataFrame:
    """Seeds, their ancestors and one level of children, in a tree of halved keys."""
    nodes = table(spark, d, "part").select("p_partkey", F.when(c("p_partkey") > 1, F.floor(c("p_partkey") / 2)).alias("parent"))
    return hierarchy.tree(nodes, "p_partkey", "parent", nodes.where("p_partkey % 100 = 0"), 10)


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'New' ELSE 'Modified' END AS change, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE concat_ws(',', CASE WHEN p_partkey % 5 = 0 THEN 'name' END, CASE WHEN p_partkey % 7 = 0 THEN 'size' END) END AS fields
FROM part WHERE p_partkey % 11 = 0 OR p_partkey % 5 = 0 OR p_partkey % 7 = 0""")
def diff_stats(spark: SparkSession, d: str) -> DataFrame:
    """Field maps against a baseline: added or changed fields; removals don't count."""
    k, part = c("p_partkey"), table(spark, d, "part")
    base = part.where("p_partkey % 11 <> 0").select("p_partkey", F.create_map(F.lit("name"), c("p_name"), F.lit("gone"), F.lit("x"), F.lit("size"), F.when(k % 7 != 0, c("p_size").cast("string"))).alias("fields")).withColumn("fields", F.map_filter("fields", lambda _, v: v.isNotNull()))
    mine = part.select("p_partkey", F.create_map(F.lit("name"), F.when(k % 5 == 0, F.concat("p_name", F.lit("!"))).otherwise(c("p_name")), F.lit("size"), c("p_size").cast("string")).alias("fields"))
    return diff.diff_maps(mine, base, "p_partkey").select("p_partkey", "change", F.coalesce(F.array_join(F.array_sort(F.map_keys("changes")), ","), F.lit("")).alias("fields"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 AND p_partkey % 3 <> 0 THEN 'New' ELSE 'Modified' END AS change FROM part WHERE (p_partkey % 3 = 0 AND p_partkey % 2 = 0) OR (p_partkey % 3 <> 0 AND (p_partkey % 11 = 0 OR p_partkey % 5 = 0))""")
def rediff(spark: SparkSession, d: str) -> DataFrame:
    """A package against the baseline overlaid by another package."""
    k, part = c("p_partkey"), table(spark, d, "part")
    maps = lambda v: part.select("p_partkey", F.create_map(F.lit("name"), v).alias("fields"))
    base = maps(F.when(k % 5 == 0, "old").otherwise(c("p_name"))).where("p_partkey % 11 <> 0")
    other = maps(F.when(k % 2 == 0, "other").otherwise(c("p_name"))).where("p_partkey % 3 = 0")
    return diff.rediff(maps(c("p_name")), base, other, "p_partkey").select("p_partkey", "change")


# --- change tracking --------------------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS rows FROM events WHERE user_id IS NULL OR user_id <> 3 GROUP BY 1")
def purged_source(spark: SparkSession, d: str) -> DataFrame:
    return staging.purged(table(spark, d, "events"), "user_id", 3).groupBy("event_type").agg(F.count("*").alias("rows"))


@query("SELECT event_type AS table_name, CAST(user_id AS VARCHAR) AS pk_value, CAST(min(event_id) AS VARCHAR) AS image FROM events WHERE event_id % 50 <> 0 GROUP BY 1, 2")
def undo_state(spark: SparkSession, d: str) -> DataFrame:
    """The image that undo restores for every changed row."""
    return staging.images(_journal(spark, d).where("table_name is not null"), redo=False)


@query("SELECT event_type, event_id % 7 = 0 AS gone, count(*) AS n FROM events GROUP BY 1, 2")
def section_rows(spark: SparkSession, d: str) -> DataFrame:
    """Live and deleted rows of each table."""
    rows = _flagged(spark, d)
    live = staging.live(rows).groupBy("event_type").agg(F.count("*").alias("n")).withColumn("gone", F.lit(False))
    return live.unionByName(staging.live(rows, include_deleted=True).where("_is_deleted = 1").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("gone", F.lit(True)))


@query("""SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS image FROM nation""")
def row_images(spark: SparkSession, d: str) -> DataFrame:
    """Rows as JSON and back, as the journal keeps them."""
    own = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    images = own.select(staging.row_image(own).alias("image"))
    return images.select(F.from_json("image", own.schema).alias("r"), "image").select("r.n_nationkey", "image")


@query("SELECT coalesce(max(event_id), 0) AS most FROM events UNION ALL SELECT 0")
def max_file_ids(spark: SparkSession, d: str) -> DataFrame:
    """The largest id of a table, 0 for an empty one."""
    e = table(spark, d, "events")
    return aggregate.largest(e, "event_id").select("most").union(aggregate.largest(e.where("false"), "event_id").select("most"))


# --- groups -----------------------------------------------------------------------------------------------------


@query("SELECT coalesce(nullif(CASE WHEN p_partkey % 6 = 0 THEN '' ELSE p_brand END, ''), 'Other') AS key, count(*) AS n FROM part GROUP BY 1")
def group_list_type(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "part").select("p_partkey", F.when(c("p_partkey") % 6 == 0, "").otherwise(c("p_brand")).alias("node_id"))
    return aggregate.grouped(own, aggregate.list_type_bucket(c("node_id")), "p_partkey").select("key", "n")


@query("SELECT p_brand AS region, count(*) AS n, min(p_partkey) AS first, max(p_partkey) AS last FROM part GROUP BY 1")
def entries_by_region(spark: SparkSession, d: str) -> DataFrame:
    """Entries of each region in one list."""
    out = aggregate.grouped(table(spark, d, "part"), c("p_brand"), "p_partkey")
    return out.select(c("key").alias("region"), "n", F.element_at("entries", 1).alias("first"), F.element_at("entries", -1).alias("last"))


@query("""
WITH l AS (SELECT r_name || '/' || n_name AS p, r_name AS r, count(s_suppkey) FILTER (s_acctbal > 9000) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2)
SELECT p AS folder, n > 0 AS has_files FROM l UNION ALL SELECT r, bool_or(n > 0) FROM l GROUP BY 1""")
def folders_with_files(spark: SparkSession, d: str) -> DataFrame:
    """Whether anything below a folder counts."""
    nation = table(spark, d, "nation").join(table(spark, d, "region"), c("n_regionkey") == c("r_regionkey")).join(table(spark, d, "supplier"), c("n_nationkey") == c("s_nationkey"))
    leaves = nation.select(F.concat_ws("/", "r_name", "n_name").alias("path"), F.when(c("s_acctbal") > 9000, 1).otherwise(0).alias("n"))
    return aggregate.roll_up(leaves, "path", "n").select("folder", (c("total") > 0).alias("has_files"))


@query("""
SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(p_type, 'BRASS|COPPER') THEN 'warm' WHEN regexp_matches(p_type, 'STEEL|TIN') THEN 'cold' ELSE 'Other' END AS bucket FROM part) GROUP BY 1""")
def semantic_groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(aggregate.pattern_bucket(c("p_type"), [("BRASS|COPPER", "warm"), ("STEEL|TIN", "cold")]).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT source, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def folder_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the contents of each folder."""
    own = table(spark, d, "documents").select("source", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("length"))
    return aggregate.total_length(own, "source").select("source", "bytes")


@query("SELECT CASE event_type WHEN 'click' THEN 40 WHEN 'view' THEN 30 ELSE 10 END AS priority, count(*) AS n FROM events GROUP BY 1")
def module_priorities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(precedence.module_priority(c("event_type"), {"click": 40, "view": 30}, 10).alias("priority")).agg(F.count("*").alias("n"))


# --- labels and scalars -----------------------------------------------------------------------------------------


@query("""
WITH t AS (SELECT c_custkey, ['Progressions', 'Lists', 'Origins', 'Feats'][c_custkey % 4 + 1] AS s, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS name, CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_nationkey AS VARCHAR) END AS lv, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS cm, CASE WHEN c_custkey % 6 < 2 THEN '' WHEN c_custkey % 6 < 5 THEN 'D' || c_custkey END AS dn FROM customer)
SELECT c_custkey, CASE s WHEN 'Progressions' THEN coalesce(name, '') || ' Lv' || coalesce(lv, '?') WHEN 'Lists' THEN coalesce(cm, '') WHEN 'Origins' THEN coalesce(nullif(dn, ''), name, '') ELSE coalesce(name, '') END AS stored,
  CASE s WHEN 'Progressions' THEN coalesce(name, 'Unknown') || ' Lv' || coalesce(lv, '?') WHEN 'Lists' THEN coalesce(cm, 'SpellList') WHEN 'Origins' THEN coalesce(dn, name, 'Unknown') ELSE coalesce(name, 'Unknown') END AS packaged FROM t""")
def display_names(spark: SparkSession, d: str) -> DataFrame:
    """Labels of stored entries and of a package's entries, by section."""
    k = c("c_custkey")
    section = F.element_at(F.array(*map(F.lit, ("Progressions", "Lists", "Origins", "Feats"))), (k % 4 + 1).cast("int"))
    name, level, comment = F.when(k % 5 != 0, c("c_name")), F.when(k % 3 != 0, c("c_nationkey").cast("string")), F.when(k % 7 != 0, c("c_mktsegment"))
    display = F.when(k % 6 < 2, "").when(k % 6 < 5, F.concat(F.lit("D"), k.cast("string")))
    return table(spark, d, "customer").select("c_custkey", labels.section_label(section, name, level, comment, display).alias("stored"), labels.package_label(section, name, level, comment, display, F.lit("SpellList")).alias("packaged"))


@query("""
SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'boolean' WHEN 1 THEN 'number' WHEN 2 THEN 'float' WHEN 3 THEN 'uuid' WHEN 4 THEN 'loca' WHEN 5 THEN 'vector' WHEN 6 THEN 'uuid' WHEN 7 THEN 'color' ELSE 'text' END AS shown,
  CASE p_partkey % 9 WHEN 3 THEN 'section:Races' WHEN 4 THEN 'loca:' WHEN 6 THEN 'section:Gods' END AS choices FROM part""")
def field_classes(spark: SparkSession, d: str) -> DataFrame:
    """How fields are shown, and the choice list of key fields."""
    rows = [("bool", "A"), ("uint16", "A"), ("double", "A"), ("guid", "RaceUUID"), ("TranslatedString", "A"), ("fvec3", "A"), ("FixedString", "GodId"), ("LSString", "Tint"), ("LSString", "Plain")]
    examples = F.when(c("p_partkey") % 9 == 6, F.array(F.concat(F.lit("01234567-89ab-cdef-0123-"), F.lpad(c("p_partkey").cast("string"), 12, "0")))).when(c("p_partkey") % 9 == 7, F.array(F.lit("x"), F.lit("#aabbcc"))).otherwise(F.array(c("p_name")))
    at = (c("p_partkey") % 9 + 1).cast("int")
    kind, name = (F.element_at(F.array(*[F.lit(r[i]) for r in rows]), at) for i in (0, 1))
    own = table(spark, d, "part").select("p_partkey", name.alias("name"), labels.field_class(kind, name, examples).alias("shown"))
    return own.select("p_partkey", "shown", labels.choice_source(c("name"), c("shown")).alias("choices"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'type' WHEN 1 THEN 'data-field' WHEN 2 THEN 'data-value' ELSE 'general' END AS context FROM part""")
def line_contexts(spark: SparkSession, d: str) -> DataFrame:
    lines = F.array(*[F.concat(F.lit(a), c("p_brand")) for a in ('type "', ' data "', 'data "x" "', "using ")])
    return table(spark, d, "part").select("p_partkey", labels.line_context(F.element_at(lines, (c("p_partkey") % 4 + 1).cast("int"))).alias("context"))


@query("SELECT s AS section, o - 1 AS ord FROM (SELECT unnest(['Races', 'Lists', 'Spells']) AS s, unnest([1, 3, 11]) AS o)")
def section_order(spark: SparkSession, d: str) -> DataFrame:
    """Places of some sections among the configured ones."""
    return labels.section_order(spark, only_configured=True).where("section IN ('Races', 'Lists', 'Spells')")


@query(r"""
SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'guid' WHEN 1 THEN 'FixedString' WHEN 2 THEN 'int32' WHEN 3 THEN 'FixedString' WHEN 4 THEN 'bool' WHEN 5 THEN 'FixedString' WHEN 6 THEN 'guid' ELSE 'int32' END AS kind FROM events""")
def attribute_types(spark: SparkSession, d: str) -> DataFrame:
    """Types inferred from shapes: guids, flags, integers up to 64 bits, and what only looks like them."""
    i = c("event_id").cast("string")
    shapes = [F.concat(F.lit("01234567-89AB-cdef-0123-"), F.lpad(i, 12, "0")), F.concat(F.lit("01234567-89AB-cdef-0123"), F.lpad(i, 12, "0")), F.concat(F.lit("-"), i), F.concat(F.lit("99999999999999999999"), i), F.lit("False"), F.lit("TRUE"), F.concat(F.lit("0123-456789abcdef-0123-"), F.lpad(i, 12, "0"), F.lit("-")), F.concat(F.lit("+"), i)]
    return table(spark, d, "events").select("event_id", values.infer_type(F.lit("Field"), F.element_at(F.array(*shapes), (c("event_id") % 8 + 1).cast("int"))).alias("kind"))


@query(r"""
SELECT p_partkey, chr(91) || 'size=' || CASE p_partkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 5 WHEN 2 THEN 4 ELSE 3 END || '][b]' || p_brand || '[/b][/size]' || chr(10) || '[b][i]' || p_size || '[/i][/b] [s]x[/s]' || chr(10) || '[list]' || chr(10) || '[*]one' || chr(10) || '[*]two' || chr(10) || '[/list]' || chr(10) || '[line]' AS bb FROM part""")
def markdown_bbcode(spark: SparkSession, d: str) -> DataFrame:
    marks = F.repeat(F.lit("#"), (c("p_partkey") % 4 + 1).cast("int"))
    source = F.concat(marks, F.lit(" "), c("p_brand"), F.lit("\n***"), c("p_size").cast("string"), F.lit("*** ~~x~~\n- one\n- two\n---"))
    return table(spark, d, "part").select("p_partkey", text.markdown_bbcode(source).alias("bb"))


@query("""
SELECT p_partkey, p_size || ',' || p_partkey AS commas, CAST(p_size AS VARCHAR) AS low, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE CAST(p_size AS VARCHAR) END AS high, CASE WHEN p_partkey % 3 = 0 THEN '1' ELSE '0' END AS flag,
  CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_size || '.5' END AS shown FROM part""")
def vectors_and_flags(spark: SparkSession, d: str) -> DataFrame:
    """Runtime values as the toolkit writes them."""
    k, size = c("p_partkey"), c("p_size").cast("string")
    both = F.split(F.concat(F.lit(" "), size, F.lit("  "), k.cast("string"), F.lit(" ")), "x")[0]
    span = values.split_range(F.when(k % 2 == 0, F.concat(size, F.lit(","), k.cast("string"))).otherwise(size))
    return table(spark, d, "part").select(
        "p_partkey", values.vector_to_commas(both).alias("commas"), span["low"].alias("low"), span["high"].alias("high"), values.flag_to_digit(F.when(k % 3 == 0, "True").otherwise("False")).alias("flag"),
        values.float_text(F.when(k % 2 == 0, c("p_size").cast("double")).otherwise(c("p_size") + 0.5)).alias("shown"),
    )


@query("""
SELECT c_custkey, 'h' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || 'g0000g0000g0000g000000000000' AS handle, CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 1 END AS version FROM customer WHERE c_custkey % 5 <> 0""")
def handle_versions(spark: SparkSession, d: str) -> DataFrame:
    """Handles with versions; whatever else is null."""
    handle = F.concat(F.lit("h"), F.lpad(c("c_custkey").cast("string"), 8, "0"), F.lit("g0000g0000g0000g000000000000"))
    value = F.when(c("c_custkey") % 5 == 0, c("c_name")).when(c("c_custkey") % 2 == 0, F.concat(handle, F.lit(";3"))).otherwise(handle)
    own = table(spark, d, "customer").select("c_custkey", text.handle_version(value).alias("h")).where("h is not null")
    return own.select("c_custkey", "h.handle", "h.version")


@query("""
SELECT p_partkey, p_brand || ' ' || p_size AS plain FROM part""")
def markdown_plain(spark: SparkSession, d: str) -> DataFrame:
    source = F.concat(F.lit("## **"), c("p_brand"), F.lit("** ["), c("p_size").cast("string"), F.lit("](http://x)"))
    return table(spark, d, "part").select("p_partkey", text.markdown_plain(source).alias("plain"))


@query("""
SELECT p_partkey, p_brand || '|' || p_size AS ids, true AS several, '["' || p_brand || '","' || p_size || '"]' AS value FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, p_brand, false, '"' || p_brand || '"' FROM part WHERE p_partkey % 2 = 1""")
def joined_keys(spark: SparkSession, d: str) -> DataFrame:
    """One or many keys in a pipe-joined text, and as JSON."""
    raw = F.when(c("p_partkey") % 2 == 0, F.concat(F.lit(" "), c("p_brand"), F.lit(" | |"), c("p_size").cast("string"))).otherwise(c("p_brand"))
    n = text.normalized_ids(raw)
    return table(spark, d, "part").select("p_partkey", n["ids"].alias("ids"), n["several"].alias("several"), config.keys_value(raw, F.lit(False)).alias("value"))


# --- configuration ----------------------------------------------------------------------------------------------


@query("""
SELECT p_partkey, 0 AS at, '{"Action":"Insert","UUID":"' || p_partkey || '","Type":"' || CASE WHEN p_partkey % 2 = 0 THEN 'SpellList' ELSE p_brand END || '","Items":["' || p_size || '"]}' AS json FROM part
UNION ALL SELECT p_partkey, 1, '{"Action":"Remove","UUID":"' || p_partkey || '","Type":"' || CASE WHEN p_partkey % 2 = 0 THEN 'SpellList' ELSE p_brand END || '","Items":["x","y"]}' FROM part WHERE p_partkey % 3 = 0""")
def list_config(spark: SparkSession, d: str) -> DataFrame:
    """Change lists as configuration rows, additions and removals apart."""
    nothing = F.array().cast("array<string>")
    change = lambda a, r: F.struct(F.lit("Spells").alias("field"), a.alias("added"), r.alias("removed"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"))
    changes = F.array(change(F.array(c("p_size").cast("string")), nothing), change(nothing, F.when(c("p_partkey") % 3 == 0, F.array(F.lit("x"), F.lit("y"), F.lit("x"))).otherwise(nothing)))
    own = table(spark, d, "part").select("p_partkey", changes.alias("changes"), F.when(c("p_partkey") % 2 != 0, c("p_brand")).alias("kind"))
    return config.list_rows(own, "p_partkey", "changes", "kind")


@query("""
SELECT p_partkey, 'Insert' AS action, p_brand || ',' || p_size AS items FROM part UNION ALL SELECT p_partkey, 'Remove', 'z' FROM part WHERE p_partkey % 4 = 0""")
def mixed_entries(spark: SparkSession, d: str) -> DataFrame:
    out = config.mixed_entry(table(spark, d, "part"), "p_partkey", F.concat(c("p_brand"), F.lit("; ;"), c("p_size").cast("string")), F.when(c("p_partkey") % 4 == 0, " z;"))
    return out.select("p_partkey", "action", F.array_join("items", ",").alias("items"))


_SECTION = "['Feats', 'Races', 'Nowhere', 'Lists'][p_partkey % 4 + 1]"


@query(f"""
WITH t AS (SELECT {_SECTION} AS section, p_partkey, '{{"UUID":"' || p_partkey || '"}}' AS e FROM part WHERE p_partkey % 4 <> 2)
SELECT section, section || ':' || chr(10) || string_agg('  - ' || e, chr(10) ORDER BY p_partkey) || chr(10) AS yaml, '"' || section || '": [' || string_agg(e, ', ' ORDER BY p_partkey) || ']' AS json FROM t GROUP BY 1""")
def config_documents(spark: SparkSession, d: str) -> DataFrame:
    """Entries grouped by section and rendered as YAML and JSON."""
    sections = config.grouped_sections(_configured(spark, d), "section", "p_partkey", "json")
    return config.yaml_text(sections).select("section", c("content").alias("yaml")).join(config.json_text(sections).select("section", c("content").alias("json")), "section")


def _configured(spark: SparkSession, d: str) -> DataFrame:
    section = F.element_at(F.array(*map(F.lit, ("Feats", "Races", "Nowhere", "Lists"))), (c("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", section.alias("section"), F.to_json(F.struct(c("p_partkey").cast("string").alias("UUID"))).alias("json"))


@query(f"""
SELECT {_SECTION} AS section, CAST(row_number() OVER (PARTITION BY p_partkey % 4 ORDER BY p_partkey) - 1 AS INT) AS pos, '{{"UUID":"' || p_partkey || '"}}' AS json FROM part WHERE p_partkey % 4 <> 2""")
def config_yaml_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """YAML documents, one a section, written and read back."""
    docs = config.yaml_text(config.grouped_sections(_configured(spark, d), "section", "p_partkey", "json"))
    return config.read_yaml(docs.select(c("section").alias("path"), c("content").alias("text"))).select("section", "pos", "json")


@query(f"""
SELECT CAST(p_partkey AS VARCHAR) AS key, {_SECTION} AS section, CASE WHEN p_partkey % 5 = 0 THEN 'over' ELSE '{{"UUID":"' || p_partkey || '"}}' END AS json, CASE WHEN p_partkey % 5 = 0 THEN 'override' ELSE 'auto' END AS origin FROM part UNION ALL SELECT n_name, 'Tags', 'm', 'manual' FROM nation""")
def config_preview(spark: SparkSession, d: str) -> DataFrame:
    """Automatic entries with overrides, and manual ones."""
    auto = _configured(spark, d).select(c("p_partkey").cast("string").alias("key"), "section", "json")
    over = auto.where("CAST(key AS bigint) % 5 = 0").select("key", F.lit("over").alias("json"))
    return config.preview(auto, table(spark, d, "nation").select(c("n_name").alias("key"), F.lit("Tags").alias("section"), F.lit("m").alias("json")), over)


@query("""
SELECT p_partkey AS path, 'Lists' AS section, 0 AS pos, CAST(p_partkey AS VARCHAR) AS uuid, NULL AS problem FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, 'Lists', 1, NULL, 'no key' FROM part WHERE p_partkey % 3 <> 0
UNION ALL SELECT p_partkey, NULL, NULL, NULL, 'not a JSON object' FROM part WHERE p_partkey % 3 = 0""")
def config_parse(spark: SparkSession, d: str) -> DataFrame:
    """Configurations, one a part, read into entries with their problems."""
    good = F.concat(F.lit('{"FileVersion": 1, "Lists": [{"UUID": "'), c("p_partkey").cast("string"), F.lit('", "Items": ["a"]}, {"Items": []}]}'))
    docs = table(spark, d, "part").select(c("p_partkey").alias("path"), F.when(c("p_partkey") % 3 == 0, "no json").otherwise(good).alias("text"))
    return config.config_entries(docs).select("path", "section", "pos", F.try_element_at("fields", F.lit("UUID")).alias("uuid"), "problem")


@query("SELECT p_partkey, 'Name' AS field, p_name AS value FROM part UNION ALL SELECT p_partkey, 'Size', CAST(p_size AS VARCHAR) FROM part WHERE p_partkey % 2 = 0")
def form_columns(spark: SparkSession, d: str) -> DataFrame:
    """A form's prefixed fields as columns; others and blanks are dropped."""
    fields = F.create_map(F.lit("Field:Name"), c("p_name"), F.lit("Field:Size"), F.when(c("p_partkey") % 2 == 0, c("p_size").cast("string")).otherwise(""), F.lit("Other"), F.lit("x"))
    return table(spark, d, "part").select("p_partkey", F.explode(config.flat_keys(fields, {"Field:Name": "Name", "Field:Size": "Size"})).alias("field", "value"))


@query("SELECT p_partkey, CAST(i AS BIGINT) AS pos, CASE i WHEN 0 THEN p_brand ELSE p_type END AS action FROM part, (SELECT unnest([0, 1]) AS i)")
def indexed_fields(spark: SparkSession, d: str) -> DataFrame:
    """Indexed keys of a flat map as objects, and flat again."""
    flat = F.create_map(F.lit("Selector.1.Action"), c("p_type"), F.lit("Selector.0.Action"), c("p_brand"), F.lit("Selector.0.Id"), F.lit("i"), F.lit("x"), F.lit("y"))
    back = values.flattened_items(values.prefixed_index(flat, "Selector"), "Selector")
    own = table(spark, d, "part").select("p_partkey", F.posexplode(values.prefixed_index(back, "Selector")).alias("pos", "item"))
    return own.select("p_partkey", c("pos").cast("long").alias("pos"), F.element_at("item", "Action").alias("action"))


# --- sources ----------------------------------------------------------------------------------------------------


@query("""
SELECT p_brand AS path, 'T' || p_size AS modifier_type, p_name || p_partkey AS field, 'Int' AS field_type FROM part""")
def stats_modifiers(spark: SparkSession, d: str) -> DataFrame:
    """Modifier texts, one a brand, rendered from parts and read back."""
    block = F.concat(F.lit('modifier type "T'), c("p_size").cast("string"), F.lit('"\nmodifier "'), c("p_name"), c("p_partkey").cast("string"), F.lit('","Int"\n'))
    return stats_text.modifiers(_texts(spark, d, block))


def _texts(spark: SparkSession, d: str, block) -> DataFrame:
    docs = aggregate.concatenated(table(spark, d, "part").withColumn("text", block), ["p_brand"], "p_partkey", "text")
    return docs.select(c("p_brand").alias("path"), "text")


@query("SELECT p_brand AS path, 'E' || p_partkey AS name FROM part")
def stats_equipment(spark: SparkSession, d: str) -> DataFrame:
    block = F.concat(F.lit('// a comment\nnew equipment "E'), c("p_partkey").cast("string"), F.lit('"\nadd initialweaponset "Melee"\n'))
    return stats_text.equipment(_texts(spark, d, block)).select("path", "name")


@query("SELECT p_brand AS path, 'N' || p_partkey AS name, CAST(p_size AS VARCHAR) AS first, 'w;' || p_partkey || '|z' AS added FROM part")
def stats_keyed(spark: SparkSession, d: str) -> DataFrame:
    """The other grammar: new rows with parameters, and add rows joined to them."""
    k = c("p_partkey").cast("string")
    block = F.concat(F.lit('new kw "N'), k, F.lit('","'), c("p_size").cast("string"), F.lit('"\nadd extra "w","'), k, F.lit('"\nadd extra "z"\n'))
    out = stats_text.keyed_entries(_texts(spark, d, block))
    return out.select("path", "name", F.element_at("data", "Param1").alias("first"), F.element_at("data", "extra").alias("added"))


@query("""
SELECT p_partkey AS path, CASE p_partkey % 5 WHEN 0 THEN 'equipment' WHEN 1 THEN 'valuelist' WHEN 2 THEN 'modifier' WHEN 3 THEN 'entries' ELSE 'raw' END AS grammar FROM part""")
def stats_grammars(spark: SparkSession, d: str) -> DataFrame:
    """Which grammar a text's first significant line belongs to."""
    heads = [F.concat(F.lit(h), c("p_brand"), F.lit('"')) for h in ('// x\n\nnew equipment "', 'valuelist "', ' modifier type "', 'new entry "', 'plain "')]
    return stats_text.sniff(table(spark, d, "part").select(c("p_partkey").alias("path"), F.element_at(F.array(*heads), (c("p_partkey") % 5 + 1).cast("int")).alias("text"))).select("path", "grammar")


@query("""
SELECT string_agg('new entry "' || n_name || '"' || chr(10) || 'type "N"' || chr(10) || 'data "Key" "' || n_nationkey || '"' || chr(10) || 'data "Region" "' || n_regionkey || '"', chr(10) || chr(10) ORDER BY n_name) || chr(10) AS content FROM nation""")
def stats_render(spark: SparkSession, d: str) -> DataFrame:
    data = F.create_map(F.lit("Region"), c("n_regionkey").cast("string"), F.lit("Key"), c("n_nationkey").cast("string"))
    return stats_text.render(table(spark, d, "nation").select(c("n_name").alias("name"), F.lit("N").alias("type"), F.lit(None).cast("string").alias("using"), data.alias("data")))


@query("SELECT c_custkey AS path, 'h' || c_custkey AS contentuid, CAST(1 AS BIGINT) AS version, c_name AS text FROM customer")
def loca_binary_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Binary text tables, one a customer, written and read back."""
    def make(batches):
        import pyarrow as pa

        for b in batches:
            raw = [loca.encode([(f"h{k}", 1, n)]) for k, n in zip(b.column("c_custkey").to_pylist(), b.column("c_name").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("c_custkey"), pa.array(raw, pa.binary())], ["path", "content"])

    made = table(spark, d, "customer").select(c("c_custkey").cast("long"), "c_name").mapInArrow(make, "path long, content binary")
    out = loca.read_binary(made.select(c("path").cast("string").alias("path"), "content"))
    return out.select(c("path").cast("long").alias("path"), "contentuid", "version", "text")


@query("""
SELECT r_name AS path, n_name AS uuid, 'Tags' AS group_id, 't' || n_nationkey AS object_guid FROM nation JOIN region ON n_regionkey = r_regionkey""")
def tree_child_links(spark: SparkSession, d: str) -> DataFrame:
    """Leaves below the direct children of tree entries."""
    node = F.concat(F.lit('<node id="N"><attribute id="UUID" type="guid" value="'), c("n_name"), F.lit('"/><children><node id="Tags"><children><node id="Tag"><attribute id="Object" type="guid" value="t'), c("n_nationkey").cast("string"), F.lit('"/></node></children></node></children></node>'))
    nodes = trees.read(_regions(spark, d, node))
    links = trees.child_links(nodes).select("path", c("parent_ord").alias("node_ord"), "group_id", "object_guid")
    return trees.entries(nodes).select("path", "uuid", "node_ord").join(links, ["path", "node_ord"]).select("path", "uuid", "group_id", "object_guid")


def _regions(spark: SparkSession, d: str, node) -> DataFrame:
    both = table(spark, d, "nation").join(table(spark, d, "region"), c("n_regionkey") == c("r_regionkey")).withColumn("x", node)
    docs = aggregate.concatenated(both, ["r_name"], "n_name", "x", "")
    return docs.select(c("r_name").alias("path"), F.concat(F.lit('<save><region id="'), c("r_name"), F.lit('"><node id="root"><children>'), c("x"), F.lit("</children></node></region></save>")).alias("text"))


@query("SELECT r_name AS path, n_name AS uuid, n_nationkey % 2 = 0 AS commented FROM nation JOIN region ON n_regionkey = r_regionkey")
def tree_comments(spark: SparkSession, d: str) -> DataFrame:
    """Nodes inside comments are nodes too, marked."""
    plain = F.concat(F.lit('<node id="N"><attribute id="UUID" type="guid" value="'), c("n_name"), F.lit('"/></node>'))
    return trees.entries(trees.read(_regions(spark, d, F.when(c("n_nationkey") % 2 == 0, F.concat(F.lit("<!-- "), plain, F.lit(" -->"))).otherwise(plain)))).select("path", "uuid", "commented")


@query("SELECT r_name AS path, r_name AS regions FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
def tree_regions(spark: SparkSession, d: str) -> DataFrame:
    """Distinct region ids of documents."""
    return trees.region_ids(_regions(spark, d, F.lit(""))).select("path", F.array_join("regions", ",").alias("regions"))


@query("""
SELECT c_custkey AS path, c_name AS name, 'u' || c_custkey AS uuid, '1.2.' || c_nationkey || '.' || c_custkey AS version, 'dep' || c_nationkey AS dependency FROM customer""")
def manifest_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Package manifests, one a customer, rendered and read back."""
    version = F.concat(F.lit("1.2."), c("c_nationkey").cast("string"), F.lit("."), c("c_custkey").cast("string"))
    dep = F.array(F.struct(F.concat(F.lit("dep"), c("c_nationkey").cast("string")).alias("uuid"), F.lit("D").alias("name"), F.lit("F").alias("folder"), F.lit("1.0.0.0").alias("version")))
    own = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("u"), c("c_custkey").cast("string")).alias("uuid"), c("c_name").alias("name"), F.lit("F").alias("folder"), F.lit("A").alias("author"), F.lit("D").alias("description"), version.alias("version"), dep.alias("dependencies"))
    docs = manifest.render(own).select("content")
    out = manifest.manifests(docs.select(F.lit("x").alias("path"), c("content").alias("text")))
    return out.select(F.substring("uuid", 2, 20).cast("long").alias("path"), "name", "uuid", "version", c("dependencies")[0]["uuid"].alias("dependency"))


@query("""
SELECT path, kind, module FROM (SELECT 'Public/' || p_brand || '/x/' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.lsx' WHEN 1 THEN '.loca' ELSE '.png' END AS path, CASE p_partkey % 3 WHEN 0 THEN 'lsx' WHEN 1 THEN 'loca' END AS kind, p_brand AS module FROM part) WHERE kind IS NOT NULL""")
def collected_files(spark: SparkSession, d: str) -> DataFrame:
    """Recognised files of a listing with their kind and module."""
    k = c("p_partkey")
    path = F.concat(F.lit("Public/"), c("p_brand"), F.lit("/x/"), k.cast("string"), F.when(k % 3 == 0, ".lsx").when(k % 3 == 1, ".loca").otherwise(".png"))
    return files.ingest_files(table(spark, d, "part").select(path.alias("path")), {}).select("path", "kind", "module")


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS key, sha256(p_name) AS hash FROM part WHERE p_partkey % 4 <> 0 AND strlen(p_name) <= 40""")
def script_rows(spark: SparkSession, d: str) -> DataFrame:
    """Script files as rows, but for those that are too large or that a user has edited."""
    part = table(spark, d, "part").select(c("p_partkey").cast("string").alias("path"), c("p_name").alias("text"), "p_partkey")
    edited = part.where("p_partkey % 4 = 0").select(c("path").alias("key"), F.lit(1).alias("_is_modified"), F.lit(0).alias("_is_new"))
    return files.script_rows(part, edited, 40).select("key", "hash")


@query(r"""
SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/.*$', '') AS package FROM pages""")
def package_folders(spark: SparkSession, d: str) -> DataFrame:
    """Folders of a project that hold a package's manifest."""
    host = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "/.*$", "")
    listing = table(spark, d, "pages").select(F.explode(F.array(F.concat(F.lit("a/Mods/"), host, F.lit("/meta.lsx")), F.concat(F.lit("a/Public/"), host, F.lit("/x.lsx")))).alias("path"))
    return files.package_folders(listing).select("package")


@query("SELECT p_partkey, 'f' || p_partkey AS name FROM part UNION ALL SELECT p_partkey, 'M.g' FROM part")
def script_functions(spark: SparkSession, d: str) -> DataFrame:
    """Names of the functions that scripts declare, each once."""
    name = F.concat(F.lit("f"), c("p_partkey").cast("string"))
    source = F.concat(F.lit("function "), name, F.lit("(a)\nend\nlocal x = 1\nfunction  M.g ()\nend\nfunction "), name, F.lit("(b) end"))
    return table(spark, d, "part").select("p_partkey", F.explode(text.declared_functions(source)).alias("name"))


@query("SELECT n_regionkey AS path, count(*) AS entries, 'write' AS action FROM nation WHERE n_nationkey % 4 <> 0 GROUP BY 1 UNION ALL SELECT 100 + r_regionkey, 0, 'delete' FROM region")
def export_plan(spark: SparkSession, d: str) -> DataFrame:
    """Files that a workspace renders to, and files on disk that it no longer makes."""
    rows = table(spark, d, "nation").select("n_nationkey", c("n_regionkey").cast("string").alias("r"), "n_name", F.when(c("n_nationkey") % 4 == 0, 1).otherwise(0).alias("_is_deleted"))
    kind = export.GroupedText(F.concat(c("r"), F.lit(".txt")), c("n_name"), "n_nationkey")
    present = table(spark, d, "region").select(F.explode(F.array(F.concat((c("r_regionkey") + 100).cast("string"), F.lit(".txt")), F.concat(c("r_regionkey").cast("string"), F.lit(".txt")), F.lit("keep.md"))).alias("path"))
    out = export.export_plan([(kind, rows)], present, ".txt")
    return out.select(F.regexp_replace("path", r"\.txt$", "").cast("long").alias("path"), "entries", "action")


@query("SELECT n_regionkey || '.txt' AS path, 'A' || chr(10) || string_agg(n_name, chr(10) ORDER BY n_nationkey) || chr(10) || 'Z' AS content FROM nation GROUP BY n_regionkey")
def export_contents(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").select("n_nationkey", c("n_regionkey").cast("string").alias("r"), "n_name", F.lit(0).alias("_is_deleted"))
    return export.GroupedText(F.concat(c("r"), F.lit(".txt")), c("n_name"), "n_nationkey", "A\n", "\nZ").render(rows)


@query("""
SELECT b AS base, category, string_agg('// ' || p_partkey || '.txt' || chr(10) || p_name, chr(10) || chr(10) ORDER BY path) AS text, count(*) AS parts FROM (SELECT p_partkey, p_name, 'M/Stats/Generated/Data/' AS b, 'c' || p_size AS category, 'M/Stats/Generated/Data/c' || p_size || '/' || p_partkey || '.txt' AS path FROM part) GROUP BY 1, 2 HAVING count(*) >= 2""".replace("'M/", "'x/M/"))
def merged_stats(spark: SparkSession, d: str) -> DataFrame:
    """Stats texts of each category as one, under their names."""
    path = F.concat(F.lit("x/M/Stats/Generated/Data/c"), c("p_size").cast("string"), F.lit("/"), c("p_partkey").cast("string"), F.lit(".txt"))
    return packaging.merged_stats(table(spark, d, "part").select(path.alias("path"), c("p_name").alias("text")))


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS binary_ FROM part""")
def binary_on_packaging(spark: SparkSession, d: str) -> DataFrame:
    k = c("p_partkey")
    path = F.concat(F.when(k % 3 == 0, "a/RootTemplates/").when(k % 3 == 1, "a/b/").otherwise("a/Lists/"), k.cast("string"), F.when(k % 3 == 1, ".lsf.lsx").otherwise(".lsx"))
    return table(spark, d, "part").select("p_partkey", packaging.becomes_binary(path).alias("binary_"))


# --- checks -----------------------------------------------------------------------------------------------------


@query("""
SELECT o_orderkey AS name, 'G' || o_custkey AS parent FROM orders WHERE o_custkey % 2 = 1""")
def goal_parents(spark: SparkSession, d: str) -> DataFrame:
    """Parents that goal texts name and that neither exist nor are well known."""
    k = c("o_custkey")
    parent = F.when(k % 2 == 1, F.concat(F.lit("G"), k.cast("string"))).when(k % 4 == 0, "Act1").otherwise(c("o_orderkey").cast("string"))
    goals = table(spark, d, "orders").select(c("o_orderkey").cast("string").alias("name"), F.concat(F.lit('Version 1\n  ParentTargetEdge "'), parent, F.lit('"\n')).alias("text"))
    return validate.goal_parents(goals).select(c("name").cast("long").alias("name"), "parent")


@query("""
SELECT conv_id, turn, CAST(1 AS BIGINT) AS line_no FROM conversations WHERE turn % 2 = 0""")
def block_rules(spark: SparkSession, d: str) -> DataFrame:
    """Blocks from a start line to a delimiter whose text matches."""
    body = F.concat(F.lit("BEGIN\nx "), F.when(c("turn") % 2 == 0, "bad").otherwise("good"), F.lit("\nEND\nbad"))
    rows = lint.lines(table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.count("*").alias("n")).withColumn("place", F.struct("conv_id", "turn")).withColumn("t", body), "place", "t")
    out = lint.apply_block_rules(rows, "place", "^BEGIN", "^END", "x bad", "r").select("place.conv_id", "place.turn", c("line_no").cast("long").alias("line_no"))
    return out.join(table(spark, d, "conversations").select("conv_id", "turn"), ["conv_id", "turn"])


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS path, CASE p_partkey % 3 WHEN 0 THEN 'not a JSON object' ELSE 'no key B' END AS message FROM part WHERE p_partkey % 3 <> 1""")
def json_configs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "part").select(c("p_partkey").cast("string").alias("path"), F.element_at(F.array(F.lit("[1"), F.lit('{"A": 1, "B": 2}'), F.lit('{"A": 1}')), (c("p_partkey") % 3 + 1).cast("int")).alias("text"))
    return validate.json_configs(docs, ["A", "B"]).select("path", "message")


# --- choices, previews and texts of the toolkit -----------------------------------------------------------------


@query("""
WITH v AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, '[' || s_name || '] ' || s_suppkey AS label FROM supplier WHERE s_nationkey % 2 = 0),
     s AS (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_size % 2 = 0)
SELECT id, label FROM v UNION ALL SELECT id, id FROM s WHERE id NOT IN (SELECT id FROM v)""")
def child_options(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of a node, then parts that entries of one section hold in the group."""
    node = F.when(c("s_nationkey") % 2 == 0, "God").otherwise("Other")
    vanilla = table(spark, d, "supplier").select(c("s_suppkey").cast("string").alias("id"), c("s_name").alias("display"), node.alias("node_id"))
    groups = F.create_map(F.lit("Gods"), F.array(c("p_partkey").cast("string")), F.lit("Visuals"), F.array(F.lit("x")))
    entries = table(spark, d, "part").select(F.when(c("p_size") % 2 == 0, "Races").otherwise("Feats").alias("section"), groups.alias("children"))
    return options.child_options(vanilla, [entries, entries], "Gods", "God")


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS uuid, 'N' AS node_id, 'Name=' || c_name || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ',Segment=' || c_mktsegment END AS attributes FROM customer""")
def entry_previews(spark: SparkSession, d: str) -> DataFrame:
    """Customers as preview entries without empty and internal columns."""
    own = table(spark, d, "customer").select(c("c_custkey").cast("string").alias("_pk"), F.lit(1).alias("_is_new"), c("c_name").alias("Name"), F.when(c("c_custkey") % 3 != 0, c("c_mktsegment")).alias("Segment"))
    pairs = F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return lookup.preview(own, "_pk", "N").select("uuid", "node_id", F.array_join(pairs, ",").alias("attributes"))


@query("""
SELECT n_regionkey, 'Version 1\nSubGoalCombiner SGC_AND\n\nINITSECTION\n' ||
  string_agg('DB_RaceTags(' || replace(n_name, ' ', '_') || '_' || n_nationkey || ', REALLY_' || replace(n_name, ' ', '_') || '_' || n_nationkey || ');', chr(10) ORDER BY n_nationkey) ||
  '\n\nKBSECTION\n\nEXITSECTION\n\nENDEXITSECTION\n\nParentTargetEdge "__Shared_Campaign"\n' AS text FROM nation GROUP BY 1""")
def tag_goals(spark: SparkSession, d: str) -> DataFrame:
    """A goal text a region, a fact a nation."""
    uuid = c("n_nationkey").cast("string")
    pairs = table(spark, d, "nation").select("n_regionkey", "n_nationkey", c("n_name").alias("name"), uuid.alias("uuid"), F.concat(F.lit("REALLY "), c("n_name")).alias("real_name"), uuid.alias("real_uuid"))
    return config.tag_goals(pairs, "n_regionkey", "n_nationkey")


@query("""
SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, n_name AS folder FROM nation WHERE n_regionkey = (SELECT max(n_regionkey) FROM nation)""")
def active_folders(spark: SparkSession, d: str) -> DataFrame:
    """Folders of the newest of the settings files, one a region."""
    line = lambda name: F.concat(F.lit('  <attribute id="Folder" type="LSString" value="'), name, F.lit('"/>'))
    body = aggregate.concatenated(table(spark, d, "nation").withColumn("line", line(c("n_name"))), ["n_regionkey"], "n_nationkey", "line")
    head = F.concat(line(F.lit("before")), F.lit('\n<node id="Mods">\n<children>\n'), line(F.lit("Gustav")), F.lit("\n</children>\n"))
    tail = F.concat(F.lit("\n\t</children>\r\n"), line(F.lit("after")))
    return files.active_folders(body.select(c("n_regionkey").cast("string").alias("path"), c("n_regionkey").alias("modified"), F.concat(head, c("line"), tail).alias("text"))).select(c("pos").cast("long").alias("pos"), "folder")


@query("""
SELECT p_partkey FROM part WHERE p_partkey % 6 IN (0, 2, 3)""")
def data_paths(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose made-up path a reference build would read."""
    paths = F.array(*[F.lit(x) for x in ("Public/A.B/x/a.lsx", "Public/A.B/a.txt", "Public/DiceSet_9/x/b.lsf", "Mods/M/meta.lsx", "Mods/M/N/meta.lsx", "Public/AxB/a.lsx")])
    path = F.element_at(paths, (c("p_partkey") % 6 + 1).cast("int"))
    return table(spark, d, "part").where(path.rlike(text.data_pattern(["Public/A.B", "Public/C"], ["lsx", "lsf"]))).select("p_partkey")
