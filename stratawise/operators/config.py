"""Configuration documents from change lists and manual entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratawise.functions.labels import goal_guid, section_rank
from stratawise.functions.text import split_delimited
from stratawise.functions.values import insert_and_remove
from stratawise.operators.aggregate import concatenated


def list_rows(df: DataFrame, key: str, changes: str, kind: str | None = None, field: str = "Items") -> DataFrame:
    """A change list as one row for additions and one for removals: (key, json), Insert before Remove."""
    rows = df.select(key, *([kind] if kind else []), F.posexplode(insert_and_remove(F.col(changes))).alias("at", "r"))
    parts = [F.col("r.action").alias("Action"), F.col(key).cast("string").alias("UUID")]
    if kind:
        parts.append(F.coalesce(kind, F.lit("SpellList")).alias("Type"))
    return rows.select(key, "at", F.to_json(F.struct(*parts, F.col("r.values").alias(field))).alias("json"))


def mixed_entry(df: DataFrame, key: str, added: Column, removed: Column) -> DataFrame:
    """A manual entry with both kinds of items as (key, action, items), empty sides left out."""
    sides = F.array(*[F.struct(F.lit(a).alias("action"), split_delimited(c).alias("items")) for a, c in (("Insert", added), ("Remove", removed))])
    return df.select(key, F.explode(F.filter(sides, lambda s: F.size(s["items"]) > 0)).alias("s")).select(key, "s.action", "s.items")


def keys_value(ids: Column, is_array: Column) -> Column:
    """Pipe-joined keys as JSON: a list if marked so or if several, else one text."""
    parts = F.filter(F.transform(F.split(F.coalesce(ids, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.coalesce(is_array, F.lit(False)) | (F.size(parts) > 1), F.to_json(parts)).otherwise(F.concat(F.lit('"'), F.coalesce(F.get(parts, F.lit(0)), F.lit("")), F.lit('"')))


def grouped_sections(entries: DataFrame, section: str, order: str, content: str) -> DataFrame:
    """(section, ord, entries): each section's entries in order, sections by their place in the output; unknown ones are left out."""
    own = entries.withColumn("__ord", section_rank(F.col(section))).where("__ord is not null")
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(content).alias("c")))), lambda x: x["c"])
    return own.groupBy(F.col(section).alias("section"), F.col("__ord").alias("ord")).agg(listed.alias("entries"))


def yaml_text(sections: DataFrame) -> DataFrame:
    """Each section as a YAML list of its entries (JSON objects, which are YAML flow mappings): (section, ord, content)."""
    lines = F.array_join(F.transform("entries", lambda e: F.concat(F.lit("  - "), e)), "\n")
    return sections.select("section", "ord", F.concat(F.col("section"), F.lit(":\n"), lines, F.lit("\n")).alias("content"))


def json_text(sections: DataFrame) -> DataFrame:
    """Each section as a JSON member of the document: (section, ord, content)."""
    return sections.select("section", "ord", F.concat(F.lit('"'), F.col("section"), F.lit('": ['), F.array_join("entries", ", "), F.lit("]")).alias("content"))


def read_yaml(files: DataFrame) -> DataFrame:
    """The inverse of ``yaml_text`` over (path, text): (path, section, pos, json).  A section is a header line and the items
    directly below it.  Texts are cut into lines, for a pattern with a repeated group recurses once a line."""
    own = files.select("path", F.explode(F.split("text", r"\n(?=\w+:\n)")).alias("b")).where(F.col("b").rlike(r"^\w+:\n"))
    lines = own.select("path", F.split("b", "\n").alias("all")).select("path", F.substring_index(F.col("all")[0], ":", 1).alias("section"), F.slice("all", 2, F.size("all")).alias("rest"))
    end = F.array_position(F.transform("rest", lambda x: x.startswith("  - ")), F.lit(False))
    items = F.when(end > 0, F.slice("rest", 1, (end - 1).cast("int"))).otherwise(F.col("rest"))
    return lines.select("path", "section", F.posexplode(F.transform(items, lambda x: F.substr(x, F.lit(5)))).alias("pos", "json"))


def preview(automatic: DataFrame, manual: DataFrame, overrides: DataFrame, key: str = "key") -> DataFrame:
    """(key, section, json, origin): automatic entries with their overrides, then manual ones."""
    over = overrides.select(key, F.col("json").alias("__json"))
    auto = automatic.join(over, key, "left").select(key, "section", F.coalesce("__json", "json").alias("json"), F.when(F.col("__json").isNotNull(), "override").otherwise("auto").alias("origin"))
    return auto.unionByName(manual.select(key, "section", "json", F.lit("manual").alias("origin")))


def flat_keys(fields: Column, names: dict[str, str]) -> Column:
    """A field map with prefixed keys renamed to their columns; other keys and blanks are dropped."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    kept = F.map_filter(fields, lambda k, v: F.map_contains_key(known, k) & (F.coalesce(v, F.lit("")) != ""))
    return F.transform_keys(kept, lambda k, _: F.element_at(known, k))


def config_entries(files: DataFrame) -> DataFrame:
    """Configurations ``{section: [entry, ...]}`` from (path, text): (path, section, pos, fields, problem), one row an entry."""
    parsed = files.withColumn("v", F.from_json("text", "map<string,string>"))
    bad = parsed.where("v is null").select("path", F.lit(None).cast("string").alias("section"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("map<string,string>").alias("fields"), F.lit("not a JSON object").alias("problem"))
    rows = parsed.where("v is not null").select("path", F.explode("v").alias("section", "raw")).where("startswith(raw, '[')")
    rows = rows.select("path", "section", F.posexplode(F.from_json("raw", "array<map<string,string>>")).alias("pos", "fields"))
    keyed = F.coalesce(F.try_element_at("fields", F.lit("UUID")), F.try_element_at("fields", F.lit("UUIDs")), F.try_element_at("fields", F.lit("ID")), F.lit(""))
    return rows.withColumn("problem", F.when(keyed == "", "no key")).unionByName(bad)


#: The lines of a goal before and after its facts.
GOAL_HEAD = ("Version 1", "SubGoalCombiner SGC_AND", "", "INITSECTION")
GOAL_TAIL = ("", "KBSECTION", "", "EXITSECTION", "", "ENDEXITSECTION", "", 'ParentTargetEdge "__Shared_Campaign"', "")


def tag_goals(pairs: DataFrame, group: str, order: str) -> DataFrame:
    """(group, text): a goal that pairs race tags (name, uuid) with their real ones (real_name, real_uuid); no pairs, no goal."""
    fact = F.concat(F.lit("DB_RaceTags("), goal_guid(F.col("name"), F.col("uuid")), F.lit(", "), goal_guid(F.col("real_name"), F.col("real_uuid")), F.lit(");"))
    facts = concatenated(pairs.withColumn("text", fact), [group], order, "text")
    return facts.select(group, F.concat(F.lit("\n".join(GOAL_HEAD) + "\n"), "text", F.lit("\n" + "\n".join(GOAL_TAIL))).alias("text"))
