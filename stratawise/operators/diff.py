"""Comparison of a package with a baseline: rows, fields, sets and maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratawise.functions import text as T
from stratawise.operators.precedence import overlay


def changed_fields(mine: Column, base: Column) -> Column:
    """Fields of the map ``mine`` that ``base`` lacks or has otherwise; removals don't count."""
    return F.map_filter(mine, lambda k, v: ~v.eqNullSafe(F.element_at(base, k)))


def _with_base(package: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """Package rows with those of the baseline.  Maps take many times the space of the files they are made from, by whose
    size a broadcast would be chosen, so both sides are sorted."""
    return package.join(base.hint("merge"), key, "left")


def diff_maps(package: DataFrame, baseline: DataFrame, key: str, fields: str = "fields") -> DataFrame:
    """(key, change, changes): New rows with no changes listed, Modified rows with theirs; unchanged dropped."""
    base = baseline.select(key, F.col(fields).alias("__base"))
    joined = _with_base(package, base, key)
    changes = changed_fields(F.col(fields), F.col("__base"))
    out = joined.select(key, F.when(F.col("__base").isNull(), "New").otherwise("Modified").alias("change"), F.when(F.col("__base").isNotNull(), changes).alias("changes"))
    return out.where((F.col("change") == "New") | (F.size("changes") > 0))


def diff_columns(package: DataFrame, baseline: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, change, fields): New or Modified rows with the sorted names of changed columns."""
    base = baseline.select(key, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__there"))
    named = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in sorted(columns)]))
    out = _with_base(package, base, key).select(key, F.when(F.col("__there").isNull(), "New").otherwise("Modified").alias("change"), F.when(F.col("__there"), named).otherwise(F.array().cast("array<string>")).alias("fields"))
    return out.where((F.col("change") == "New") | (F.size("fields") > 0))


def set_changes(mine: Column, base: Column) -> tuple[Column, Column]:
    """Added and removed members, each once, sorted."""
    empty = F.array().cast("array<string>")
    a, b = F.coalesce(mine, empty), F.coalesce(base, empty)
    return F.array_sort(F.array_except(a, b)), F.array_sort(F.array_except(b, a))


def diff_delimited(mine: Column, base: Column, delimiter: str = ";") -> tuple[Column, Column]:
    """Set difference both ways of two delimited texts."""
    return set_changes(T.split_delimited(mine, delimiter), T.split_delimited(base, delimiter))


def scalar_change(mine: Column, base: Column) -> Column:
    """Whether a field present in the package differs from the baseline (absent counts as null)."""
    return mine.isNotNull() & ~mine.eqNullSafe(base)


def diff_children(package: DataFrame, baseline: DataFrame, key: str, child: str) -> DataFrame:
    """(key, added, removed): child ids by parent, for parents with a difference."""
    sets = lambda df, name: df.groupBy(key).agg(F.collect_set(F.col(child).cast("string")).alias(name))
    both = sets(package, "mine").join(sets(baseline, "base"), key, "full")
    added, removed = set_changes(F.col("mine"), F.col("base"))
    return both.select(key, added.alias("added"), removed.alias("removed")).where("size(added) + size(removed) > 0")


#: Rules by section: which fields are compared as delimited sets, as scalars, as flags, and which child groups.
SECTION_RULES: dict[str, dict] = {
    "progression": {"delimited": {"Boosts": ";", "PassivesAdded": ";", "PassivesRemoved": ";"}, "scalars": (), "flags": ("AllowImprovement", "IsMulticlass"), "selectors": True, "children": ("SubClasses",)},
    "list": {"delimited": {"Abilities": ";", "Equipment": ";", "Passives": ",", "Skills": ",", "Spells": ";"}, "scalars": (), "flags": (), "selectors": False, "children": ()},
    "race": {
        "delimited": {}, "scalars": (), "flags": (), "selectors": False,
        "children": ("EyeColors", "SkinColors", "HairColors", "TattooColors", "MakeupColors", "LipsMakeupColors", "HairGrayingColors", "HairHighlightColors", "HornColors", "HornTipColors", "Gods", "ExcludedGods", "Visuals", "Tags"),
    },
    "feat": {"delimited": {"PassivesAdded": ";"}, "scalars": (), "flags": ("AllowImprovement", "CanBeTakenMultipleTimes"), "selectors": True, "children": ()},
    "origin": {"delimited": {"Passives": ";"}, "scalars": ("BodyShape", "BodyType", "VoiceTableUUID", "AppearanceLocked"), "flags": (), "selectors": False, "children": ("AppearanceTags", "ReallyTags")},
    "background": {"delimited": {"Passives": ";"}, "scalars": (), "flags": ("Hidden",), "selectors": False, "children": ("Tags",)},
    "action_resource": {
        "delimited": {}, "scalars": ("Name", "MaxLevel", "ReplenishType", "DiceType", "MaxValue"), "selectors": False, "children": (),
        "flags": ("IsHidden", "IsSpellResource", "PartyActionResource", "ShowOnActionResourcePanel", "UpdatesSpellPowerLevel"),
    },
    "action_resource_group": {"delimited": {"ActionResourceDefinitions": ";"}, "scalars": (), "flags": (), "selectors": False, "children": ()},
    "class_description": {
        "delimited": {}, "selectors": False, "children": ("Tags",), "flags": ("CanLearnSpells", "MustPrepareSpells", "HasGod", "IsDefaultForUseSpellAction"),
        "scalars": (
            "BaseHp", "HpPerLevel", "SpellCastingAbility", "PrimaryAbility", "ClassHotbarColumns", "CommonHotbarColumns", "ItemsHotbarColumns", "LearningStrategy", "MulticlassSpellcasterModifier", "AnimationSetPriority",
            "CharacterCreationPose", "ClassEquipment", "SoundClassType", "ProgressionTableUUID", "SpellList", "ParentGuid", "Name",
        ),
    },
    "generic": {"delimited": {}, "scalars": None, "flags": (), "selectors": False, "children": ()},
}


def diff_section(package: DataFrame, baseline: DataFrame, rules: dict, key: str = "uuid") -> DataFrame:
    """(key, change, field, added, removed, before, after) of attribute maps under one section's rules.

    ``rules["scalars"]`` None compares every field not otherwise named.  Child groups are compared
    as sets where both sides have ``children``, a map from group to ids."""
    groups = rules["children"] if "children" in package.columns and "children" in baseline.columns else ()
    base = baseline.select(key, F.col("attributes").alias("__base"), *([F.col("children").alias("__children")] if groups else []))
    change = lambda kind, field=None, added=None, removed=None, before=None, after=None: F.struct(
        F.lit(kind).alias("change"), *[(F.lit(None) if v is None else v).cast(t).alias(n) for n, t, v in (("field", "string", field), ("added", "array<string>", added), ("removed", "array<string>", removed), ("before", "string", before), ("after", "string", after))]
    )
    named = {**rules["delimited"], **({"Selectors": ";"} if rules["selectors"] else {})}
    sets = [change("Modified", F.lit(f), *diff_delimited(F.col("attributes")[f], F.col("__base")[f], d)) for f, d in named.items()]
    sets += [change("Modified", F.lit(g), *set_changes(F.element_at("children", g), F.element_at("__children", g))) for g in groups]
    none = F.array().cast("array<struct<change:string,field:string,added:array<string>,removed:array<string>,before:string,after:string>>")
    found = [none]
    if sets:
        found.append(F.filter(F.array(*sets), lambda x: F.size(x["added"]) + F.size(x["removed"]) > 0))
    if rules["scalars"] is None or rules["scalars"] or rules["flags"]:
        wanted = lambda f: ~f.isin(list(named) or [""]) if rules["scalars"] is None else f.isin([*rules["scalars"], *rules["flags"]])
        own = F.filter(F.map_entries("attributes"), lambda a: wanted(a["key"]) & scalar_change(a["value"], F.element_at(F.col("__base"), a["key"])))
        fields = F.transform(own, lambda a: change("Modified", a["key"], before=F.element_at(F.col("__base"), a["key"]), after=a["value"]))
        found.append(F.coalesce(fields, none))
    changes = F.when(F.col("__base").isNull(), F.array(change("New"))).otherwise(F.concat(*found))
    # All changes of a row at once: the baseline is joined once, not for each kind.
    return _with_base(package, base, key).select(key, F.explode(changes).alias("x")).select(key, "x.*")


def rediff(package: DataFrame, baseline: DataFrame, other: DataFrame, key: str, fields: str = "fields") -> DataFrame:
    """Diff against the baseline overlaid by another package."""
    return diff_maps(package, overlay(baseline, other, [key]), key, fields)


def compare_inheritance(parent: Column, child: Column) -> Column:
    """Map field → inherited, overridden or new over the fields of both."""
    return F.map_zip_with(parent, child, lambda k, p, c: F.when(c.isNull(), "inherited").when(p.isNull(), "new").when(p == c, "inherited").otherwise("overridden"))


def strip_inherited(df: DataFrame, parents: DataFrame, key: str, parent: str, fields: str = "fields") -> DataFrame:
    """Fields equal to the parent row's are dropped; one level."""
    up = parents.select(F.col(key).alias(parent), F.col(fields).alias("__up"))
    kept = F.when(F.col("__up").isNull(), F.col(fields)).otherwise(F.map_filter(F.col(fields), lambda k, v: ~v.eqNullSafe(F.element_at(F.col("__up"), k))))
    return _with_base(df, up, parent).withColumn(fields, kept).drop("__up")


def file_delta(planned: DataFrame, present: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, action): create, update, unchanged or delete, by digest of the contents."""
    a = planned.select(path, F.sha2(F.col(content).cast("binary"), 256).alias("__new"))
    b = present.select(path, F.sha2(F.col(content).cast("binary"), 256).alias("__old"))
    action = F.when(F.col("__old").isNull(), "create").when(F.col("__new").isNull(), "delete").when(F.col("__new") == F.col("__old"), "unchanged").otherwise("update")
    return a.join(b, path, "full").select(path, action.alias("action"))


def round_trip(original: DataFrame, imported: DataFrame, section: str, entry: str) -> DataFrame:
    """Per section: entries, entries lost, and fidelity in percent."""
    lost = original.join(imported.select(section, entry).distinct(), [section, entry], "left_anti").groupBy(section).agg(F.count("*").alias("lost"))
    total = original.groupBy(section).agg(F.count("*").alias("entries")).join(lost, section, "left").na.fill(0, ["lost"])
    return total.withColumn("fidelity", F.round(100 * (F.col("entries") - F.col("lost")) / F.col("entries")).cast("int"))
