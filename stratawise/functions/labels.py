"""Labels, sections and field kinds as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sections in their output order; the first eleven are those of a configuration.
SECTIONS = (
    "Races", "Progressions", "Lists", "Backgrounds", "BackgroundGoals", "ActionResources", "ActionResourceGroups", "ClassDescriptions", "Origins", "Feats", "Spells",
    "Gods", "Tags", "Visuals", "CharacterCreation", "CharacterCreationPresets", "ColorDefinitions", "FeatDescriptions", "Animation", "AnimationOverrides", "Calendar",
    "CinematicArenaFrequencyGroups", "CombatCameraGroups", "Content", "CustomDice", "DefaultValues", "DifficultyClasses", "Disturbances", "Encumbrance", "EquipmentTypes",
    "Factions", "Flags", "FixedHotBarSlots", "TextureAtlasInfo", "IconUVList", "ItemThrowParams", "Levelmaps", "LimbsMapping", "Meta", "MultiEffectInfos", "ProjectileDefaults",
    "RandomCasts", "RootTemplates", "Ruleset", "Shapeshift", "Sound", "SpellMetadata", "StatusMetadata", "Surface", "TooltipExtras", "TrajectoryRules", "Tutorials", "VFX", "Voices",
    "WeaponAnimationSetData", "ErrorDescriptions", "ProgressionDescriptions", "CompanionPresets", "SpellLists", "SkillLists", "PassiveLists", "EquipmentLists", "AbilityLists",
    "ExperienceRewards", "GoldValues", "DeathEffects", "SpeakerGroups", "Gossips",
)
CONFIGURED = 11
#: The choice list of a key field, by the field's name without its suffix.
CHOICES = {
    "Race": "section:Races", "SubRace": "section:Races", "Background": "section:Backgrounds", "Class": "section:ClassDescriptions", "Origin": "section:Origins", "God": "section:Gods",
    "Progression": "section:Progressions", "Feat": "section:Feats", "Tag": "section:Tags", "Spell": "section:Spells", "ParentGuid": "section:RootTemplates",
    "ParentTemplateId": "section:RootTemplates", "RootTemplate": "section:RootTemplates", "EquipmentType": "section:EquipmentTypes", "ActionResource": "section:ActionResources",
    "VoiceTable": "voiceTable:", "ProgressionTable": "progressionTable:",
}


def section_order(spark: SparkSession, only_configured: bool = False) -> DataFrame:
    """(section, ord) in output order."""
    return spark.createDataFrame([(s, i) for i, s in enumerate(SECTIONS[: CONFIGURED if only_configured else None])], "section string, ord int")


def section_rank(section: Column) -> Column:
    """Place of a section in the output, null for an unknown one."""
    at = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), section)
    return F.when(at > 0, at.cast("int") - 1)


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def section_label(section: Column, name: Column, level: Column, comment: Column, display: Column) -> Column:
    """The label of a stored entry."""
    named = F.coalesce(name, F.lit(""))
    return (
        F.when(section == "Progressions", F.concat(named, F.lit(" Lv"), F.coalesce(level, F.lit("?")))).when(section == "Lists", F.coalesce(comment, F.lit("")))
        .when(section.isin("Backgrounds", "Origins"), F.coalesce(_filled(display), named)).otherwise(named)
    )


def package_label(section: Column, name: Column, level: Column, comment: Column, display: Column, node: Column) -> Column:
    """The label of a package's entry, which says Unknown where the stored one is empty."""
    named = F.coalesce(name, F.lit("Unknown"))
    return (
        F.when(section == "Progressions", F.concat(named, F.lit(" Lv"), F.coalesce(level, F.lit("?")))).when(section == "Lists", F.coalesce(comment, _filled(node), F.lit("Unknown List")))
        .when(section.isin("Backgrounds", "Origins"), F.coalesce(display, named)).otherwise(named)
    )


_GUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def field_class(kind: Column, name: Column, examples: Column) -> Column:
    """How a field is shown: by its domain type, and texts by their name and examples."""
    plain = F.coalesce(kind.isin("FixedString", "LSString", "LSWString"), F.lit(False))
    some = lambda pattern: F.coalesce(F.exists(examples, lambda e: e.rlike(pattern)), F.lit(False))
    return (
        F.when(kind == "bool", "boolean").when(kind.rlike("^u?int(8|16|32|64)$"), "number").when(kind.rlike("^(float|double|float64)$"), "float").when(kind == "guid", "uuid")
        .when(kind.isin("TranslatedString", "TranslatedFSString"), "loca").when(kind.rlike("^[fi]vec[234]$"), "vector")
        .when(plain & name.rlike("(?i)(uuid|guid|id)$") & some(_GUID), "uuid").when(plain & name.rlike("(?i)^(description|displayname|displaydescription)$"), "loca")
        .when(plain & some("^#[0-9A-Fa-f]{6,9}$"), "color").otherwise("text")
    )


def choice_source(name: Column, shown: Column) -> Column:
    """The choice list of a field, null without one."""
    known = F.create_map(*[F.lit(x) for pair in CHOICES.items() for x in pair])
    stem = F.regexp_replace(name, "(?i)(uuid|guid|id)$", "")
    return F.when(shown == "loca", "loca:").when(shown == "uuid", F.coalesce(F.try_element_at(known, name), F.try_element_at(known, stem)))


def line_context(line: Column) -> Column:
    """What is being written at the end of a stats line."""
    return F.when(line.rlike(r'^\s*(?i:type)\s+"[^"]*$'), "type").when(line.rlike(r'^\s*(?i:data)\s+"[^"]*$'), "data-field").when(line.rlike(r'^\s*(?i:data)\s+"[^"]*"\s+"[^"]*$'), "data-value").otherwise("general")


def body_suffix(body_type: Column) -> Column:
    return F.when(body_type == 0, "M").otherwise("F")


def goal_guid(name: Column, uuid: Column) -> Column:
    """A name and a key as one goal symbol."""
    return F.concat_ws("_", F.nullif(F.regexp_replace(name, r"\s+", "_"), F.lit("")), uuid)


def store_of_module(module: Column) -> Column:
    """The store that a module belongs to."""
    return F.when(module.isin("Honour", "HonourX"), "honour").otherwise("base")


def cost_option(kind: Column, name: Column, label: Column, most: Column) -> Column:
    """A resource row as an option; null without a name, its label the name where empty."""
    return F.when(F.coalesce(name, F.lit("")) != "", F.struct(kind.alias("kind"), name.alias("name"), F.coalesce(_filled(label), name).alias("label"), most.try_cast("int").alias("most")))
