"""Which table a column refers to: by table and column, by node, or by the column's name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Targets (region, or region and node) with their key, and the columns that refer to them by name.
BY_NAME: dict[tuple[str, str], tuple[str, ...]] = {
    ("Templates__GameObjects", "MapKey"): (
        "ParentTemplateId", "RootTemplate", "TemplateId", "CharacterTemplateUUID", "RootTemplateId", "DefaultsTemplate", "FemaleRootTemplate", "MaleRootTemplate",
        "DragonbornFemaleRootTemplate", "DragonbornMaleRootTemplate", "EquipmentTemplate", "ProjectileTemplateId",
    ),
    ("PhysicsBank__Resource", "ID"): ("PhysicsTemplate",),
    ("Races__Race", "UUID"): ("RaceUUID", "SubRaceUUID", "DisplayTypeUUID"),
    ("ClassDescriptions__ClassDescription", "UUID"): ("ClassUUID", "SubclassUUID", "PreferredClassUUID", "ClassId", "DummyClass"),
    ("Backgrounds__Background", "UUID"): ("BackgroundUUID",),
    ("Progressions__Progression", "TableUUID"): ("ProgressionTableUUID", "ProgressionTableId", "TableUUID"),
    ("Progressions__Progression", "UUID"): ("ProgressionId",),
    ("Feats", "UUID"): ("FeatId",),
    ("Gods__God", "UUID"): ("GodUUID",),
    ("Origins__Origin", "UUID"): ("OriginUUID", "ExcludesOriginUUID"),
    ("Tags__Tags", "UUID"): ("TagUUID",),
    ("SpellLists", "UUID"): ("SpellList",),
    ("CharacterCreationAppearanceVisuals__CharacterCreationAppearanceVisual", "UUID"): ("HeadAppearanceUUID",),
    ("CharacterCreationVOLines", "UUID"): ("VOLinesTableUUID",),
    ("SpeakerGroups", "UUID"): ("SpeakerUUID",),
    ("Flags", "UUID"): ("FlagUUID",),
    ("GoldValues", "UUID"): ("ValueUUID",),
    ("ExperienceRewards", "UUID"): ("ExperienceReward", "ExplorationReward"),
    ("ActionResourceDefinitions", "UUID"): ("ActionResource",),
    ("DeathEffects", "UUID"): ("DeathEffect",),
    ("DifficultyClasses", "UUID"): ("DisarmDifficultyClassID", "LockDifficultyClassID"),
    ("EquipmentTypes", "UUID"): ("EquipmentTypeID",),
    ("FactionContainer", "UUID"): ("Faction",),
    ("RulesetModifiers", "UUID"): ("Modifier",),
    ("Rulesets", "UUID"): ("Ruleset", "Rulesets"),
    ("ShortNameCategories", "UUID"): ("CategoryGuid",),
    ("MultiEffectInfos__MultiEffectInfos", "UUID"): ("CastEffect", "PrepareEffect", "MixedEffect", "NegativeEffect", "PositiveEffect"),
    ("stats:SpellData", "_entry_name"): ("RootSpellID", "ConcentrationSpellID"),
}
#: Keys of their own table, columns that refer to it, and names that look like references but resolve nowhere.
OWN_KEYS = ("UUID", "MapKey")
TO_SELF = ("ParentUUID", "ParentGuid")
NOWHERE = ("GlobalTemplate", "VisualTemplate", "MaterialPresetUUID", "ActiveMaterialPresetUUID", "InactiveMaterialPresetUUID", "CharacterCreationPose", "VoiceTableUUID")
#: Nodes whose Object column refers to a target.
BY_NODE: dict[str, tuple[str, ...]] = {
    "Tags__Tags": ("Tags", "Tag", "ExcludedTags", "TagsFilter", "TagsAdd", "TagsRemove", "ReallyTags", "AppearanceTags", "InteractionFilter"),
    "Gods__God": ("ExcludedGods", "Gods"),
    "ClassDescriptions__ClassDescription": ("SubClass",),
    "CharacterCreationSharedVisuals": ("VisualUUIDs", "Visuals"),
    "CharacterCreationAccessorySets__CharacterCreationAccessorySet": ("AccessorySetUUIDs",),
    "CharacterCreationAppearanceMaterials": ("AppearanceMaterialUUIDs", "ColorMaterialUUIDs"),
    "CrowdCharacterMaterialPresets": ("ClothsColors", "ClothsPatterns"),
    "CharacterCreationEyeColors": ("EyeColors",),
    "CharacterCreationSkinColors": ("SkinColors",),
    "CharacterCreationHairColors": ("HairColors",),
    "ColorDefinitions": ("HairGrayingColors", "HairHighlightColors", "HornColors", "HornTipColors", "LipsMakeupColors", "MakeupColors", "TattooColors"),
    "EmoteAnimations": ("AnimationsList",),
    "EmotePoses": ("PosesList",),
    "FaceExpressions__FaceExpression": ("FaceExpressionsList",),
    "ScriptMaterialOverrideParameters": ("ParameterUUIDs",),
    "TadpolePowersTree__TadpolePowerNode": ("PrerequisiteUUIDs",),
}
#: Columns of single tables that refer to a target.
BY_TABLE: dict[str, dict[str, tuple[str, ...]]] = {
    "FactionContainer": {"FactionManager": ("Source", "Target")},
    "DisturbanceProperties": {"Crime__Property": ("Properties",)},
    "Origins__Origin": {"Reactions": ("id",)},
    "Tags__Tags": {f"MultiEffectInfos__{n}": ("Value",) for n in ("SourceIgnoreTag", "SourceTag", "TargetIgnoreTag", "TargetTag")},
    "MultiEffectInfos__MultiEffectInfos": {
        "DeathEffects": ("Acid", "Chasm", "CinematicDeath", "Cold", "Disintegrate", "DoT", "Electrocution", "Explode", "Fallback", "Falling", "Incinerate", "KnockedDown", "Lifetime", "Necrotic", "Physical", "Psychic", "Radiant"),
    },
}
UNRESOLVED, SELF = "unresolved", "self"

_NAMES = {n.lower(): target for target, names in BY_NAME.items() for n in names} | {n.lower(): (SELF, "UUID") for n in TO_SELF} | {n.lower(): (UNRESOLVED, "") for n in NOWHERE}
_NODES = {n: target for target, nodes in BY_NODE.items() for n in nodes}
_TABLES = {(t, c): target for target, tables in BY_TABLE.items() for t, columns in tables.items() for c in columns}


def by_name(column: str, domain: str) -> tuple[str, str] | None:
    """(target, key) by a column's name in any case; a name that ends with UUID, or for guids with Template, resolves nowhere."""
    low = column.lower()
    if low in (k.lower() for k in OWN_KEYS) or domain not in ("guid", "FixedString"):
        return None
    if low in _NAMES:
        return _NAMES[low]
    return (UNRESOLVED, "") if column.endswith("UUID") or low.endswith("template") and domain == "guid" else None


def target(table: str, node: str | None, column: str, domain: str) -> tuple[str, str] | None:
    """The first rule that fits: of the table's column, of the node's Object column, of the column's name.  ``table`` has no source prefix."""
    if (table, column) in _TABLES:
        return _TABLES[table, column], "UUID"
    if column == "Object" and node in _NODES:
        return _NODES[node], "UUID"
    return by_name(column, domain)


def target_column(table: Column, node: Column, column: Column, domain: Column) -> Column:
    """The same as a Column: ``target.key``, unresolved, self.UUID, or null."""
    literal = lambda d: F.create_map(*[F.lit(x) for k, v in d.items() for x in (k, v)])
    own = F.try_element_at(literal({f"{t}.{c}": f"{v}.UUID" for (t, c), v in _TABLES.items()}), F.concat_ws(".", table, column))
    at_node = F.when(column == "Object", F.try_element_at(literal({n: f"{v}.UUID" for n, v in _NODES.items()}), node))
    named = F.try_element_at(literal({n: f"{t}.{k}" if k else t for n, (t, k) in _NAMES.items()}), F.lower(column))
    loose = F.when(column.endswith("UUID") | (F.lower(column).endswith("template") & (domain == "guid")), F.lit(UNRESOLVED))
    fits = domain.isin("guid", "FixedString") & ~F.lower(column).isin(*[k.lower() for k in OWN_KEYS])
    return F.coalesce(own, at_node, F.when(fits, F.coalesce(named, loose)))
