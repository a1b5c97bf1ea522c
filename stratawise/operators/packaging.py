"""Path rewrites and merges before packaging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratawise.operators.aggregate import concatenated

#: Folders whose ``Name.TYPE.lsx`` files fold into ``TYPE.lsx``, and the types each takes.
REGION_FOLDERS = {
    "ActionResourceDefinitions": "ActionResourceDefinitions", "ClassDescriptions": "ClassDescriptions", "Lists": r"\w*Lists", "Progressions": "Progressions|ProgressionDescriptions", "Races": "Races",
}


def fixed_extension(path: Column) -> Column:
    """A doubled binary extension becomes a single one."""
    return F.regexp_replace(path, r"(\.lsfx?)\1$", "$1")


def flattened(path: Column) -> Column:
    """Sub-folders below MultiEffectInfos go."""
    return F.regexp_replace(path, r"(?i)(/multieffectinfos/)(?:[^/]+/)+([^/]+)$", "$1$2")


def region_type(path: Column) -> Column:
    """The type in ``Name.TYPE.lsx`` under a folder that takes it, else null."""
    out = F.lit(None).cast("string")
    for folder, types in REGION_FOLDERS.items():
        found = F.regexp_extract(path, rf"/{folder}/[^/]*\.({types})\.lsx$", 1)
        out = F.coalesce(out, F.nullif(found, F.lit("")))
    return out


def region_target(path: Column) -> Column:
    """Where a file's nodes go: ``TYPE.lsx`` in its folder, or the file itself."""
    kind = region_type(path)
    return F.when(kind.isNotNull(), F.concat(F.regexp_extract(path, r"^(.*/)[^/]*$", 1), kind, F.lit(".lsx"))).otherwise(path)


def template_target(path: Column) -> Column:
    """All files under one RootTemplates folder go to its ``_merged.lsf``."""
    base = F.regexp_extract(path, r"(?i)^(.*/roottemplates/)", 1)
    return F.when(base != "", F.concat(base, F.lit("_merged.lsf"))).otherwise(path)


def stats_category(path: Column) -> Column:
    """The category folder below Stats/Generated/Data, null for files directly in it."""
    return F.nullif(F.regexp_extract(path, r"(?i)/stats/generated/data/([^/]+)/.*\.txt$", 1), F.lit(""))


def rewrites(files: DataFrame) -> DataFrame:
    """(path, target, rule): the first rule that moves a file; files of one target are merged in path order."""
    p = F.col("path")
    rules = [("extension", fixed_extension(p)), ("effects", flattened(p)), ("templates", template_target(p)), ("regions", region_target(p))]
    rule, target = F.lit(None).cast("string"), p
    for name, to in reversed(rules):
        rule, target = F.when(to != p, F.lit(name)).otherwise(rule), F.when(to != p, to).otherwise(target)
    return files.withColumns({"target": target, "rule": rule})


def collisions(planned: DataFrame) -> DataFrame:
    """Targets that several files reach by a rule that only renames."""
    return planned.where("rule IN ('extension', 'effects') OR rule IS NULL").groupBy("target").agg(F.count("*").alias("n")).where("n > 1")


def merged_stats(files: DataFrame) -> DataFrame:
    """(base, category, text, parts): texts of each category with two files or more, each under a comment."""
    base = F.regexp_extract("path", r"(?i)^(.*/stats/generated/data/)", 1)
    own = files.withColumns({"base": base, "category": stats_category(F.col("path"))}).where("category is not null")
    headed = own.withColumn("text", F.concat(F.lit("// "), F.regexp_extract("path", r"([^/]+)$", 1), F.lit("\n"), F.col("text")))
    return concatenated(headed, ["base", "category"], "path", "text", "\n\n").where("parts >= 2")


def becomes_binary(path: Column) -> Column:
    """Whether a tree file is stored as binary when packaged."""
    return F.lower(path).rlike(r"\.lsf\.lsx$|/roottemplates/.*\.lsx$|/content/.*\.lsx$")
