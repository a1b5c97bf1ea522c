"""Choice lists: ranked unions of baseline, package and further sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratawise.operators.precedence import first_wins, ranked_union


def guid_like(label: Column) -> Column:
    return label.rlike("^[0-9a-fA-F]{8}-")


def sort_options(df: DataFrame, label: str = "label", key: str = "id") -> DataFrame:
    """Unnamed and guid-like labels last, then by locale without case and accents, then by key."""
    last = F.coalesce(F.col(label), F.lit("")).isin("", "Unnamed") | guid_like(F.col(label))
    return df.orderBy(last, F.collate(F.col(label), "UNICODE_CI_AI"), key)


def section_options(primary: DataFrame, baseline: DataFrame, further: Sequence[DataFrame] = (), nodes: Sequence[str] | None = None) -> DataFrame:
    """(id, label, source): the package overwrites the baseline, further packages add what is unseen."""
    found = ranked_union([("package", primary), ("baseline", baseline), *[(f"other{i}", d) for i, d in enumerate(further)]], tag="source")
    if nodes is not None:
        found = found.where(F.col("node_id").isin(list(nodes)))
    return sort_options(first_wins(found.where("id <> ''"), ["id"], [F.col("_rank"), F.col("label")]).select("id", F.coalesce(F.nullif("label", F.lit("")), F.lit("Unnamed")).alias("label"), "source"))


def tag_options(vanilla: DataFrame, entries: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Vanilla tags, then ids seen in child groups (a map group → ids), first wins."""
    seen = entries.select(F.explode("children").alias("group", "ids")).where(F.col("group").isin(list(groups))).select(F.explode("ids").alias("id")).distinct().withColumn("label", F.col("id"))
    return sort_options(first_wins(ranked_union([("vanilla", vanilla.select("id", "label")), ("seen", seen)]), ["id"], [F.col("_rank")]).select("id", "label"))


def child_options(vanilla: DataFrame, packages: Sequence[DataFrame], group: str, node: str | None = None, section: str = "Races") -> DataFrame:
    """(id, label) for one child group: baseline rows (id, display, node_id), of one node if asked for, as
    ``[display] id``, then ids that entries (section, children: group → ids) of the packages have, first wins."""
    base = vanilla.where(F.col("node_id") == node) if node else vanilla
    sources = [("vanilla", base.select("id", F.concat(F.lit("["), F.coalesce("display", F.lit("")), F.lit("] "), "id").alias("label")))]
    for i, entries in enumerate(packages):
        ids = entries.where(F.col("section") == section).select(F.explode(F.try_element_at("children", F.lit(group))).alias("id")).distinct()
        sources.append((str(i), ids.withColumn("label", F.col("id"))))
    return first_wins(ranked_union(sources), ["id"], [F.col("_rank"), F.col("label")]).select("id", "label")


def names_union(sources: Sequence[DataFrame], column: str) -> DataFrame:
    """Sorted distinct names of all sources."""
    return ranked_union([(str(i), d.select(column)) for i, d in enumerate(sources)]).select(column).where(F.col(column) != "").distinct().orderBy(column)


def prefixed(df: DataFrame, prefix: str, label: str = "label") -> DataFrame:
    return df.where(F.upper(label).startswith(prefix.upper()))


def cost_options(vanilla: DataFrame, resources: DataFrame, groups: DataFrame) -> DataFrame:
    """Overlay by key without case; a deleted row of a later layer removes the key."""
    layers = ranked_union([("vanilla", vanilla.withColumn("_is_deleted", F.lit(0))), ("resource", resources), ("group", groups)], tag="layer")
    top = first_wins(layers.withColumn("__k", F.lower("name")), ["__k"], [F.col("_rank").desc(), F.col("name")])
    return top.where("_is_deleted = 0").drop("__k", "_rank", "_is_deleted")


def dependent_visible(gates: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """A field shows while every gate (sibling column, allowed values) holds."""
    out = F.lit(True)
    for column, allowed in gates:
        out = out & F.coalesce(F.col(column).isin(list(allowed)), F.lit(False))
    return out


def discovered_sections(sections: DataFrame, known: Sequence[str], buckets: Sequence[tuple[str, str]]) -> DataFrame:
    """Sections with columns that aren't known, each in the first bucket whose pattern fits, by label."""
    bucket = F.lit("Other")
    for pattern, name in reversed(buckets):
        bucket = F.when(F.col("section").rlike(pattern), F.lit(name)).otherwise(bucket)
    return sections.where(~F.col("section").isin(list(known) or [""]) & (F.col("n_columns") > 0)).withColumn("bucket", bucket).orderBy("section")
