"""Summaries: sections, inferred schemas, anchors, groups, roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def section_counts(df: DataFrame, group: Sequence[str], new: Column, modified: Column, deleted: Column) -> DataFrame:
    """Per group: total, live, new, modified and deleted rows."""
    def n(c: Column) -> Column:
        return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")

    return df.groupBy(*group).agg(F.count("*").alias("total"), n(~deleted).alias("live"), n(new).alias("new"), n(modified & ~new).alias("modified"), n(deleted).alias("deleted"))


def infer_schema(df: DataFrame, node: str, attributes: str, most_examples: int = 5) -> DataFrame:
    """Per node and attribute of a map column: frequency (share of the node's rows), number and least distinct examples."""
    totals = df.groupBy(node).agg(F.count("*").alias("total"))
    fields = df.select(node, F.explode(attributes).alias("attribute", "value"))
    # Counting (node, attribute, value) first bounds what an example list can gather from a task.
    values = fields.groupBy(node, "attribute", "value").agg(F.count("*").alias("n"))
    shown = F.slice(F.array_sort(F.collect_set(F.when(F.col("value") != "", F.col("value")))), 1, most_examples)
    rank = F.dense_rank().over(Window.partitionBy(node, "attribute").orderBy(F.when(F.col("value") != "", 0).otherwise(1), "value"))
    ranked = values.withColumn("__r", rank)
    grouped = ranked.where(F.col("__r") <= most_examples).groupBy(node, "attribute").agg(shown.alias("examples"))
    counts = values.groupBy(node, "attribute").agg(F.sum("n").alias("n"))
    return counts.join(grouped, [node, "attribute"]).join(totals, node).withColumn("frequency", F.round(F.col("n") / F.col("total"), 6)).drop("total")


def anchors(df: DataFrame, group: Sequence[str], key: str, threshold: int) -> DataFrame:
    """Groups of equal change sets with at least ``threshold`` members and the lines an anchor saves."""
    found = df.groupBy(*group).agg(F.count("*").alias("n"), F.min(key).alias("first_key")).where(F.col("n") >= threshold)
    return found.withColumn("lines_saved", F.greatest(F.lit(0), 6 * F.col("n") - (6 + 2 * F.col("n"))))


def alphabet_bucket(name: Column) -> Column:
    """First letter in upper case; anything else is # (sorted last by bucket_order)."""
    first = F.upper(F.substring(name, 1, 1))
    return F.when(first.rlike("^[A-Z]$"), first).otherwise(F.lit("#"))


def bucket_order(bucket: Column) -> Column:
    return F.when(bucket == "#", 1).otherwise(0)


def level_bucket(level: Column, label: Column) -> Column:
    """The level attribute, else a number after "Lv" or "Level" in the label, else -1."""
    return F.coalesce(level.try_cast("int"), F.regexp_extract(label, r"(?i)\b(?:lv|level)\s*([0-9]+)", 1).try_cast("int"), F.lit(-1))


def tag_bucket(added: Column, new: Column) -> Column:
    """ADDED, NEW or AUTO."""
    return F.when(added, "ADDED").when(new, "NEW").otherwise("AUTO")


def roll_up(leaves: DataFrame, path: str, value: str, separator: str = "/") -> DataFrame:
    """(folder, total): values summed over every ancestor folder of a path."""
    parts = F.split(F.col(path), separator)
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), separator))
    return leaves.groupBy(path).agg(F.sum(value).alias(value)).select(F.explode(folders).alias("folder"), value).groupBy("folder").agg(F.sum(value).alias("total"))


def path_sections(df: DataFrame, path: str, sections: dict[str, str]) -> DataFrame:
    """(section, files): files by recognised path pattern; a file may count in several."""
    hits = F.array_compact(F.array(*[F.when(F.col(path).rlike(p), F.lit(s)) for s, p in sections.items()]))
    return df.select(F.explode(hits).alias("section")).groupBy("section").agg(F.count("*").alias("files"))


def source_summary(df: DataFrame, source: str, file: str) -> DataFrame:
    """Rows, files and rows a file of each source, largest first."""
    out = df.groupBy(source).agg(F.count("*").alias("rows"), F.count_distinct(file).alias("files"))
    return out.withColumn("average", F.round(F.col("rows") / F.col("files"), 2)).orderBy(F.col("rows").desc(), source)


def concatenated(df: DataFrame, group: Sequence[str], order: str, content: str, separator: str = "\n") -> DataFrame:
    """Contents of each group as one text in order, with the number of parts."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(content).alias("c"))))
    return df.groupBy(*group).agg(F.array_join(F.transform(parts, lambda x: x["c"]), separator).alias(content), F.count("*").alias("parts"))


def largest(df: DataFrame, column: str) -> DataFrame:
    """One row (most): the largest value, 0 without rows."""
    return df.agg(F.coalesce(F.max(column), F.lit(0)).alias("most"))


def list_type_bucket(node: Column) -> Column:
    """The node id, blank as Other."""
    return F.coalesce(F.nullif(node, F.lit("")), F.lit("Other"))


def pattern_bucket(name: Column, buckets: Sequence[tuple[str, str]], other: str = "Other") -> Column:
    """The first bucket whose pattern fits."""
    out = F.lit(other)
    for pattern, bucket in reversed(buckets):
        out = F.when(name.rlike(pattern), F.lit(bucket)).otherwise(out)
    return out


def grouped(df: DataFrame, bucket: Column, key: str) -> DataFrame:
    """(key, n, entries): the keys of each bucket in order."""
    return df.groupBy(bucket.alias("key")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(key)).alias("entries"))


def total_length(listing: DataFrame, folder: str) -> DataFrame:
    """(folder, bytes): sizes of the files of a listing."""
    return listing.groupBy(folder).agg(F.sum("length").alias("bytes"))
