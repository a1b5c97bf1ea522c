"""Lookups over discovered tables: entries, pages, lists, options, atlases."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratawise.functions import text as T
from stratawise.operators.precedence import first_wins, ranked_union


def page(df: DataFrame, order: Sequence[Column | str], offset: int = 0, limit: int = 0) -> DataFrame:
    """Rows offset.. in order; limit 0 is all of them."""
    out = df.orderBy(*order)
    out = out.offset(max(0, offset)) if offset > 0 else out
    return out.limit(limit) if limit > 0 else out


def page_with_total(df: DataFrame, order: Sequence[Column | str], offset: int = 0, limit: int = 0) -> tuple[DataFrame, int]:
    """A page and the number of all rows; an offset beyond the end gives an empty page."""
    total = df.count()
    return page(df, order, min(max(0, offset), total), limit), total


def display_name(*candidates: Column, key: Column) -> Column:
    """The first candidate that is neither null nor empty, else the key."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], key)


def section_entries(df: DataFrame, key: str, display: str | None = None, name: str | None = None, level: str | None = None, comment: str | None = None, color: str | None = None, parent: str | None = None) -> DataFrame:
    """(uuid, display, color, parent_id) of a table; absent columns count as null."""
    k = F.col(key).cast("string")
    col = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    levelled = F.when((F.coalesce(col(name), F.lit("")) != "") & col(level).isNotNull(), F.concat(col(name), F.lit(" Lv"), col(level)))
    shown = F.substring_index(col(display), ";", 1)
    return df.select(
        k.alias("uuid"), display_name(shown, levelled, col(name), col(comment), key=k).alias("display"),
        T.bgra_to_rgba(col(color)).alias("color"), F.nullif(col(parent), F.lit("")).alias("parent_id"),
    )


def entries_by_folder(df: DataFrame, key: str, names: Sequence[str], colors: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key with the first present name and colour."""
    pick = lambda cs: F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in cs], F.lit(None).cast("string"))
    return first_wins(df, [key], order).select(key, pick(names).alias("name"), pick(colors).alias("color"))


def list_items(df: DataFrame, key: str, columns: Sequence[str], delimiter: str = ";", keys: Sequence | None = None) -> DataFrame:
    """The first non-empty list column of each row, split, trimmed, blanks dropped: (key, source, pos, item)."""
    df = df.where(F.col(key).isin(list(keys))) if keys is not None else df
    filled = F.coalesce(*[F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) != "", F.struct(F.lit(c).alias("source"), F.col(c).alias("value"))) for c in columns])
    return df.select(key, filled.alias("f")).where("f is not null").select(key, F.col("f.source").alias("source"), F.posexplode(T.split_delimited(F.col("f.value"), delimiter)).alias("pos", "item"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values that are neither null nor empty."""
    return df.select(F.col(column)).where(F.coalesce(F.col(column).cast("string"), F.lit("")) != "").distinct().orderBy(column)


def value_lists(df: DataFrame, key: str, index: str, value: str, only: str | None = None) -> DataFrame:
    """Values of each key as one array in index order."""
    df = df.where(F.col(key) == only) if only is not None else df
    ordered = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(value).alias("v"))))
    return df.groupBy(key).agg(F.transform(ordered, lambda x: x["v"]).alias("items"))


def field_map(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Each row as (key, fields): column name to text, nulls left out."""
    pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c).cast("string") for c in columns]))
    return df.select(key, F.map_filter(pairs, lambda _, v: v.isNotNull()).alias("fields"))


def unpivot_fields(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, field, value) rows, nulls left out."""
    return field_map(df, key, columns).select(key, F.explode("fields").alias("field", "value"))


def tagged_options(sources: Sequence[tuple[str, DataFrame]], label: Sequence[str], name: str) -> DataFrame:
    """Sources united with a kind tag; label is the first present column; sorted without regard to case."""
    both = ranked_union(sources, tag="kind").drop("_rank")
    shown = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in label], F.col(name))
    return both.withColumn("label", shown).orderBy("kind", F.lower("label"), F.lower(name), name)


def first_then_join(df: DataFrame, key: str, order: Sequence[Column], lookup: DataFrame, lookup_order: Sequence[Column], on: str) -> DataFrame:
    """First row of each key, then the match test: a first row without a match hides later ones."""
    return first_wins(df, [key], order).join(first_wins(lookup, [on], lookup_order), on)


def with_children(parents: DataFrame, children: DataFrame, key: str, child_key: str, order: str) -> DataFrame:
    """Parents with their number of children and their ids in order."""
    grouped = children.groupBy(key).agg(F.count("*").alias("n_children"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(child_key).alias("c")))).alias("__c"))
    joined = parents.join(grouped.select(key, "n_children", F.transform("__c", lambda x: x["c"]).alias("children")), key, "left")
    return joined.withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def available_sections(tables: DataFrame, links: DataFrame) -> DataFrame:
    """Top-level tables (no link's child) with the number of child tables and child rows."""
    info = tables.select(F.col("table_name").alias("child"), "row_count")
    counted = links.join(info, "child", "left").groupBy("parent").agg(F.count("*").alias("n_children"), F.sum(F.coalesce("row_count", F.lit(0))).alias("child_rows"))
    top = tables.join(links.select(F.col("child").alias("table_name")).distinct(), "table_name", "left_anti")
    joined = top.join(counted.withColumnRenamed("parent", "table_name"), "table_name", "left")
    return joined.na.fill(0, ["n_children", "child_rows"])


def first_match_or(left: DataFrame, known: DataFrame, pairs: Sequence[tuple[str, str]], left_key: str, order: str) -> DataFrame:
    """Left rows with the first known row, by ``order``, equal in any of the column pairs; unmatched kept.

    Each pair is an equi-join of its own, so no condition forces a nested loop.  Of equal known rows only the
    first can be an answer, so a value gives one row however often both sides have it.
    """
    hits = None
    for a, b in pairs:
        least = first_wins(known.withColumn("__v", F.col(b)).where("__v is not null"), ["__v"], [F.col(order)])
        one = left.select(left_key, F.col(a).alias("__v")).join(least, "__v").drop("__v")
        hits = one if hits is None else hits.unionByName(one)
    return left.join(first_wins(hits, [left_key], [F.col(order)]), left_key, "left")


def resolve_handle(df: DataFrame, column: str, tables: Sequence[DataFrame], handle: str = "handle", text: str = "text") -> DataFrame:
    """Adds ``resolved``: the text of the first table that has a non-empty one, else the raw value.

    Pipes are stripped from the value before the lookup."""
    out, found = df.withColumn("__h", F.replace(F.col(column), F.lit("|"), F.lit(""))), []
    for i, t in enumerate(tables):
        one = first_wins(t, [handle], [F.col(text)]).select(F.col(handle).alias("__h"), F.nullif(F.col(text), F.lit("")).alias(f"__t{i}"))
        out = out.join(one, "__h", "left")
        found.append(F.col(f"__t{i}"))
    return out.withColumn("resolved", F.coalesce(*found, F.col(column))).drop("__h", *[f"__t{i}" for i in range(len(tables))])


def stat_entries(tables: Sequence[tuple[str, DataFrame]], entry_type: str | None = None, name: str = "_entry_name") -> DataFrame:
    """(name, type) over all or one of the stats tables, sorted by name."""
    chosen = [(t, df.select(F.col(name).alias("name"))) for t, df in tables if entry_type is None or t == entry_type]
    if not chosen:
        raise ValueError(f"no table of type {entry_type}")
    return ranked_union(chosen, tag="type").drop("_rank").orderBy("name", "type")


def stat_field_names(frames: Sequence[DataFrame], internal: Sequence[str] = ("_file_id", "_SourceID", "_entry_name", "_type", "_using")) -> list[str]:
    """Sorted distinct column names without internal and version columns; no job runs."""
    return sorted({c for df in frames for c in df.columns if c not in internal and not c.endswith("_version")})


def raw_rows(df: DataFrame, key: str) -> DataFrame:
    """(key, attributes): text of every column that doesn't begin with _, null as empty."""
    columns = [c for c in df.columns if not c.startswith("_")]
    return df.select(key, F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])).alias("attributes"))


def preview(df: DataFrame, key: str, node: str) -> DataFrame:
    """(uuid, node_id, attributes): a row's filled columns as texts, but for internal ones."""
    fields = F.create_map(*[x for n in df.columns if not n.startswith("_") for x in (F.lit(n), F.col(f"`{n}`").cast("string"))])
    return df.select(F.col(key).alias("uuid"), F.lit(node).alias("node_id"), F.map_filter(fields, lambda _, v: v.isNotNull()).alias("attributes"))


def matches(text: Column, query: str) -> Column:
    """Case-insensitive substring test."""
    return F.contains(F.lower(text), F.lit(query.lower()))


def search_tree(paths: DataFrame, query: str, path: str = "path") -> DataFrame:
    """Paths whose own name matches, with every ancestor folder, and all below a folder that matches
    while nothing under it does: (node, matched)."""
    parts = F.split(F.col(path), "/")
    nodes = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("node")).distinct()
    hit = nodes.where(matches(F.element_at(F.split("node", "/"), -1), query))
    up = F.split(F.col("node"), "/")
    chain = hit.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(up)), lambda i: F.array_join(F.slice(up, 1, i), "/"))).alias("node"))
    above = hit.select(F.explode(F.transform(F.filter(F.sequence(F.lit(1), F.size(up)), lambda i: i < F.size(up)), lambda i: F.array_join(F.slice(up, 1, i), "/"))).alias("node")).distinct()
    whole = hit.join(above, "node", "left_anti").select(F.col("node").alias("top"))
    below = nodes.select("node", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("node", "/"))), lambda i: F.array_join(F.slice(F.split("node", "/"), 1, i), "/"))).alias("top")).join(whole, "top").select("node")
    kept = chain.union(below).distinct()
    return kept.join(hit.withColumn("matched", F.lit(True)), "node", "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def existence(tables: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(table_name, has_data): whether a table has a row; one row of each is read at most."""
    parts = [df.limit(1).agg(F.lit(name).alias("table_name"), (F.count("*") > 0).alias("has_data")) for name, df in tables]
    return reduce(DataFrame.union, parts)


def keys_like(df: DataFrame, key: str, pattern: str, deleted: bool = False, changed: bool = False) -> DataFrame:
    """Rows whose key fits a LIKE pattern, live or deleted, and of these only changed ones if asked for."""
    out = df.where(F.col(key).like(pattern) & (F.col("_is_deleted") == int(deleted)))
    return out.where("_is_new = 1 OR _is_modified = 1") if changed else out


def unresolved_requires(scripts: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """(key, target): paths that scripts (key, text) require and that no row of ``known`` (key) names."""
    wanted = F.regexp_extract_all("text", F.lit(r"""\brequire\s*\(\s*["']([^"']+)["']\s*\)"""), 1)
    either = F.regexp_extract_all("text", F.lit(r"""\bRequire\s*\(\s*["']([^"']+)["']\s*\)"""), 1)
    rows = scripts.select(key, F.explode(F.array_distinct(F.concat(wanted, either))).alias("target"))
    return rows.join(known.select(F.col("key").alias("target")).distinct(), "target", "left_anti").select(key, "target")
