"""Schemas found in a node table, and the tables made from it."""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratawise.functions.text import sanitize_id
from stratawise.functions.values import coerce, null_key
from stratawise.operators.precedence import first_wins, synthetic_key
from stratawise.plans.references import SELF, target
from stratawise.plans.registry import KEY_COLUMNS, Reference, Registry, TableSchema, checked_name

def key_strategy(source_type: str, columns: set[str], nested: bool) -> str:
    """How rows of a table are told apart."""
    if source_type == "loca":
        return "contentuid"
    if source_type == "stats":
        return "entry_name"
    if "MapKey" in columns:
        return "map_key"
    if "UUID" in columns and not nested:
        return "uuid"
    return "id" if "ID" in columns else "row_id"


def discover(nodes: DataFrame) -> Registry:
    """One table a region and node, with the union of its columns.

    Two aggregations come to the driver: a row for each column of each table and one for
    each parent-child pair, both bounded by the schema.  The first-seen type, by path and
    ordinal, wins.  Regions with a single node drop the node from the table's name.
    """
    real = nodes.where("error is null AND node_id <> 'root'")
    attrs = real.select("region", "node_id", "path", "node_ord", "depth", F.explode("attrs").alias("column", "a"))
    seen = attrs.groupBy("region", "node_id", "column").agg(F.min_by(F.col("a.type"), F.struct("path", "node_ord")).alias("type"), F.min("depth").alias("depth")).collect()
    bare = real.groupBy("region", "node_id").agg(F.min("depth").alias("depth")).collect()
    up = real.select("path", F.col("node_ord").alias("parent_ord"), F.col("node_id").alias("parent_id"))
    pairs = [tuple(r) for r in real.join(up, ["path", "parent_ord"]).select("region", "parent_id", "node_id").distinct().collect()]
    by_region = defaultdict(set)
    for r in bare:
        by_region[r["region"]].add(r["node_id"])
    clean = lambda s: re.sub("[^A-Za-z0-9_]", "_", s)
    full = {(g, n): f"tree__{clean(g)}__{clean(n)}" for g, ns in by_region.items() for n in ns}
    name = {k: (f"tree__{clean(k[0])}" if len(by_region[k[0]]) == 1 else v) for k, v in full.items()}
    registry = Registry(renames={full[k]: name[k] for k in full if full[k] != name[k]})
    columns: dict[tuple, dict[str, str]] = defaultdict(dict)
    for r in sorted(seen, key=lambda r: r["column"]):
        columns[r["region"], r["node_id"]].setdefault(clean(r["column"]), r["type"] or "FixedString")
    parents = defaultdict(set)
    for g, p, n in pairs:
        parents[g, n].add(name[g, p])
    for k in sorted(name, key=str):
        own = columns[k]
        registry.tables[name[k]] = TableSchema(checked_name(name[k]), "tree", k[0], k[1], key_strategy("tree", set(own), bool(parents[k])), dict(own), [], sorted(parents[k]))
    for k, ps in sorted(parents.items(), key=str):
        for p in sorted(ps):
            registry.links[p, name[k]] = f"{p}__to__{name[k].rsplit('__', 1)[-1]}"
    for t in registry.tables.values():
        t.references = references(t, registry)
    return registry


def references(table: TableSchema, registry: Registry) -> list[Reference]:
    """What the reference rules say of each column, where the target is a known table that has the key."""
    out = []
    for column, domain in sorted(table.columns.items()):
        rule = target(table.name.removeprefix("tree__"), table.node, column, domain)
        if rule is None:
            continue
        name, key = rule
        if name == SELF:
            found = table
        else:
            found = registry.resolve(name.replace(":", "__") if ":" in name else f"tree__{name}")
        if found and (key == found.key or key in found.columns) and (found is not table or column != key):
            out.append(Reference(column, found.name, key))
    return out


def materialize(nodes: DataFrame, registry: Registry, files: DataFrame) -> dict[str, DataFrame]:
    """Every table of the registry from one node table: typed columns, raw texts beside them where a
    value doesn't parse, first row of a key by file priority.  ``files`` has path, file_id, priority, module.

    A parent that loses its key takes its subtree along: rows keep the ordinal of their instance and
    only instances whose top row survived are kept."""
    known = nodes.where("error is null AND node_id <> 'root' AND NOT commented").join(files.select("path", "file_id", "priority", "module"), "path")
    out: dict[str, DataFrame] = {}
    for t in registry.tables.values():
        rows = known.where((F.col("region") == t.region) & (F.col("node_id") == t.node))
        text = lambda c: F.coalesce(F.nullif(F.element_at("attrs", c)["handle"], F.lit("")), F.element_at("attrs", c)["value"])
        refs = {r.column for r in t.references}
        columns = []
        for name, domain in sorted(t.columns.items()):
            value = null_key(text(name)) if name in refs else text(name)
            typed, raw = coerce(value, domain)
            columns.append(typed.alias(name))
            if domain not in ("bool",) and typed is not value:
                columns.append(raw.alias(f"_raw_{name}"))
        key = F.coalesce(F.nullif(text(KEY_COLUMNS[t.strategy]), F.lit("")), synthetic_key(F.col("path"), F.col("node_ord"))) if t.strategy != "row_id" else synthetic_key(F.col("path"), F.col("node_ord"))
        own = rows.select(key.alias("_key"), F.col("file_id").alias("_file_id"), F.col("module").alias("_source"), "priority", "path", "node_ord", "root_ord", *columns)
        out[t.name] = first_wins(own, ["_key"], [F.col("priority").desc(), F.col("_file_id"), F.col("node_ord")]) if t.strategy != "row_id" else own
    tops = None
    for t in registry.tables.values():
        if not t.parents:
            own = out[t.name].select("path", "root_ord")
            tops = own if tops is None else tops.union(own)
    return {name: (df.join(tops.distinct(), ["path", "root_ord"], "left_semi") if registry.tables[name].parents and tops is not None else df).drop("priority", "path", "node_ord", "root_ord") for name, df in out.items()}


def metadata(registry: Registry, tables: dict[str, DataFrame]) -> list[dict]:
    """Name, source, region, node, parents and true row count of each table."""
    return [{"table_name": t.name, "source_type": t.source_type, "region_id": t.region, "node_id": t.node, "parent_tables": ",".join(t.parents), "row_count": tables[t.name].count()} for t in registry.tables.values()]


def source_ids(df: DataFrame, module: str = "module") -> DataFrame:
    """Dense ids of module names, from the distinct names only."""
    names = df.select(module).where(F.col(module).isNotNull()).distinct()
    return names.withColumn("id", F.row_number().over(Window.orderBy(module)))


def column_name(column):
    return sanitize_id(column)
