"""A change-tracked workspace on immutable files.

Tables carry the flags _is_new, _is_modified and _is_deleted.  A batch is folded per key
in Spark and written as new Parquet folders; one manifest, moved into place last, names the
folders of the current version, so a batch is published whole or not at all.  A journal of
before and after images, split by boundaries, drives undo and redo.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratawise.sources import files

FLAGS = ("_is_new", "_is_modified", "_is_deleted")
#: Ids of a journal that one window counts.
_STRETCH = 100_000
JOURNAL = "id long, label string, table_name string, pk_value string, old_row string, new_row string"


def with_flags(df: DataFrame) -> DataFrame:
    """Missing flag columns added as 0."""
    return df.withColumns({f: F.coalesce(F.col(f), F.lit(0)) if f in df.columns else F.lit(0) for f in FLAGS})


def live(df: DataFrame, include_deleted: bool = False) -> DataFrame:
    return df if include_deleted else df.where("_is_deleted = 0")


def change_label() -> Column:
    """deleted before new before modified; null without a change."""
    return F.when(F.col("_is_deleted") == 1, "deleted").when(F.col("_is_new") == 1, "new").when(F.col("_is_modified") == 1, "modified")


def changes(df: DataFrame) -> DataFrame:
    return df.withColumn("change", change_label()).where("change is not null")


def has_changes(df: DataFrame) -> bool:
    return not changes(df).isEmpty()


def all_deleted(df: DataFrame) -> bool:
    """Whether there are rows and all are deleted; false on an empty table."""
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum("_is_deleted"), F.lit(0)).alias("d")).first()
    return row["n"] > 0 and row["n"] == row["d"]


def fold(table: DataFrame, ops: DataFrame, key: str) -> DataFrame:
    """The table after ordered operations (seq, op, key value, row map).

    upsert inserts a new row or changes a live one (a new row stays new); delete drops a
    new row and flags any other; undelete clears the flag.  Operations on one key are
    folded as an array; a key's operations are one batch's, so the array is bounded by it.
    """
    if missing := {"seq", "op", "key", "row"} - set(ops.columns):
        raise ValueError(f"operations lack {sorted(missing)}")
    data = [c for c in table.columns if c not in (*FLAGS, key)]
    image = F.map_from_arrays(F.array(*[F.lit(c) for c in data]), F.array(*[F.col(c).cast("string") for c in data])) if data else F.create_map().cast("map<string,string>")
    state = table.select(F.col(key).cast("string").alias("__k"), F.struct(F.lit(True).alias("there"), *[F.col(f).cast("int").alias(f) for f in FLAGS], image.alias("row")).alias("s"))
    steps = ops.groupBy(F.col("key").alias("__k")).agg(F.array_sort(F.collect_list(F.struct(F.col("seq").cast("long").alias("seq"), "op", F.coalesce("row", F.create_map().cast("map<string,string>")).alias("row"))), lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)).alias("steps"))
    joined = state.join(steps, "__k", "full")
    nothing = F.struct(F.lit(False).alias("there"), *[F.lit(0).alias(f) for f in FLAGS], F.create_map().cast("map<string,string>").alias("row"))

    def step(s: Column, x: Column) -> Column:
        put, drop, back = x["op"] == "upsert", x["op"] == "delete", x["op"] == "undelete"
        merged = F.map_concat(F.map_filter(s["row"], lambda k, _: ~F.map_contains_key(x["row"], k)), x["row"])
        return (
            F.when(put & ~s["there"], F.struct(F.lit(True).alias("there"), F.lit(1).alias("_is_new"), F.lit(0).alias("_is_modified"), F.lit(0).alias("_is_deleted"), x["row"].alias("row")))
            .when(put, F.struct(F.lit(True).alias("there"), s["_is_new"].alias("_is_new"), F.when(s["_is_new"] == 1, s["_is_modified"]).otherwise(1).alias("_is_modified"), F.lit(0).alias("_is_deleted"), merged.alias("row")))
            .when(drop & s["there"] & (s["_is_new"] == 1), nothing)
            .when(drop & s["there"], F.struct(s["there"].alias("there"), s["_is_new"].alias("_is_new"), s["_is_modified"].alias("_is_modified"), F.lit(1).alias("_is_deleted"), s["row"].alias("row")))
            .when(back & s["there"], F.struct(s["there"].alias("there"), s["_is_new"].alias("_is_new"), s["_is_modified"].alias("_is_modified"), F.lit(0).alias("_is_deleted"), s["row"].alias("row")))
            .otherwise(s)
        )

    empty = F.array().cast("array<struct<seq:bigint,op:string,row:map<string,string>>>")
    folded = joined.select("__k", F.aggregate(F.coalesce("steps", empty), F.coalesce("s", nothing), step).alias("s")).where("s.there")
    typed = {f.name: f.dataType for f in table.schema}
    columns = [F.col("__k").try_cast(typed[key]).alias(key), *[F.element_at("s.row", F.lit(c)).try_cast(typed[c]).alias(c) for c in data], *[F.col(f"s.{f}").cast(typed.get(f, T.IntegerType())).alias(f) for f in FLAGS]]
    return folded.select(*columns).select(*table.columns)


def invalid_operation(ops: DataFrame) -> int | None:
    """The place of the first operation that can't be applied, or None."""
    bad = ops.where(~F.col("op").isin("upsert", "delete", "undelete") | F.col("op").isNull() | F.col("key").isNull()).agg(F.min("seq")).first()
    return bad[0]


# --- journal ----------------------------------------------------------------------------------------


def undo_groups(journal: DataFrame) -> DataFrame:
    """Journal entries with the number of boundaries before them; boundary rows are dropped.

    A boundary is a row without a table.  Ids are cut into stretches: boundaries are counted within
    one by a window, and the counts of the stretches before it come from a window over stretches."""
    own = journal.withColumn("__stretch", F.floor(F.col("id") / _STRETCH))
    bound = F.when(F.col("table_name").isNull(), 1).otherwise(0)
    counts = own.groupBy("__stretch").agg(F.sum(bound).alias("__n"))
    upto = F.sum("__n").over(Window.orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("__stretch", F.coalesce(upto, F.lit(0)).alias("__before"))
    inside = F.sum(bound).over(Window.partitionBy("__stretch").orderBy("id"))
    counted = own.withColumn("undo_group", inside).join(before, "__stretch")
    return counted.withColumn("undo_group", F.col("undo_group") + F.col("__before")).where("table_name is not null").drop("__stretch", "__before")


def compacted(journal: DataFrame, most: int = 500) -> DataFrame:
    """The newest rows."""
    return journal.orderBy(F.col("id").desc()).limit(most)


def images(entries: DataFrame, redo: bool) -> DataFrame:
    """Per (table, key) the image to restore: the first before-image on undo, the last after-image on redo."""
    pick = F.max_by("new_row", "id") if redo else F.min_by("old_row", "id")
    return entries.groupBy("table_name", "pk_value").agg(pick.alias("image"))


def purged(df: DataFrame, column: str, value) -> DataFrame:
    """The rows of all other sources; a null source is none."""
    return df.where(F.col(column).isNull() | (F.col(column) != value))


def row_image(df: DataFrame) -> Column:
    return F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})


class Workspace:
    """Named tables with keys under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @property
    def manifest(self) -> dict:
        found = files.get_json(f"{self.root}/manifest.json")
        if found is None:
            raise FileNotFoundError(f"no workspace at {self.root}")
        return found

    def create(self, tables: dict[str, tuple[DataFrame, str]]) -> None:
        """Tables with their key columns; data frames may be empty."""
        self._publish({"version": 0, "tables": {}, "keys": {n: k for n, (_, k) in tables.items()}, "schemas": {n: with_flags(df).schema.json() for n, (df, _) in tables.items()}, "journal": None, "next_id": 1, "pointer": 0, "meta": {}}, {n: with_flags(df) for n, (df, _) in tables.items()})

    def _publish(self, manifest: dict, new: dict[str, DataFrame], journal: DataFrame | None = None) -> None:
        stamp = f"v={manifest['version']:08d}-{uuid.uuid4().hex[:8]}"
        for name, df in new.items():
            df.write.parquet(f"{self.root}/{stamp}/{name}")
            manifest["tables"][name] = f"{stamp}/{name}"
        if journal is not None:
            journal.coalesce(1).write.parquet(f"{self.root}/{stamp}/_journal")
            manifest["journal"] = f"{stamp}/_journal"
        files.put_json(f"{self.root}/manifest.json", manifest)

    def table(self, name: str) -> DataFrame:
        m = self.manifest
        return self.spark.read.schema(T.StructType.fromJson(json.loads(m["schemas"][name]))).parquet(f"{self.root}/{m['tables'][name]}")

    def journal(self) -> DataFrame:
        at = self.manifest["journal"]
        return self.spark.read.schema(JOURNAL).parquet(f"{self.root}/{at}") if at else self.spark.createDataFrame([], JOURNAL)

    def row(self, name: str, key) -> dict | None:
        found = self.table(name).where(F.col(self.manifest["keys"][name]) == F.lit(key)).limit(1).collect()
        return found[0].asDict() if found else None

    def boundary(self, label: str) -> int:
        """Mark the state to which undo returns; entries that were undone before are forgotten."""
        m = self.manifest
        own = self.spark.createDataFrame([(m["next_id"], label, None, None, None, None)], JOURNAL)
        m |= {"version": m["version"] + 1, "next_id": m["next_id"] + 1, "pointer": m["next_id"]}
        self._publish(m, {}, self.journal().where(F.col("id") <= self.manifest["pointer"]).union(own))
        return m["pointer"]

    def batch(self, operations: dict[str, DataFrame]) -> dict:
        """Apply ordered operations to each table, all or nothing, and journal every changed row."""
        for name, ops in operations.items():
            if (at := invalid_operation(ops)) is not None:
                return {"applied": False, "table": name, "failed": at}
        m, new, entries = self.manifest, {}, None
        for name, ops in operations.items():
            key, old = m["keys"][name], self.table(name)
            new[name] = fold(old, ops, key)
            entries = self._entries(name, key, old, new[name]) if entries is None else entries.union(self._entries(name, key, old, new[name]))
        rows = entries.orderBy("table_name", "pk_value").collect() if entries is not None else []
        journal = self.spark.createDataFrame([(m["next_id"] + i, "batch", *r) for i, r in enumerate(rows)], JOURNAL)
        kept = self.journal().where(F.col("id") <= m["pointer"])
        m |= {"version": m["version"] + 1, "next_id": m["next_id"] + len(rows), "pointer": m["next_id"] + len(rows) - 1}
        self._publish(m, new, kept.union(journal))
        return {"applied": True, "changed": len(rows)}

    @staticmethod
    def _entries(name: str, key: str, old: DataFrame, new: DataFrame) -> DataFrame:
        a = old.select(F.col(key).cast("string").alias("pk_value"), row_image(old).alias("old_row"))
        b = new.select(F.col(key).cast("string").alias("pk_value"), row_image(new).alias("new_row"))
        return a.join(b, "pk_value", "full").where("NOT old_row <=> new_row").select(F.lit(name).alias("table_name"), "pk_value", "old_row", "new_row")

    def undo(self) -> int:
        """Return to the last boundary before the pointer; the number of rows restored."""
        m, journal = self.manifest, self.journal()
        bounds = [r["id"] for r in journal.where("table_name is null").select("id").collect()]
        below = [b for b in bounds if b < m["pointer"]] if m["pointer"] in bounds else [b for b in bounds if b <= m["pointer"]]
        start = max(below, default=0)
        # An explicit 0 marks that all groups are undone.
        return self._replay(journal.where((F.col("id") > start) & (F.col("id") <= m["pointer"]) & F.col("table_name").isNotNull()), False, start)

    def redo(self) -> int:
        """Go forward to the next boundary or the end of the journal."""
        m, journal = self.manifest, self.journal()
        ids = journal.where(F.col("id") > m["pointer"]).agg(F.min(F.when(F.col("table_name").isNotNull(), F.col("id"))).alias("first"), F.max("id").alias("last")).first()
        if ids["first"] is None:
            return 0
        stop = journal.where((F.col("id") > ids["first"]) & F.col("table_name").isNull()).agg(F.min("id")).first()[0]
        end = stop - 1 if stop else ids["last"]
        return self._replay(journal.where((F.col("id") > m["pointer"]) & (F.col("id") <= end) & F.col("table_name").isNotNull()), True, end)

    def _replay(self, entries: DataFrame, redo: bool, pointer: int) -> int:
        m, new, n = self.manifest, {}, 0
        wanted = images(entries, redo)
        for name in [r[0] for r in wanted.select("table_name").distinct().collect()]:
            key, table = m["keys"][name], self.table(name)
            own = wanted.where(F.col("table_name") == name)
            n += own.count()
            kept = table.join(own.select(F.col("pk_value").alias("__k")), F.col(key).cast("string") == F.col("__k"), "left_anti")
            back = own.where("image is not null").select(F.from_json("image", table.schema).alias("r")).select("r.*")
            new[name] = kept.unionByName(back)
        m |= {"version": m["version"] + 1, "pointer": pointer}
        self._publish(m, new)
        return n

    def replace(self, name: str, rows: DataFrame) -> None:
        """Replace a table's rows, keys included, forget its journal and reset the pointer."""
        m = self.manifest
        schema = self.table(name).schema
        own = with_flags(rows).select(*[F.col(f.name).cast(f.dataType) for f in schema])
        journal = self.journal().where(F.col("table_name").isNull() | (F.col("table_name") != name))
        m |= {"version": m["version"] + 1, "pointer": m["next_id"] - 1}
        self._publish(m, {name: own}, journal)

    def reset_tracking(self) -> None:
        """Deleted rows go, all flags and the journal are cleared."""
        m = self.manifest
        new = {n: live(self.table(n)).withColumns({f: F.lit(0) for f in FLAGS}) for n in m["tables"]}
        m |= {"version": m["version"] + 1, "pointer": 0, "next_id": 1}
        self._publish(m, new, self.spark.createDataFrame([], JOURNAL))

    def set_meta(self, key: str, value: str) -> None:
        m = self.manifest
        m["meta"][key] = value
        m["version"] += 1
        self._publish(m, {})

    def get_meta(self, key: str) -> str | None:
        return self.manifest["meta"].get(key)

    def purge(self, names: Sequence[str], column: str, value) -> int:
        """Delete the rows of one source from every table that has the column; how many went."""
        m, new, gone = self.manifest, {}, 0
        for name in names:
            t = self.table(name)
            if column in t.columns:
                gone += t.where(F.col(column) == value).count()
                new[name] = purged(t, column, value)
        m["version"] += 1
        self._publish(m, new)
        return gone

    def summary(self) -> list[dict]:
        """Per table: total, live, new, modified, deleted."""
        out = []
        for name in sorted(self.manifest["tables"]):
            s = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
            new, mod, gone = (F.col(f) == 1 for f in FLAGS)
            out.append({"table": name, **self.table(name).agg(F.count("*").alias("total"), s(~gone).alias("live"), s(new).alias("new"), s(mod & ~new).alias("modified"), s(gone).alias("deleted")).first().asDict()})
        return out

    def vacuum(self) -> None:
        """Remove folders that the manifest doesn't name."""
        m = self.manifest
        named = {p.split("/")[0] for p in [*m["tables"].values(), *([m["journal"]] if m["journal"] else [])]}
        store, root = files.store_of(self.root)
        for info in store.get_file_info(files.fs.FileSelector(root)):
            if info.base_name.startswith("v=") and info.base_name not in named:
                store.delete_dir(info.path)
