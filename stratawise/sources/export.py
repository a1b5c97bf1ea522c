"""Export plans: which files a workspace renders to, and putting them in place."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratawise.operators.diff import file_delta
from stratawise.operators.staging import live
from stratawise.sources import files


class Exporter(Protocol):
    """A kind of file: plan gives (path, entries), render gives (path, content), warnings gives (path, message)."""

    def plan(self, rows: DataFrame) -> DataFrame: ...

    def render(self, rows: DataFrame) -> DataFrame: ...

    def warnings(self, rows: DataFrame) -> DataFrame: ...


class GroupedText:
    """Rows rendered by a line expression into one file a group, in key order."""

    def __init__(self, path, line, key: str, header: str = "", footer: str = ""):
        self.path, self.line, self.key, self.header, self.footer = path, line, key, header, footer

    def plan(self, rows: DataFrame) -> DataFrame:
        return live(rows).groupBy(self.path.alias("path")).agg(F.count("*").alias("entries"))

    def render(self, rows: DataFrame) -> DataFrame:
        parts = F.array_sort(F.collect_list(F.struct(F.col(self.key).alias("k"), self.line.alias("l"))))
        body = F.array_join(F.transform(parts, lambda x: x["l"]), "\n")
        return live(rows).groupBy(self.path.alias("path")).agg(F.concat(F.lit(self.header), body, F.lit(self.footer)).alias("content"))

    def warnings(self, rows: DataFrame) -> DataFrame:
        twice = live(rows).groupBy(self.path.alias("path"), self.key).count().where("count > 1")
        return twice.select("path", F.concat(F.lit("repeated key "), F.col(self.key).cast("string")).alias("message"))


def export_plan(parts: Sequence[tuple[Exporter, DataFrame]], present: DataFrame, extension: str) -> DataFrame:
    """(path, action, entries): all exporters' files, and files on disk that none of them makes as deletes."""
    plans = [e.plan(rows) for e, rows in parts]
    out = plans[0]
    for p in plans[1:]:
        out = out.unionByName(p)
    made = out.withColumn("action", F.lit("write"))
    orphans = present.where(F.col("path").endswith(extension)).join(out.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("entries"), F.lit("delete").alias("action"))
    return made.select("path", "entries", "action").unionByName(orphans)


def write_delta(planned: DataFrame, present: DataFrame, root: str, backup: bool = True) -> dict[str, int]:
    """Put rendered files in place: all are written beside their targets first, then moved; on any failure
    before the moves nothing has changed.  Counts by action."""
    delta = {r["path"]: r["action"] for r in file_delta(planned, present).collect()}
    for p in delta:
        if p.startswith("/") or ".." in p.split("/"):
            raise ValueError(f"outside the folder: {p}")
    store, base = files.store_of(root)
    staged: list[tuple[str, str]] = []
    try:
        for r in planned.toLocalIterator():
            if delta[r["path"]] in ("create", "update"):
                target = f"{base}/{r['path']}"
                store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                part = f"{target}.{uuid.uuid4().hex}"
                staged.append((part, target))
                with store.open_output_stream(part) as f:
                    f.write(r["content"].encode() if isinstance(r["content"], str) else bytes(r["content"]))
    except Exception:
        for part, _ in staged:
            files.remove(f"{root}/{part.removeprefix(base + '/')}")
        raise
    for path, action in delta.items():
        if backup and action in ("update", "delete"):
            store.copy_file(f"{base}/{path}", f"{base}/{path}.bak")
    for part, target in staged:
        store.move(part, target)
    for path, action in delta.items():
        if action == "delete":
            store.delete_file(f"{base}/{path}")
    counts = {a: 0 for a in ("create", "update", "unchanged", "delete")}
    for a in delta.values():
        counts[a] += 1
    return counts
