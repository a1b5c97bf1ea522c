"""File listings as DataFrames, and small driver-side files on any store."""

from __future__ import annotations

import json
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratawise.functions.text import file_kind, module_of
from stratawise.operators.precedence import module_priority


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def put(uri: str, data: bytes) -> None:
    """Write beside the target, then move it into place."""
    store, path = store_of(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, path)


def get(uri: str) -> bytes | None:
    store, path = store_of(uri)
    if store.get_file_info(path).type != fs.FileType.File:
        return None
    with store.open_input_file(path) as f:
        return f.read()


def put_json(uri: str, value) -> None:
    put(uri, json.dumps(value, indent=1, sort_keys=True).encode())


def get_json(uri: str):
    raw = get(uri)
    return None if raw is None else json.loads(raw)


def remove(uri: str) -> None:
    store, path = store_of(uri)
    kind = store.get_file_info(path).type
    if kind == fs.FileType.Directory:
        store.delete_dir(path)
    elif kind == fs.FileType.File:
        store.delete_file(path)


def listing(spark: SparkSession, root: str, glob: str | None = None, with_content: bool = False) -> DataFrame:
    """(path below root, length, modified[, content]) of all files; contents are read only if asked for."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    df = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    base = root.rstrip("/").split("://", 1)[-1]
    relative = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), "^" + "/*" + _quoted(base) + "/*", "")
    return df.select(relative.alias("path"), "length", F.col("modificationTime").alias("modified"), *(["content"] if with_content else []))


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in text.lstrip("/"))


def ingest_files(files: DataFrame, priorities: dict[str, int], module: str | None = None) -> DataFrame:
    """Recognised files with kind, module and priority; a converted twin of an effect file is left out."""
    known = files.withColumns({"kind": file_kind(F.col("path")), "module": F.lit(module) if module else module_of(F.col("path"))}).where("kind is not null")
    originals = known.where("lower(path) like '%.lsfx'").select(F.concat("path", F.lit(".lsx")).alias("path"))
    return known.join(originals, "path", "left_anti").withColumn("priority", module_priority(F.col("module"), priorities, 10)).orderBy(F.col("priority").desc(), "path")


def text_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, text) with whole texts."""
    return listing(spark, root, glob, with_content=True).select("path", F.decode("content", "UTF-8").alias("text"))


def script_rows(files: DataFrame, existing: DataFrame | None = None, most: int = 2 * 1024 * 1024) -> DataFrame:
    """(key, value, hash) of script files up to a size, but for keys that a user has edited."""
    rows = files.where(F.octet_length("text") <= most).select(F.col("path").alias("key"), F.col("text").alias("value"), F.sha2("text", 256).alias("hash"))
    if existing is not None:
        rows = rows.join(existing.where("_is_modified = 1 or _is_new = 1").select("key"), "key", "left_anti")
    return rows


def package_folders(listing: DataFrame) -> DataFrame:
    """(root, package): folders below Mods that hold a manifest."""
    found = r"^(.*?)(?:^|/)?Mods/([^/]+)/meta\.lsx$"
    rows = listing.select(F.regexp_extract("path", found, 1).alias("root"), F.regexp_extract("path", found, 2).alias("package"))
    return rows.where("package <> ''").distinct()


#: Modules of the base data, which no load order counts.
BASE_MODULES = ("Gustav", "GustavDev")


def active_folders(files: DataFrame, base: tuple[str, ...] = BASE_MODULES) -> DataFrame:
    """(pos, folder) of the active packages in the newest settings file (text, modified; ties by path).

    Folders count from the line that opens the Mods node to the first end of children after one; the
    base modules are left out.  One file's lines are folded, so its size is the bound of a row."""
    newest = files.orderBy(F.col("modified").desc(), "path").limit(1)
    start = F.struct(F.lit(False).alias("open"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("found"))

    def step(s: Column, line: Column) -> Column:
        opened = s["open"] | line.contains('id="Mods"')
        folder = F.regexp_extract(line, '<attribute\\s+id="Folder"\\s+[^>]*value="([^"]+)"', 1)
        takes = opened & ~s["done"] & ~folder.isin("", *base)
        found = F.when(takes, F.concat(s["found"], F.array(folder))).otherwise(s["found"])
        done = s["done"] | (opened & (F.trim(F.regexp_replace(line, "[\\t\\r]", " ")) == "</children>") & (F.size(found) > 0))
        return F.struct(opened.alias("open"), done.alias("done"), found.alias("found"))

    folded = newest.select(F.aggregate(F.split("text", "\n"), start, step, lambda s: s["found"]).alias("found"))
    return folded.select(F.posexplode("found").alias("pos", "folder"))
