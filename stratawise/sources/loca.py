"""Localisation: the binary table and the XML list, read and written."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratawise.functions.text import decode_entities, escape_xml

#: Fixed values of the format: signature, header and record sizes, bytes of a key.
SIGNATURE, HEADER, RECORD, KEY = 0x41434F4C, 12, 70, 64


def decode(raw: bytes) -> list[tuple[str, int, str]]:
    """(key, version, text) of a binary table; offsets and counts are checked."""
    if len(raw) < HEADER:
        raise ValueError("too small for a header")
    signature, count, heap = struct.unpack_from("<III", raw)
    if signature != SIGNATURE:
        raise ValueError(f"signature {signature:08X}")
    end = HEADER + RECORD * count
    if not end <= heap <= len(raw):
        raise ValueError(f"text offset {heap} outside {end}..{len(raw)}")
    out, at = [], heap
    for i in range(count):
        key, version, length = struct.unpack_from(f"<{KEY}sHI", raw, HEADER + RECORD * i)
        if at + length > len(raw):
            raise ValueError(f"text {i} runs over the end")
        out.append((key.rstrip(b"\0").decode(), version, raw[at : at + length].rstrip(b"\0").decode()))
        at += length
    return out


def encode(rows: list[tuple[str, int, str]]) -> bytes:
    """The inverse; texts are zero-terminated."""
    texts = [t.encode() + b"\0" for _, _, t in rows]
    head = struct.pack("<III", SIGNATURE, len(rows), HEADER + RECORD * len(rows))
    return head + b"".join(struct.pack(f"<{KEY}sHI", k.encode(), v, len(t)) for (k, v, _), t in zip(rows, texts, strict=True)) + b"".join(texts)


def read_binary(files: DataFrame) -> DataFrame:
    """(path, contentuid, version, text, error) from (path, content); a bad file gives one error row."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [(path, *r, None) for r in decode(bytes(content))]
                except (ValueError, struct.error, UnicodeDecodeError) as e:
                    rows.append((path, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "contentuid", "version", "text", "error"])

    return files.select("path", "content").mapInPandas(read, "path string, contentuid string, version long, text string, error string")


def read_xml(files: DataFrame) -> DataFrame:
    """(path, contentuid, version, text) from (path, text): the content elements of each document."""
    pattern = r'(?s)<content\b([^>]*?)(?:/>|>(.*?)</content>)'
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), 1).alias("a"), F.regexp_extract_all("text", F.lit(pattern), 2).alias("t"))
    rows = files.select("path", F.explode(pairs).alias("c"))
    key, version = F.regexp_extract("c.a", r'contentuid\s*=\s*"([^"]*)"', 1), F.regexp_extract("c.a", r'version\s*=\s*"([0-9]+)"', 1)
    return rows.select("path", key.alias("contentuid"), F.coalesce(F.nullif(version, F.lit("")).try_cast("long"), F.lit(1)).alias("version"), decode_entities(F.col("c.t")).alias("text")).where("contentuid <> ''")


def render_xml(df: DataFrame) -> DataFrame:
    """One row (content): the list ordered by key, version 1 where null."""
    line = F.concat(F.lit('  <content contentuid="'), escape_xml(F.col("contentuid")), F.lit('" version="'), F.coalesce("version", F.lit(1)).cast("string"), F.lit('">'), escape_xml(F.coalesce("text", F.lit(""))), F.lit("</content>"))
    rows = df.select("contentuid", line.alias("l")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("contentuid", "l"))), lambda x: x["l"]), "\n").alias("b"))
    return rows.select(F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?>\n<contentList>\n'), F.col("b"), F.lit("\n</contentList>\n")).alias("content"))


def upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """(contentuid, version, text) in document order: existing rows keep their place and take new
    texts; unseen keys follow in their own order.  Both sides have ``pos``."""
    a = existing.select("contentuid", F.col("version").alias("v0"), F.col("text").alias("t0"), F.col("pos").alias("p0"))
    b = new.select("contentuid", F.col("version").alias("v1"), F.col("text").alias("t1"), F.col("pos").alias("p1"))
    both = a.join(b, "contentuid", "full")
    return both.orderBy(F.col("p0").isNull(), F.coalesce("p0", "p1")).select("contentuid", F.coalesce("v1", "v0", F.lit(1)).alias("version"), F.coalesce("t1", "t0").alias("text"))


def map_of(df: DataFrame) -> DataFrame:
    """handle → text, null as empty, by handle."""
    return df.select(F.col("contentuid").alias("handle"), F.coalesce("text", F.lit("")).alias("text")).orderBy("handle")
