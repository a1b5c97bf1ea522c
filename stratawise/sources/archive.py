"""Package archives: a metadata-only entry scan, a payload reader and a writer.

Registered as the Spark data source ``package``: one partition a run of entries, so a
large archive is read by many tasks.  Blocks are plain, zlib or LZ4.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith

#: Fixed values of the format: signature, version, header and entry sizes, limits, deletion mark.
SIGNATURE, VERSION, HEADER, ENTRY, NAME = 0x4B50534C, 18, 40, 272, 256
MOST_FILES, MOST_TABLE, DELETED = 1_000_000, 128 << 20, 0x0000BEEFDEADBEEF
METHODS = {0: "none", 1: "zlib", 2: "lz4"}


def lz4_decode(data: bytes, size: int | None, before: bytes = b"") -> bytes:
    """One LZ4 block of ``size`` bytes (None: any); it may copy from what stands before it."""
    out, i = bytearray(before), 0
    while i < len(data):
        token = data[i]
        i += 1
        n = token >> 4
        if n == 15:
            while True:
                n += data[i]
                i += 1
                if data[i - 1] != 255:
                    break
        out += data[i : i + n]
        i += n
        if i >= len(data):
            break
        back = data[i] | data[i + 1] << 8
        i += 2
        n = (token & 15) + 4
        if n == 19:
            while True:
                n += data[i]
                i += 1
                if data[i - 1] != 255:
                    break
        if not 0 < back <= len(out):
            raise ValueError("bad LZ4 offset")
        start = len(out) - back
        if back >= n:
            out += out[start : start + n]
        else:  # the copy runs into itself: its first bytes repeat
            out += (bytes(out[start:]) * (n // back + 1))[:n]
    if size is not None and len(out) - len(before) != size:
        raise ValueError(f"{len(out) - len(before)} bytes where {size} were said")
    return bytes(out[len(before) :])


def lz4_encode(data: bytes) -> bytes:
    """One LZ4 block of literals only, which any decoder reads."""
    n = len(data)
    head = bytearray([min(n, 15) << 4])
    if n >= 15:
        rest = n - 15
        head += b"\xff" * (rest // 255) + bytes([rest % 255])
    return bytes(head) + data


@dataclass(frozen=True)
class Entry:
    path: str
    offset: int
    part: int
    method: str
    stored: int
    size: int


class _Reader:
    def __init__(self, uri: str):
        self.store, self.path = fs.FileSystem.from_uri(uri)

    def part_path(self, part: int) -> str:
        return self.path if not part else re.sub(r"(\.\w+)$", rf"_{part}\1", self.path)

    def range(self, offset: int, length: int, part: int = 0) -> bytes:
        with self.store.open_input_file(self.part_path(part)) as f:
            if offset + length > f.size():
                raise ValueError("an entry runs over the end")
            f.seek(offset)
            return f.read(length)


def entries(uri: str) -> list[Entry]:
    """The file table, with sizes and counts checked; deleted entries are left out."""
    r = _Reader(uri)
    signature, version, at, _size, _flags, _priority, _md5, parts = struct.unpack("<IIQIBB16sH", r.range(0, HEADER))
    if signature != SIGNATURE or version != VERSION:
        raise ValueError(f"not a package of version {VERSION}")
    if not parts:
        raise ValueError("a package without parts")
    count, packed = struct.unpack("<II", r.range(at, 8))
    if count > MOST_FILES or packed > MOST_TABLE:
        raise ValueError("the file table is too large")
    table, out = lz4_decode(r.range(at + 8, packed), count * ENTRY), []
    for i in range(count):
        name, low, high, part, flags, stored, size = struct.unpack_from(f"<{NAME}sIHBBII", table, i * ENTRY)
        offset = low | high << 32
        if offset != DELETED & ((1 << 48) - 1):
            out.append(Entry(name.split(b"\0")[0].decode(), offset, part, METHODS.get(flags & 15, f"unknown {flags & 15}"), stored, size))
    return out


def payload(uri: str, e: Entry) -> bytes:
    raw = _Reader(uri).range(e.offset, e.stored, e.part)
    if e.method == "none":
        return raw
    return lz4_decode(raw, e.size) if e.method == "lz4" else inflate(raw, e.size, e.method)


def inflate(raw: bytes, size: int, method: str = "zlib") -> bytes:
    """At most ``size`` bytes of a zlib stream, which must then have ended."""
    if method != "zlib":
        raise ValueError(f"compression: {method}")
    stream = zlib.decompressobj()
    out = stream.decompress(raw, size + 1)
    if len(out) != size or not stream.eof:
        raise ValueError(f"a zlib stream of other than the {size} bytes said")
    return out


def write(uri: str, files: dict[str, bytes], method: str = "zlib") -> dict:
    """Write an archive in path order; totals and digest."""
    body, table = bytearray(), bytearray()
    code = {v: k for k, v in METHODS.items()}[method]
    for path in sorted(files):
        data = files[path]
        stored = data if method == "none" else zlib.compress(data) if method == "zlib" else lz4_encode(data)
        offset = HEADER + len(body)
        table += struct.pack(f"<{NAME}sIHBBII", path.encode(), offset & 0xFFFFFFFF, offset >> 32, 0, code, len(stored), 0 if method == "none" else len(data))
        body += stored
        body += b"\xad" * (-len(body) % 64)
    packed = lz4_encode(bytes(table))
    md5 = hashlib.md5(bytes(table), usedforsecurity=False).digest()
    head = struct.pack("<IIQIBB16sH", SIGNATURE, VERSION, HEADER + len(body), len(packed) + 8, 0, 0, md5, 1)
    raw = head + bytes(body) + struct.pack("<II", len(files), len(packed)) + packed
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_output_stream(path) as f:
        f.write(raw)
    return {"files": len(files), "bytes": len(raw), "sha256": hashlib.sha256(raw).hexdigest()}


@dataclass
class _Run(InputPartition):
    uri: str
    rows: list

    def __init__(self, uri: str, rows: list):
        self.uri, self.rows = uri, rows


class PackageSource(DataSource):
    """Options: path; content (default true), a regular expression ``pattern``, run (bytes a partition)."""

    @classmethod
    def name(cls) -> str:
        return "package"

    def schema(self) -> str:
        return "path string, size long, method string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _PackageReader(self.options)


class _PackageReader(DataSourceReader):
    def __init__(self, options):
        self.uri, self.pattern, self.content = options["path"], options.get("pattern"), options.get("content", "true") == "true"
        self.run, self.prefixes, self.equal = int(options.get("run", 64 << 20)), [], None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.prefixes.append(f.value)
            elif isinstance(f, EqualTo) and f.attribute == ("path",):
                self.equal = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        runs, size = [[]], 0
        for e in entries(self.uri):
            if (self.pattern and not re.search(self.pattern, e.path)) or (self.equal is not None and e.path != self.equal) or not all(e.path.startswith(p) for p in self.prefixes):
                continue
            if size > self.run:
                runs.append([])
                size = 0
            runs[-1].append(e)
            size += e.stored
        return [_Run(self.uri, r) for r in runs]

    def read(self, partition: _Run):
        for e in partition.rows:
            yield e.path, e.size or e.stored, e.method, payload(partition.uri, e) if self.content else None


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PackageSource)
