"""Binary tree documents as the node table of ``trees``, and back.

A document is a name table, then flat records of nodes and attributes that refer to each
other by number, then one heap of values.  Records are unpacked whole and rows are made in
document order with an explicit stack.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from stratawise.sources.archive import inflate, lz4_decode
from stratawise.sources.trees import NODES

#: Fixed values of the format: signature, versions, and the attribute types by number.
SIGNATURE, VERSIONS, MOST_SECTION, BUCKETS = b"LSOF", range(2, 8), 256 << 20, 512
TYPES = (
    "None", "uint8", "int16", "uint16", "int32", "uint32", "float", "double", "ivec2", "ivec3", "ivec4", "fvec2", "fvec3", "fvec4", "mat2x2", "mat3x3", "mat3x4", "mat4x3", "mat4x4",
    "bool", "string", "path", "FixedString", "LSString", "uint64", "ScratchBuffer", "old_int64", "int8", "TranslatedString", "WString", "LSWString", "guid", "int64", "TranslatedFSString",
)
_SCALARS = {"uint8": "B", "int16": "h", "uint16": "H", "int32": "i", "uint32": "I", "float": "f", "double": "d", "uint64": "Q", "old_int64": "q", "int8": "b", "int64": "q"}
_VECTORS = {"ivec2": "2i", "ivec3": "3i", "ivec4": "4i", "fvec2": "2f", "fvec3": "3f", "fvec4": "4f", "mat2x2": "4f", "mat3x3": "9f", "mat3x4": "12f", "mat4x3": "12f", "mat4x4": "16f"}
_TEXTS = frozenset(("string", "path", "FixedString", "LSString", "WString", "LSWString"))


def lz4_frame(data: bytes) -> bytes:
    """An LZ4 frame of independent or linked blocks."""
    if data[:4] != b"\x04\x22\x4d\x18":
        raise ValueError("not an LZ4 frame")
    flags, at, out = data[4], 7, bytearray()
    if flags & 8:
        at += 8
    if flags & 1:
        at += 4
    while True:
        (size,) = struct.unpack_from("<I", data, at)
        at += 4
        if not size:
            return bytes(out)
        raw = data[at : at + (size & 0x7FFFFFFF)]
        at += len(raw) + (4 if flags & 16 else 0)
        out += raw if size & 0x80000000 else lz4_decode(raw, None, bytes(out) if not flags & 32 else b"")


def number_text(value: float | int) -> str:
    """Shortest text of a 32-bit float or an integer; no point where integral."""
    if isinstance(value, int):
        return str(value)
    for digits in range(1, 18):
        text = f"{value:.{digits}g}"
        if struct.pack("<f", float(text)) == struct.pack("<f", value):
            break
    value = float(text)
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def _guid(raw: bytes) -> str:
    swapped = raw[:8] + b"".join(raw[i + 1 : i + 2] + raw[i : i + 1] for i in range(8, 16, 2))
    return str(uuid.UUID(bytes_le=swapped))


def _guid_bytes(text: str) -> bytes:
    raw = uuid.UUID(text).bytes_le
    return raw[:8] + b"".join(raw[i + 1 : i + 2] + raw[i : i + 1] for i in range(8, 16, 2))


def _text(raw: bytes, wide: bool = False) -> str:
    if wide and raw and len(raw) % 2 == 0 and 0 in raw[1::2]:
        return raw.decode("utf-16-le").rstrip("\0")
    return raw.rstrip(b"\0").decode()


def _value(kind: str, raw: bytes) -> tuple[str, str | None, str | None]:
    """(value, handle, version)."""
    if kind in _SCALARS:
        v = struct.unpack_from("<" + _SCALARS[kind], raw)[0]
        return (number_text(v) if kind == "float" else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)), None, None
    if kind in _VECTORS:
        return " ".join(map(number_text, struct.unpack_from("<" + _VECTORS[kind], raw))), None, None
    if kind == "bool":
        return "True" if raw[0] else "False", None, None
    if kind in _TEXTS:
        return _text(raw, "WString" in kind), None, None
    if kind == "ScratchBuffer":
        return raw.hex(), None, None
    if kind == "guid":
        return _guid(raw[:16]), None, None
    if kind in ("TranslatedString", "TranslatedFSString"):
        version, n = struct.unpack_from("<Hi", raw)
        handle = _text(raw[6 : 6 + max(0, n)])
        return handle, handle, str(version)
    return "", None, None


class _Input:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, form: str) -> tuple:
        out = struct.unpack_from("<" + form, self.raw, self.at)
        self.at += struct.calcsize("<" + form)
        return out

    def section(self, size: int, stored: int, method: int, framed: bool) -> bytes:
        if size > MOST_SECTION:
            raise ValueError("a section is too large")
        n = stored or size
        raw = self.raw[self.at : self.at + n]
        if len(raw) < n:
            raise ValueError("a section runs over the end")
        self.at += n
        if not stored or not method:
            return raw
        if method == 1:
            return inflate(raw, size)
        if method == 2:
            return lz4_frame(raw) if framed else lz4_decode(raw, size)
        raise ValueError(f"compression {method}")


def parse(raw: bytes) -> list[tuple]:
    """Rows of NODES without path and error."""
    f = _Input(raw)
    signature, version = f.take("4sI")
    if signature != SIGNATURE or version not in VERSIONS:
        raise ValueError(f"not a tree document of a known version ({signature!r}, {version})")
    f.take("q" if version >= 5 else "i")
    sizes = {"names": f.take("II")}
    sizes["keys"] = f.take("II") if version >= 6 else (0, 0)
    for name in ("nodes", "attributes", "values"):
        sizes[name] = f.take("II")
    flags, _, _, layout = f.take("BBHI")
    method, linked = flags & 15, version >= 3 and layout == 1
    names = _names(f.section(*sizes["names"], method, False))
    node_rows = list(struct.iter_unpack("<Iiii" if linked else "<Iii", f.section(*sizes["nodes"], method, True)))
    attr_rows = list(struct.iter_unpack("<IIiI" if linked else "<IIi", f.section(*sizes["attributes"], method, True)))
    heap = f.section(*sizes["values"], method, True)
    attrs = _attributes(node_rows, attr_rows, linked, names, heap)
    parents = [r[1] if linked else r[2] for r in node_rows]
    below = defaultdict(list)
    for i, p in enumerate(parents):
        if p >= i or p < -1:
            raise ValueError(f"node {i} has parent {p}")
        below[p].append(i)
    rows: list[tuple] = []
    for region in below[-1]:
        name = names[node_rows[region][0]]
        tops = below[region] if name == "root" else [region]
        stack = [(i, None, None, 0) for i in reversed(tops)]
        while stack:
            i, parent, top, depth = stack.pop()
            own, kind = len(rows), names[node_rows[i][0]]
            top = own if top is None and kind != "root" else top
            rows.append((name, kind, own, parent, top, depth, False, attrs[i]))
            stack += [(c, own, top, depth + 1) for c in reversed(below[i])]
    return rows


def _names(raw: bytes) -> dict[int, str]:
    """Names by their packed bucket and place."""
    f, out = _Input(raw), {}
    (buckets,) = f.take("I")
    if buckets > 4096:
        raise ValueError("too many name buckets")
    for b in range(buckets):
        for k in range(f.take("H")[0]):
            (n,) = f.take("H")
            out[b << 16 | k] = raw[f.at : f.at + n].decode()
            f.at += n
    return out


def _attributes(nodes: list[tuple], rows: list[tuple], linked: bool, names: dict[int, str], heap: bytes) -> list[dict]:
    """Of each node: attribute name → (type, value, handle, version)."""
    out: list[dict] = [{} for _ in nodes]

    def put(node: int, name: int, packed: int, offset: int) -> None:
        kind, n = TYPES[packed & 63], packed >> 6
        if offset + n > len(heap):
            raise ValueError("a value lies outside the heap")
        value, handle, version = _value(kind, heap[offset : offset + n])
        out[node][names[name]] = (kind, value, handle, version)

    if linked:
        for i, node in enumerate(nodes):
            at, seen = node[3], 0
            while at != -1:
                name, packed, following, offset = rows[at]
                put(i, name, packed, offset)
                at, seen = following, seen + 1
                if seen > len(rows):
                    raise ValueError("attributes run in a circle")
    else:
        offset = 0
        for name, packed, node in rows:
            put(node, name, packed, offset)
            offset += packed >> 6
    return out


def _raw_value(kind: str, value: str, handle: str | None, version: str | None) -> bytes:
    if kind in _SCALARS:
        return struct.pack("<" + _SCALARS[kind], float(value) if kind in ("float", "double") else int(value))
    if kind in _VECTORS:
        parts = value.split()
        return struct.pack("<" + _VECTORS[kind], *(int(x) if "i" in _VECTORS[kind] else float(x) for x in parts))
    if kind == "bool":
        return bytes([value in ("True", "true", "1")])
    if kind in _TEXTS:
        return value.encode() + b"\0"
    if kind == "ScratchBuffer":
        return bytes.fromhex(value)
    if kind == "guid":
        return _guid_bytes(value)
    if kind in ("TranslatedString", "TranslatedFSString"):
        raw = (handle or value).encode() + b"\0"
        return struct.pack("<Hi", int(version or 1), len(raw)) + raw + (struct.pack("<i", 0) if kind == "TranslatedFSString" else b"")
    return b""


def write(regions: list[tuple[str, list[dict]]]) -> bytes:
    """A document of version 6 without compression.  A node is {id, attributes {name: (type, value, handle, version)}, children}."""
    order: list[tuple[int, dict]] = []
    for name, nodes in regions:
        top = nodes[0] if len(nodes) == 1 and nodes[0]["id"] == name else {"id": name, "attributes": {}, "children": nodes}
        stack = [(-1, top)]
        while stack:
            parent, node = stack.pop()
            own = len(order)
            order.append((parent, node))
            stack += [(own, c) for c in reversed(node.get("children", []))]
    buckets: list[list[str]] = [[] for _ in range(BUCKETS)]
    codes: dict[str, int] = {}
    for _, node in order:
        for n in (node["id"], *node["attributes"]):
            if n not in codes:
                b = zlib.crc32(n.encode()) % BUCKETS
                codes[n] = b << 16 | len(buckets[b])
                buckets[b].append(n)
    names = struct.pack("<I", BUCKETS) + b"".join(struct.pack("<H", len(b)) + b"".join(struct.pack("<H", len(n.encode())) + n.encode() for n in b) for b in buckets)
    nodes, attrs, heap, sibling = bytearray(), bytearray(), bytearray(), {}
    last: dict[int, int] = {}
    for i, (parent, _) in enumerate(order):
        if parent in last:
            sibling[last[parent]] = i
        last[parent] = i
    count = 0
    for i, (parent, node) in enumerate(order):
        own = list(node["attributes"].items())
        nodes += struct.pack("<Iiii", codes[node["id"]], parent, sibling.get(i, -1), count if own else -1)
        for k, (n, (kind, *rest)) in enumerate(own):
            raw = _raw_value(kind, *(rest + [None, None])[:3])
            attrs += struct.pack("<IIiI", codes[n], TYPES.index(kind) | len(raw) << 6, count + 1 if k + 1 < len(own) else -1, len(heap))
            heap += raw
            count += 1
    head = SIGNATURE + struct.pack("<Iq", 6, 4 << 55) + struct.pack("<10I", len(names), 0, 0, 0, len(nodes), 0, len(attrs), 0, len(heap), 0) + struct.pack("<BBHI", 0, 0, 0, 1)
    return head + names + bytes(nodes) + bytes(attrs) + bytes(heap)


def read(files: DataFrame) -> DataFrame:
    """NODES from (path, content); a document that can't be read gives one error row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "region", "node_id", "node_ord", "parent_ord", "root_ord", "depth", "commented", "attrs", "error"]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [(path, *r[:-1], {k: dict(zip(("type", "value", "handle", "version"), v, strict=True)) for k, v in r[-1].items()}, None) for r in parse(bytes(content))]
                except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
                    rows = [(path, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                out = pd.DataFrame(rows, columns=names)
                for c in ("node_ord", "parent_ord", "root_ord", "depth"):
                    out[c] = out[c].astype("Int64")
                yield out

    return files.select("path", "content").mapInPandas(run, NODES)
