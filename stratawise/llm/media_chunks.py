"""Media columns as content-defined chunks.

A payload (bytes, here padded text) is cut where a rolling gear hash of its last 32 bytes
has eleven zero bits, between ``SMALLEST`` and ``LARGEST`` bytes apart, so equal stretches
give equal chunks wherever they stand.

1. A task cuts its payloads and writes each chunk that is new to it into one *pack*: a
   record a chunk (header and 8-bit samples, compressed without loss), then an index.  It
   returns a row a chunk (digest and place) and a row a document (its ordered digests).
2. A Spark aggregation by digest names one place of each chunk as its owner.  Packs with
   chunks owned elsewhere are rewritten without them, record by record as they are, a range
   of packs a task; the old pack goes once the new one is in place, and a retried task finds
   the new one.
3. A Spark join by digest turns each document's digests into places.  Reading fetches the
   records in order from the packs, checks every digest and returns the payload.

Only digests and places are shuffled, never payloads.  The stored form of a document is its
records in order, as they lie in the packs; its length and digest are those of the bytes read
there.  Null texts count as empty (padding alone), and so do empty ones; equal texts and
repeated rows share their records and give equal values; a very long text has more chunks; an
empty table gives no packs.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratawise.llm.common import checkpointed, default_parallelism, doc_texts, open_fs, publish, released, slices

UNIT = 192
SMALLEST, LARGEST = 512, 8192
#: Bytes read at once, and what a record may have beyond them.
STRETCH, ROOM = 1 << 20, 2 * LARGEST
_MASK = np.uint32(0x7FF << 20)  # bit 30 depends on the last 31 bytes, fewer than SMALLEST
_GEAR = np.random.default_rng(192).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
_PLACE = np.dtype([("digest", "V16"), ("at", "<i8"), ("length", "<i4")])
_MAGIC = b"SWM1"


def padded(raw: bytes) -> bytes:
    return raw + b" " * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def cut_points(data: np.ndarray) -> np.ndarray:
    """Where the gear hash allows a cut (after that byte), by doubling the window to 32 bytes."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            h[k:] = h[k:] + (h[:-k].copy() << np.uint32(k))
    return np.flatnonzero((h & _MASK) == 0) + 1


def chunk_ends(points: list[int], start: int, end: int) -> list[int]:
    """Ends of the chunks of one payload; ``points`` are the allowed cuts inside it."""
    ends, last = [], start
    for p in points:
        while p - last > LARGEST:
            last += LARGEST
            ends.append(last)
        if p - last >= SMALLEST and p < end:
            ends.append(last := p)
    while end - last > LARGEST:
        last += LARGEST
        ends.append(last)
    return [*ends, end]


class PackWriter:
    """Records of one chunk each, then an index of their places.

    A record is the magic, the chunk's length and its 8-bit samples, compressed without loss."""

    def __init__(self, out):
        self.out, self.places, self.at = out, [], 0
        self.press = zstandard.ZstdCompressor(level=3, write_content_size=False)

    def add(self, key: bytes, chunk: bytes) -> None:
        self.copy(key, _MAGIC + struct.pack("<I", len(chunk)) + self.press.compress(chunk))

    def copy(self, key: bytes, record: bytes) -> None:
        """A record as it was stored before."""
        self.out.write(record)
        self.places.append((key, self.at, len(record)))
        self.at += len(record)

    def close(self) -> np.ndarray:
        places = np.array(self.places, dtype=_PLACE)
        index = self.press.compress(places.tobytes())
        self.out.write(index + struct.pack("<QQ", len(index), places.nbytes))
        return places


def samples(record: bytes, expand: zstandard.ZstdDecompressor | None = None) -> bytes:
    """The chunk of a record."""
    size = struct.unpack("<I", record[4:8])[0]
    if record[:4] != _MAGIC or size > LARGEST:
        raise OSError("not a chunk record")
    return (expand or zstandard.ZstdDecompressor()).decompress(record[8:], max_output_size=size)


class PackReader:
    """Random access to the packs of a folder; a few stretches and files stay at hand."""

    def __init__(self, out: str, stretches: int = 64, files: int = 16):
        self.store, self.root = open_fs(out)
        self.stretches, self.files, self.most = OrderedDict(), OrderedDict(), (stretches, files)
        self.expand = zstandard.ZstdDecompressor()

    def _file(self, pack: str):
        if pack not in self.files:
            self.files[pack] = self.store.open_input_file(f"{self.root}/{pack}")
            if len(self.files) > self.most[1]:
                self.files.popitem(last=False)[1].close()
        self.files.move_to_end(pack)
        return self.files[pack]

    def _stretch(self, pack: str, k: int) -> bytes:
        """Bytes k * STRETCH on, with room for a record that begins there."""
        if (pack, k) not in self.stretches:
            f = self._file(pack)
            self.stretches[pack, k] = f.read_at(min(STRETCH + ROOM, f.size() - k * STRETCH), k * STRETCH)
            if len(self.stretches) > self.most[0]:
                self.stretches.popitem(last=False)
        self.stretches.move_to_end((pack, k))
        return self.stretches[pack, k]

    def record(self, pack: str, at: int, length: int) -> bytes:
        k, start = divmod(at, STRETCH)
        return self._stretch(pack, k)[start : start + length]

    def chunk(self, pack: str, at: int, length: int) -> bytes:
        return samples(self.record(pack, at, length), self.expand)

    def places(self, pack: str) -> np.ndarray:
        f = self._file(pack)
        end = f.size()
        n, size = struct.unpack("<QQ", f.read_at(16, end - 16))
        return np.frombuffer(self.expand.decompress(f.read_at(n, end - 16 - n), max_output_size=size), dtype=_PLACE) if size else np.zeros(0, dtype=_PLACE)


_SCHEMA = "kind int, row long, doc_id long, n_bytes long, digests binary, pack string, at long, length int"
_TYPES = {"kind": pa.int32(), "row": pa.int64(), "doc_id": pa.int64(), "n_bytes": pa.int64(), "digests": pa.binary(), "pack": pa.string(), "at": pa.int64(), "length": pa.int32()}


def _rows(**columns: list) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_pydict({c: pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in _TYPES.items()})


def _place_rows(pack: str, places: np.ndarray) -> pa.RecordBatch:
    return _rows(kind=[1] * len(places), digests=[x.tobytes() for x in places["digest"]], pack=[pack] * len(places), at=places["at"], length=places["length"])


def _cut(docs: DataFrame, out: str) -> DataFrame:
    """Write the packs; rows of kind 0 are documents, of kind 1 chunk places."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, root = open_fs(out)
        pack, seen, made, found = f"pack-{part:06d}.0", set(), [], None

        def write(f) -> None:
            nonlocal found
            writer, row = PackWriter(f), part << 32
            for batch in batches:
                for piece in slices(batch):
                    raw = [t.encode() for t in piece.column("text").to_pylist()]
                    payloads = [padded(r) for r in raw]
                    whole = b"".join(payloads)
                    points = cut_points(np.frombuffer(whole, dtype=np.uint8))
                    ends = np.cumsum([len(p) for p in payloads])
                    first = np.searchsorted(points, ends - [len(p) for p in payloads], side="right").tolist()
                    last, points, recipes, at = np.searchsorted(points, ends, side="right").tolist(), points.tolist(), [], 0
                    for k, end in enumerate(ends.tolist()):
                        keys = []
                        for stop in chunk_ends(points[first[k] : last[k]], at, end):
                            chunk = whole[at:stop]
                            keys.append(key := digest(chunk))
                            if key not in seen:
                                seen.add(key)
                                writer.add(key, chunk)
                            at = stop
                        recipes.append(b"".join(keys))
                    made.append(_rows(kind=[0] * len(raw), row=list(range(row, row + len(raw))), doc_id=piece.column("doc_id").to_pylist(), n_bytes=[len(r) for r in raw], digests=recipes))
                    row += len(raw)
            found = writer.close()

        publish(store, f"{root}/{pack}", write)
        yield from made
        if len(found):
            yield _place_rows(pack, found)
        else:
            store.delete_file(f"{root}/{pack}")

    return checkpointed(docs.mapInArrow(released(cut), _SCHEMA))


def _compacted(cut: DataFrame, out: str, parts: int) -> DataFrame:
    """(digest, pack, at, length) of every chunk's one place, after rewriting packs."""
    places = cut.where("kind = 1").select(F.col("digests").alias("digest"), "pack", "at", "length")
    owners = places.groupBy("digest").agg(F.min(F.struct("pack", "at")).alias("o"))
    kept = places.join(owners.select("digest", F.col("o.pack").alias("owner")), "digest")
    packs = kept.groupBy("pack").agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("pack") != F.col("owner"), F.col("digest"))).alias("gone"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_fs(out)
        for batch in batches:
            for pack, n, gone in zip(*(batch.column(c).to_pylist() for c in ("pack", "n", "gone")), strict=True):
                reader, new, places = PackReader(out, stretches=2), pack[:-1] + "1", None
                if not gone:
                    yield _place_rows(pack, reader.places(pack))
                    continue
                drop = set(gone)
                if len(drop) < n and store.get_file_info(f"{root}/{new}").type == fs.FileType.NotFound:

                    def write(f, reader=reader, pack=pack, drop=drop) -> None:
                        writer = PackWriter(f)
                        for p in reader.places(pack):
                            if (key := p["digest"].tobytes()) not in drop:
                                writer.copy(key, reader.record(pack, int(p["at"]), int(p["length"])))
                        writer.close()

                    publish(store, f"{root}/{new}", write)
                if len(drop) < n:
                    places = PackReader(out).places(new)
                if store.get_file_info(f"{root}/{pack}").type == fs.FileType.File:
                    try:
                        store.delete_file(f"{root}/{pack}")
                    except FileNotFoundError:  # another attempt of this task was first
                        pass
                if places is not None:
                    yield _place_rows(new, places)

    # Dealt by range: by hash the plan would reuse the aggregation's shuffle, whose few bytes become one task.
    index = packs.repartitionByRange(parts, "pack").mapInArrow(released(rewrite), _SCHEMA)
    return checkpointed(index.select(F.col("digests").alias("digest"), "pack", "at", "length"))


def store_media(docs: DataFrame, out: str) -> DataFrame:
    """Store every payload under ``out``; returns the manifest: row, doc_id, n_bytes and the
    ordered list ``chunks`` of (digest, pack, at, length)."""
    parts = default_parallelism(docs.sparkSession)
    cut = _cut(doc_texts(docs), out)
    index = _compacted(cut, out, parts)
    listed = cut.where("kind = 0").select("row", "doc_id", "n_bytes", F.posexplode(F.expr("transform(sequence(0, CAST(octet_length(digests) / 16 AS int) - 1), i -> substring(digests, 16 * i + 1, 16))")).alias("ord", "digest"))
    placed = listed.join(index, "digest")
    return placed.groupBy("row", "doc_id", "n_bytes").agg(F.array_sort(F.collect_list(F.struct("ord", "digest", "pack", "at", "length"))).alias("chunks"))


def feature(samples: np.ndarray, n_chunks: int) -> str:
    """Chunks, sum, total variation, peak and distinct values of the samples."""
    steps = np.abs(np.diff(samples.astype(np.int16))).sum(dtype=np.int64)
    return f"chunks={n_chunks};sum={int(samples.sum(dtype=np.int64))};variation={int(steps)};peak={int(samples.max())};levels={int((np.bincount(samples, minlength=256) > 0).sum())}"


def read_media(manifest: DataFrame, out: str, *, with_payload: bool = False) -> DataFrame:
    """Read every document's chunks back, check their digests and compute its values."""
    parts = default_parallelism(manifest.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", payload binary" * with_payload
    # Documents that begin in one stretch of a pack are read together.
    near = manifest.withColumn("first", F.col("chunks")[0]).repartition(parts, F.col("first.pack"), F.shiftright(F.col("first.at"), 21)).sortWithinPartitions("first.pack", "first.at", "row").drop("first")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = PackReader(out)
        for batch in batches:
            made = []
            for doc_id, n_bytes, chunks in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "chunks")), strict=True):
                parts, records = [], []
                for c in chunks:
                    records.append(reader.record(c["pack"], c["at"], c["length"]))
                    parts.append(samples(records[-1], reader.expand))
                    if digest(parts[-1]) != c["digest"]:
                        raise OSError(f"a chunk of {c['pack']} is damaged")
                payload, stored = b"".join(parts), b"".join(records)
                row = (doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(np.frombuffer(payload, dtype=np.uint8), len(parts)))
                made.append((*row, payload) if with_payload else row)
                if len(made) == 1000:
                    yield _read_rows(made)
                    made = []
            if made:
                yield _read_rows(made)

    return near.mapInArrow(released(read), schema)


def _read_rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "payload")
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
    return pa.RecordBatch.from_pydict({names[k]: pa.array([r[k] for r in rows], types[k]) for k in range(len(rows[0]))})
