"""Token-ID binary output: flat unsigned integer files with 64-bit offsets.

A range shuffle on ``doc_id`` puts documents in ascending order over
partitions; each task encodes its run and writes three files:

* ``part-N.bin``  token ids, little-endian, 16 bits each when every id fits, else 32
* ``part-N.idx``  int64 offsets into the ids, one more than documents
* ``part-N.doc``  int64 document ids, then one byte each: 1 where the id is null

The number of ids of each partition (one small row per partition) comes back
to the driver, whose prefix sums are the partition bases in ``manifest.json``;
no other data leaves the executors.  Readers map the files into memory where
the store is local and read byte ranges elsewhere.  A special token's string in a
text gets that token's id, as in the tokenizers library.

Null texts count as empty (the end id alone), null ids come first, equal ids
are ordered by text; equal rows are all written.  An empty table gives an
empty manifest.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratawise.llm.common import UnitTable, default_parallelism, doc_texts, ids_by_text, open_fs, publish, released, slices

#: Units of letters alone, which the byte-level pattern leaves whole.
_LETTERS = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+").fullmatch

_tables: dict[tuple[str, int], UnitTable] = {}


def _byte_letters() -> list[str]:
    """The printable letter that byte-level BPE writes for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class _Encoder:
    """Unit ids from a byte-level tokenizer: plain words straight from its merge model,
    which skips the text pipeline, and all else through the whole tokenizer."""

    def __init__(self, tokenizer):
        self.tokenizer, self.letters = tokenizer, dict(enumerate(_byte_letters()))
        del self.letters[10]  # a newline parts the words below

    def words(self, words: list[str]) -> list[list[int]]:
        tokenize = self.tokenizer.model.tokenize
        return [[t.id for t in tokenize(w)] for w in "\n".join(words).encode().decode("latin-1").translate(self.letters).split("\n")]

    def __call__(self, units: list[str]) -> list[list[int]]:
        plain = [_LETTERS(u) is not None for u in units]
        out = self.words(list(compress(units, plain))) if any(plain) else []
        if len(out) == len(units):
            return out
        found, rest = iter(out), [u for u, p in zip(units, plain, strict=True) if not p]
        made = (e.ids for a in range(0, len(rest), 20_000) for e in self.tokenizer.encode_batch_fast(rest[a : a + 20_000], add_special_tokens=False))
        return [next(found if p else made) for p in plain]


def tokenizer_table(path: str) -> UnitTable:
    """The unit table over a ``tokenizers`` file, one per Python worker."""
    if (path, 0) not in _tables:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tables[path, 0] = UnitTable(_Encoder(Tokenizer.from_file(path)))
    return _tables[path, 0]


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def write_token_files(docs: DataFrame, out: str, tokenizer: str, end_id: int = 0, parts: int | None = None) -> dict:
    """Encode ``docs`` into ``out`` (a folder URI all executors share); returns the manifest."""
    spark = docs.sparkSession
    parts = parts or default_parallelism(spark)
    dtype = "<u2" if max(vocabulary_size(tokenizer), end_id + 1) <= 1 << 16 else "<u4"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, root = open_fs(out)
        table = tokenizer_table(tokenizer)
        ids_of, nulls, ends, total = [], [], [np.zeros(1, dtype=np.int64)], 0

        def write(f) -> None:
            nonlocal total
            for batch in batches:
                for piece in slices(batch):
                    ids, at = ids_by_text(table, piece.column("text"))
                    marked = np.insert(ids, at[1:], end_id)
                    f.write(marked.astype(dtype).tobytes())
                    ends.append(total + at[1:] + np.arange(1, len(at)))
                    total += len(marked)
                    ids_of.append(piece.column("doc_id").fill_null(0).to_numpy())
                    nulls.append(piece.column("doc_id").is_null().to_numpy(zero_copy_only=False))

        name = f"{root}/part-{part:06d}"
        publish(store, f"{name}.bin", write)
        if total:
            publish(store, f"{name}.idx", lambda f: f.write(np.concatenate(ends).astype("<i8").tobytes()))
            publish(store, f"{name}.doc", lambda f: f.write(np.concatenate(ids_of).astype("<i8").tobytes() + np.concatenate(nulls).astype("u1").tobytes()))
        else:
            store.delete_file(f"{name}.bin")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "docs": pa.array([sum(map(len, ids_of))], pa.int64()), "ids": pa.array([total], pa.int64())})

    ordered = doc_texts(docs).repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    rows = sorted((r for r in ordered.mapInArrow(released(encode), "part long, docs long, ids long").collect() if r["docs"]), key=lambda r: r["part"])
    bases = np.concatenate([[0], np.cumsum([r["ids"] for r in rows], dtype=np.int64)]).tolist()
    manifest = {"dtype": dtype, "end_id": end_id, "total": bases[-1], "parts": [{"part": r["part"], "docs": r["docs"], "ids": r["ids"], "base": b} for r, b in zip(rows, bases, strict=False)]}
    store, root = open_fs(out)
    publish(store, f"{root}/manifest.json", lambda f: f.write(json.dumps(manifest).encode()))
    return manifest


def _mapped(store, path: str, dtype: str, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Items start..stop of a file: a memory map where the store is local, else the bytes of that range."""
    if store.type_name == "local":
        return np.memmap(path, dtype=dtype, mode="r")[start:stop]
    size = np.dtype(dtype).itemsize
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read_at((f.size() // size if stop is None else stop) * size - start * size, start * size), dtype=dtype)


class TokenFiles:
    """Random access to written token files by position in ``doc_id`` order."""

    def __init__(self, out: str):
        self.store, self.root = open_fs(out)
        with self.store.open_input_file(f"{self.root}/manifest.json") as f:
            self.manifest = json.loads(f.read())
        self._docs = np.cumsum([0] + [p["docs"] for p in self.manifest["parts"]])

    def __len__(self) -> int:
        return int(self._docs[-1])

    def part(self, k: int) -> tuple[np.ndarray, np.ndarray, list]:
        """Ids, offsets and document ids of the k-th part that has documents."""
        name, n = f"{self.root}/part-{self.manifest['parts'][k]['part']:06d}", self.manifest["parts"][k]["docs"]
        raw = np.asarray(_mapped(self.store, f"{name}.doc", "u1"))
        docs = [None if null else int(d) for d, null in zip(raw[: 8 * n].view("<i8"), raw[8 * n :], strict=True)]
        return _mapped(self.store, f"{name}.bin", self.manifest["dtype"]), _mapped(self.store, f"{name}.idx", "<i8"), docs

    def __getitem__(self, i: int) -> np.ndarray:
        k = int(np.searchsorted(self._docs, i, side="right")) - 1
        name, j = f"{self.root}/part-{self.manifest['parts'][k]['part']:06d}", i - int(self._docs[k])
        start, stop = _mapped(self.store, f"{name}.idx", "<i8", j, j + 2).tolist()
        return _mapped(self.store, f"{name}.bin", self.manifest["dtype"], start, stop)


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    files = TokenFiles(out)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    parts = files.manifest["parts"]
    if not parts:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TokenFiles(out)
        for batch in batches:
            for k in batch.column("id").to_pylist():
                ids, at, docs = own.part(k)
                ids = np.asarray(ids)  # slices of a plain array are cheaper than of a memory map
                crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(docs, pa.int64()), "start": pa.array(np.asarray(at[:-1]) + parts[k]["base"], pa.int64()),
                    "n_tokens": pa.array(np.diff(at), pa.int64()), "ids_crc32": pa.array(crcs, pa.int64()),
                })

    return spark.range(0, len(parts), 1, len(parts)).mapInArrow(released(read), schema)
