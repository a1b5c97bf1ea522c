"""Helpers shared by the operators: shared folders, word and unit splitting."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words (space and \t..\r).
WORD_SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session, where all tasks run in one process, gets a temporary
    folder when the setting is absent; a cluster without it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="stratawise-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared root, removed when the driver ends."""
    uri = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    store, path = open_fs(uri)
    store.create_dir(path, recursive=True)
    atexit.register(_remove, uri)
    return uri


def _remove(uri: str) -> None:
    store, path = open_fs(uri)
    if store.get_file_info(path).type == fs.FileType.Directory:
        store.delete_dir(path)


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI; plain absolute paths are local."""
    return fs.FileSystem.from_uri(uri)


def publish(store: fs.FileSystem, path: str, write: Callable) -> None:
    """Write under a name of this attempt, then move it into place, so a retried
    or speculative task never leaves a torn file."""
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        write(out)
    store.move(part, path)


def released(run: Callable) -> Callable:
    """``run`` for mapInArrow; at a task's end the worker, which lives on, gives freed memory back."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
                trim(0)

    return wrapped


def default_parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone (null text: empty); other columns can't clash."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 4_000_000, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes of text, which one row may exceed, and at most ``rows`` rows."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start, total = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most or rows and i - start == rows:
            ends.append((start, i))
            start, total = i, 0
        total += n
    if batch.num_rows:
        ends.append((start, batch.num_rows))
    for a, b in ends:
        yield batch.slice(a, b - a)


def flat_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, and the number of words of each text."""
    split = pc.ascii_split_whitespace(texts)
    words = split.flatten()
    owner = pc.list_parent_indices(split).to_numpy()
    real = pc.greater(pc.binary_length(words), 0)
    if not pc.all(real).as_py():
        owner = owner[real.to_numpy(zero_copy_only=False)]
        words = words.filter(real)
    return words, np.bincount(owner, minlength=len(texts)).astype(np.int64)


#: What makes a text need the careful splitter: doubled, leading or
#: trailing white space and every white space other than space and newline.
_CAREFUL = (
    r"  |\n\n|\n | \n|^[ \n]|[ \n]$|[\x00\x09\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}"
    r"\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
)
_CUT = re.compile(r"(?<=[!-~])(?=[ \n])|(?<=[^\W_])(?=[ \n])")

#: Marks that the byte-level patterns always part from a letter before them.
_MARKS = ".,;:!?*$%&#|"
_MARKED = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}][" + _MARKS + "]+$"


def _strings(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


def _stems_and_marks(words: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct parts of words, and each word's stem and the marks behind its last letter
    (-1: none) as numbers of parts."""
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32, count=words.offset + len(words) + 1)[words.offset :]
    marked = pc.match_substring_regex(words, _MARKED).to_numpy(zero_copy_only=False)
    stems = pc.binary_length(pc.ascii_rtrim(words, characters=_MARKS)).to_numpy(zero_copy_only=False)
    bounds = np.empty(2 * len(words) + 1, dtype=np.int32)  # stem and marks by turns, over the same bytes
    bounds[::2] = offsets
    bounds[1::2] = np.where(marked, offsets[:-1] + stems, offsets[1:])
    parts = pa.StringArray.from_buffers(2 * len(words), pa.py_buffer(bounds), words.buffers()[2]).dictionary_encode()
    codes = parts.indices.to_numpy().astype(np.int64)
    return _strings(parts.dictionary), codes[::2], np.where(marked, codes[1::2], -1)


def text_units(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Cut texts where no pre-token of a byte-level BPE pattern can cross.

    Returns the distinct units, the unit number of each piece in order, and the
    number of pieces of each text.  A pre-token never runs from a non-space
    into a following space, nor from a letter into a mark, so a cut there leaves
    every pre-token whole; words with and without marks then share one unit.
    """
    careful = pc.match_substring_regex(texts, _CAREFUL).to_numpy(zero_copy_only=False)
    n = len(texts)
    plain = texts if not careful.any() else pc.if_else(pa.array(careful), "", texts)
    split = pc.split_pattern(pc.replace_substring(plain, "\n", " \n "), " ")
    coded = split.flatten().dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    counts = np.diff(split.offsets.to_numpy()).astype(np.int64)
    words, stems, marks = _stems_and_marks(coded.dictionary)
    starts = np.cumsum(counts) - counts
    bare = np.zeros(len(codes), dtype=np.int64)  # 1: a piece without a space before it
    bare[starts[counts > 0]] = 1
    newline = pc.index(coded.dictionary, "\n").as_py()
    if newline >= 0:
        at = np.flatnonzero(codes == newline)
        bare[at] = 1
        bare[at + 1] = 1  # a plain text never ends with a newline
    first, second = 2 * stems[codes] + bare, marks[codes]
    split_at = np.flatnonzero(second >= 0)
    codes = np.insert(first, split_at + 1, 2 * second[split_at] + 1)
    if n:
        counts += np.bincount(np.searchsorted(starts, split_at, side="right") - 1, minlength=n)
    starts = np.cumsum(counts) - counts
    used = np.zeros(2 * len(words), dtype=bool)
    used[codes] = True
    units = [words[k >> 1] if k & 1 else " " + words[k >> 1] for k in np.flatnonzero(used).tolist()]
    codes = (np.cumsum(used) - 1)[codes]
    if not careful.any():
        return units, codes, counts
    known = {u: i for i, u in enumerate(units)}
    pieces = []
    for i in range(n):
        if careful[i]:
            own = [known.setdefault(u, len(known)) for u in _CUT.split(texts[i].as_py())]
            counts[i] = len(own)
            pieces.append(np.array(own, dtype=np.int64))
        else:
            pieces.append(codes[starts[i] : starts[i] + counts[i]])
    return list(known), np.concatenate(pieces) if pieces else codes, counts


class UnitTable:
    """Token ids of units, kept between batches of one Python worker."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = 800_000):
        self.encode, self.most = encode, most
        self._reset()

    def _reset(self) -> None:
        self.at: dict[str, int] = {}
        self.lens = np.zeros(1024, dtype=np.int64)
        self.starts = np.zeros(1024, dtype=np.int64)
        self.flat = np.zeros(4096, dtype=np.uint32)
        self.used = 0

    def _grow(self, name: str, n: int) -> None:
        old = getattr(self, name)
        if n > len(old):
            new = np.zeros(max(n, 2 * len(old)), dtype=old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)

    def ids(self, units: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in order, and the number of ids of each piece."""
        if len(self.at) > self.most:
            self._reset()
        new = [u for u in units if u not in self.at]
        if new:
            made = self.encode(new)
            base, lens = len(self.at), np.fromiter(map(len, made), dtype=np.int64, count=len(made))
            total = int(lens.sum())
            self._grow("lens", base + len(new))
            self._grow("starts", base + len(new))
            self._grow("flat", self.used + total)
            self.lens[base : base + len(new)] = lens
            self.starts[base : base + len(new)] = self.used + np.cumsum(lens) - lens
            self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(made), dtype=np.uint32, count=total)
            self.used += total
            self.at.update(zip(new, range(base, base + len(new)), strict=True))
        own = np.fromiter(map(self.at.__getitem__, units), dtype=np.int64, count=len(units))[codes]
        n = self.lens[own]
        ends = np.cumsum(n)
        where = np.repeat(self.starts[own] - (ends - n), n)
        where += np.arange(len(where))
        return self.flat[where], n


def ids_by_text(table: UnitTable, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts in order, and the offsets of each text (n + 1)."""
    units, codes, counts = text_units(texts)
    ids, n = table.ids(units, codes)
    ends = np.concatenate([[0], np.cumsum(n)])
    return ids, ends[np.concatenate([[0], np.cumsum(counts)])]
