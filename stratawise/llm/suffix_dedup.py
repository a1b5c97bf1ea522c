"""Substring dedup by prefix-partitioned suffix trees.

A window is ``depth`` consecutive words; a window is a repeat when its word
sequence also starts earlier, and every word under a repeat goes.  A suffix begins
at a window's first word and is read to that window's end, in letters of GRAM words.

1. *Copies.*  Of equal texts only the one with the least doc_id is indexed; all windows
   of the others start earlier there, so their words go when they have a window at all.
2. *Pruning.*  In each window the 5-word gram with the least hash is its anchor, so equal
   windows have equal anchors at equal offsets.  Only anchors (a seventh of all places) are
   shuffled; a suffix whose window's own anchor occurs once can't be a repeat.  Anchors of
   overlapping windows don't count: where a copy has other words around it, they are others.
3. *Groups.*  Suffixes are dealt by a prefix of one letter; prefixes share a group (a
   virtual tree) so that one holds about ``group_rows`` suffixes.  Rows come sorted by group
   and are read as a stream.  A task first merges equal suffixes of its own slice, and a
   group that still outgrows ``group_rows`` distinct suffixes is dealt again by a prefix of
   two letters, then of the whole window, under which only equal suffixes meet.
4. *Subtrees.*  A group's suffixes are sorted; the common prefix lengths of neighbours
   give the intervals of its tree's nodes, and an interval of at least ``depth`` words is
   a deep node: all its leaves but the earliest are repeats.  Adjacent repeats merge into
   maximal spans.

Letters are 32 bits of a 64-bit gram hash, so windows of 20 words count as equal when 128
bits agree; texts as equal when two 64-bit hashes do.  The order is doc_id (null first),
then a hash of id and text, then position; rows with the same doc_id and text are one
document and get the same result.  Null and empty texts, and those of white space, have no words.  A very
long text is cut into as many letters as it has words, in one slice.  An empty table gives
an empty result.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratawise.llm.common import checkpointed, default_parallelism, flat_words, released, slices

GRAM = 5
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_NO_ID = -(1 << 63)
#: A row has either runs (of document did, dk) or a packed part of a group's suffixes.
_ROW = "group long, did long, dk long, runs binary, docs binary, suffixes binary"


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def gram_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of the GRAM words that start at each word (the last few run over the end)."""
    import xxhash

    coded = words.dictionary_encode()
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    h = own[coded.indices.to_numpy()] if len(own) else np.zeros(0, dtype=np.uint64)
    padded = np.concatenate([h, np.zeros(GRAM, dtype=np.uint64)])
    total = np.zeros(len(h), dtype=np.uint64)
    for j, m in enumerate(_powers(GRAM, _MULTIPLIER)):
        total += padded[j : j + len(h)] * m
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(32))


class Windows:
    """The windows of a run of documents: gram hashes, anchors and owners."""

    def __init__(self, texts: pa.Array, depth: int):
        words, self.counts = flat_words(texts)
        self.grams, self.depth = gram_hashes(words), depth
        n = len(self.grams)
        self.first = np.cumsum(self.counts) - self.counts
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.pos = np.arange(n) - self.first[self.doc]
        self.starts = np.flatnonzero(self.pos + depth <= self.counts[self.doc])
        width = depth - GRAM + 1
        best, at, done = self.grams.copy(), np.arange(n), 1
        while done < width:  # the least of ``width`` neighbours, the leftmost of ties
            step = min(done, width - done)
            nearer = best[step:] < best[:-step] if n > step else np.zeros(0, dtype=bool)
            head = slice(0, max(0, n - step))
            best[head] = np.where(nearer, best[step:], best[head])
            at[head] = np.where(nearer, at[step:], at[head])
            done += step
        self.own = at[self.starts]  # the anchor of each window
        self.anchors = np.unique(self.own)

    def suffixes(self, repeated: np.ndarray) -> np.ndarray:
        """Starts of the windows whose anchor is among ``repeated`` (places)."""
        known = np.zeros(len(self.grams) + 1, dtype=bool)
        known[repeated[repeated < len(self.grams)]] = True
        return self.starts[known[self.own]]

    def letters(self, starts: np.ndarray) -> np.ndarray:
        """A row of letters for each suffix; the last letter ends with the window."""
        own = (self.grams >> np.uint64(32)).astype("<u4")
        return np.stack([own[starts + min(j, self.depth - GRAM)] for j in range(0, self.depth, GRAM)], axis=1)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    return docs.select(did.alias("did"), F.col("doc_id").isNull().alias("no_id"), F.xxhash64(did, text).alias("dk"), text.alias("text"))


def _first_copies(keyed: DataFrame) -> DataFrame:
    """The key dk of the document with the least id among those of equal text."""
    same = keyed.groupBy(F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))
    return same.agg(F.min(F.struct("did", "dk")).alias("least")).select("least.dk").distinct()


# --- pruning by anchors ------------------------------------------------------------------------


def _repeated_anchors(keyed: DataFrame, depth: int, parts: int) -> DataFrame:
    """Places (dk, pos) of anchors that occur twice or more; equal texts of a slice count once."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, most=8_000_000):
                did, dk = piece.column("did").to_numpy(), piece.column("dk").to_numpy()
                _, copy = np.unique(piece.column("text").dictionary_encode().indices.to_numpy(), return_inverse=True)
                order = np.lexsort((did, copy))
                first = order[np.concatenate([[True], copy[order][1:] != copy[order][:-1]])[: len(order)]]
                dk, w = dk[first], Windows(piece.column("text").take(pa.array(first)), depth)
                order = np.argsort(w.grams[w.anchors], kind="stable")
                at = w.anchors[order]
                gram = w.grams[at]
                new = np.ones(len(gram), dtype=bool)
                new[1:] = gram[1:] != gram[:-1]
                count = np.zeros(len(gram), dtype=np.int64)  # 1 on the first of a gram that occurs once here, 2 if more often; 0 on the others
                count[new] = np.minimum(2, np.diff(np.append(np.flatnonzero(new), len(gram))))
                route = gram.view(np.int64).copy()
                route[~new] ^= at[~new].astype(np.int64) * 0x5851F42D4C957F2D % (1 << 61)  # they need no meeting
                yield _batch(route=pa.array(route), dk=pa.array(dk[w.doc[at]]), at=pa.array(w.pos[at] * 4 + count))

    dealt = keyed.mapInArrow(released(anchors), "route long, dk long, at long").repartition(parts, "route").sortWithinPartitions("route")
    return dealt.mapInArrow(released(_met), "dk long, pos int")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by route those whose route comes twice or that were counted twice before; one row waits for its successor."""
    held, joined = None, False  # the last row, and whether it equals the one before it
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        route, n = rows["route"].to_numpy(), rows["at"].to_numpy() & 3
        same = route[1:] == route[:-1]
        keep = n != 1
        keep[1:] |= same
        keep[:-1] |= same
        keep[0] |= joined
        held, joined = rows.slice(len(route) - 1).to_batches()[0], bool(same[-1]) if len(same) else joined
        yield _places(rows.slice(0, len(route) - 1).filter(pa.array(keep[:-1])))
    if held is not None and (joined or held.column("at")[0].as_py() & 3 != 1):
        yield _places(held)


def _places(rows: pa.Table | pa.RecordBatch) -> pa.RecordBatch:
    return _batch(dk=pa.array(rows["dk"].to_numpy()), pos=pa.array((rows["at"].to_numpy() >> 2).astype(np.int32)))


# --- groups and subtrees -----------------------------------------------------------------------


def _suffix_type(letters: int) -> np.dtype:
    return np.dtype([("letters", "<u4", (letters,)), ("doc", "<u4"), ("pos", "<i4")])


class Suffixes:
    """Suffixes as columns: letters, and the place (did, dk, pos) of each."""

    def __init__(self, letters: np.ndarray, did: np.ndarray, dk: np.ndarray, pos: np.ndarray):
        self.letters, self.did, self.dk, self.pos = letters, did, dk, pos

    def __len__(self) -> int:
        return len(self.pos)

    def take(self, which: np.ndarray) -> Suffixes:
        return Suffixes(self.letters[which], self.did[which], self.dk[which], self.pos[which])

    @staticmethod
    def joined(parts: list[Suffixes]) -> Suffixes:
        return Suffixes(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("letters", "did", "dk", "pos")))

    def tree(self) -> tuple[Suffixes, Suffixes]:
        """The earliest leaf of each deep node, in suffix order, and the other leaves of these nodes.

        Suffixes are sorted; the letters that neighbours share are the depth of the node over
        both, and an interval whose neighbours share all letters is a deep node."""
        own = self.take(np.lexsort((self.pos, self.dk, self.did, *self.letters.T[::-1])))
        shared = np.cumprod(own.letters[1:] == own.letters[:-1], axis=1).sum(axis=1)
        head = np.ones(len(own), dtype=bool)
        head[1:] = shared < own.letters.shape[1]
        first = np.maximum.accumulate(np.where(head, np.arange(len(own)), 0))
        # A repeated row of a document brings the same place again, which is no repeat.
        later = (own.did != own.did[first]) | (own.dk != own.dk[first]) | (own.pos != own.pos[first])
        return own.take(head), own.take(later)

    def packed(self, level: int, groups: int, most: int) -> Iterator[pa.RecordBatch]:
        """Rows of at most ``most`` suffixes of one group each, by prefixes of ``level`` letters."""
        if not len(self):
            return
        h = np.full(len(self), level, dtype=np.uint64)
        for j in range(level):
            h = (h ^ self.letters[:, j]) * np.uint64(_MULTIPLIER)
            h ^= h >> np.uint64(29)
        # A prefix that is a whole window has a group of its own.
        group = (h % np.uint64(groups)).astype(np.int64) if level < self.letters.shape[1] else (h >> np.uint64(1)).view(np.int64)
        order = np.argsort(group, kind="stable")
        own, group = self.take(order), group[order]
        at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        cuts = sorted({c for a, b in zip(at.tolist(), [*at[1:].tolist(), len(own)], strict=True) for c in range(a, b, most)}) + [len(own)]
        docs, rows = [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            listed, doc = np.unique(np.stack([own.did[a:b], own.dk[a:b]], axis=1), axis=0, return_inverse=True) if b - a > 1 else (np.array([[own.did[a], own.dk[a]]]), np.zeros(1, dtype=int))
            raw = np.empty(b - a, dtype=_suffix_type(own.letters.shape[1]))
            raw["letters"], raw["doc"], raw["pos"] = own.letters[a:b], doc.reshape(-1), own.pos[a:b]
            docs.append(listed.astype("<i8").tobytes())
            rows.append(raw.tobytes())
        n, size = len(rows), max(1, 4_000_000 // (1 + max(map(len, rows))))
        for a in range(0, n, size):
            k = min(n, a + size) - a
            yield _batch(
                group=pa.array(group[np.array(cuts[a : a + k])]), did=pa.nulls(k, pa.int64()), dk=pa.nulls(k, pa.int64()), runs=pa.nulls(k, pa.binary()),
                docs=pa.array(docs[a : a + k], pa.binary()), suffixes=pa.array(rows[a : a + k], pa.binary()),
            )

    def runs(self) -> Iterator[pa.RecordBatch]:
        """Window starts as runs, one row a document."""
        if not len(self):
            return
        own = self.take(np.lexsort((self.pos, self.dk, self.did)))
        did, dk, pos = own.did, own.dk, own.pos.astype(np.int64)
        document = np.ones(len(pos), dtype=bool)
        document[1:] = (did[1:] != did[:-1]) | (dk[1:] != dk[:-1])
        head = document.copy()
        head[1:] |= pos[1:] > pos[:-1] + 1
        at = np.flatnonzero(head)
        ends = np.append(at[1:], len(pos)) - 1
        pairs = np.stack([pos[at], pos[ends] - pos[at] + 1], axis=1).astype("<i4")
        rows = np.flatnonzero(document)
        offsets = np.searchsorted(at, np.append(rows, len(pos))).astype(np.int32) * 8
        packed = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(pairs))])
        n = len(rows)
        yield _batch(group=pa.array(did[rows] ^ dk[rows]), did=pa.array(did[rows]), dk=pa.array(dk[rows]), runs=packed, docs=pa.nulls(n, pa.binary()), suffixes=pa.nulls(n, pa.binary()))


def _unpacked(docs: bytes, suffixes: bytes, letters: int) -> Suffixes:
    raw, listed = np.frombuffer(suffixes, dtype=_suffix_type(letters)), np.frombuffer(docs, dtype="<i8").reshape(-1, 2)
    return Suffixes(raw["letters"], listed[raw["doc"], 0], listed[raw["doc"], 1], raw["pos"].astype(np.int32))


class Group:
    """The suffixes of one group as they come in; at most ``most`` distinct ones, and one row more, are held."""

    def __init__(self, key: int, longer: int | None, groups: int, most: int):
        self.key, self.longer, self.groups, self.most = key, longer, groups, most
        self.parts, self.held, self.passing = [], 0, False

    def add(self, more: Suffixes) -> Iterator[pa.RecordBatch]:
        if self.passing:
            yield from more.packed(self.longer, self.groups, self.most)
            return
        self.parts.append(more)
        self.held += len(more)
        if self.held > self.most:
            heads, later = Suffixes.joined(self.parts).tree()
            yield from later.runs()
            self.parts, self.held = [heads], len(heads)
            if self.held > self.most // 2 and self.longer:  # a longer prefix for all of them
                self.parts, self.held, self.passing = [], 0, True
                yield from heads.packed(self.longer, self.groups, self.most)

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            yield from Suffixes.joined(self.parts).tree()[1].runs()


def _subtrees(batches: Iterator[pa.RecordBatch], longer: int | None, letters: int, groups: int, most: int, watch: Callable[[Group], None] = lambda group: None) -> Iterator[pa.RecordBatch]:
    """Runs of repeats, and the suffixes of groups that need prefixes of ``longer`` letters; rows come sorted by group."""
    group = None
    for batch in batches:
        ready = batch.column("docs").is_null()
        if (passed := batch.filter(ready)).num_rows:
            yield passed
        rest = batch.filter(pa.compute.invert(ready))
        for key, docs, suffixes in zip(rest.column("group").to_pylist(), rest.column("docs"), rest.column("suffixes"), strict=True):
            if group is None or key != group.key:
                if group:
                    yield from group.end()
                group = Group(key, longer, groups, most)
            yield from group.add(_unpacked(docs.as_buffer(), suffixes.as_buffer(), letters))
            watch(group)
    if group:
        yield from group.end()


def repeated_windows(docs: DataFrame, depth: int = 20, group_rows: int = 1 << 18) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The keyed documents; the keys of first copies; and the repeats of each: rows (dk, runs of (did, runs)), a run
    being (first window start, number of windows) as pairs of little-endian 32-bit integers."""
    if depth < GRAM + 4:
        raise ValueError(f"a window has at least {GRAM + 4} words")
    parts, letters = default_parallelism(docs.sparkSession), -(-depth // GRAM)
    keyed = _keyed(docs)
    firsts = _first_copies(keyed)
    # A suffix a word at most; a word has two bytes at least.
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(4 * parts, -(-size // (2 * group_rows)))
    anchors = _repeated_anchors(keyed, depth, parts).groupBy("dk").agg(F.collect_list("pos").alias("anchors"))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, most=8_000_000):
                w, listed = Windows(piece.column("text"), depth), piece.column("anchors")
                starts = w.suffixes(w.first[listed.value_parent_indices().to_numpy()] + listed.flatten().to_numpy())
                if len(starts):
                    doc = w.doc[starts]
                    heads, later = Suffixes(w.letters(starts), piece.column("did").to_numpy()[doc], piece.column("dk").to_numpy()[doc], w.pos[starts].astype(np.int32)).tree()
                    yield from later.runs()
                    yield from heads.packed(1, groups, group_rows)

    # The same columns as in the last join, so that both read one shuffle of the texts.
    rows = keyed.join(firsts, "dk", "left_semi").join(anchors, "dk").select("dk", "did", "no_id", "text", "anchors").mapInArrow(released(suffixes), _ROW)
    levels = sorted({1, 2, letters})
    for longer in (*levels[1:], None):
        dealt = rows.repartition(parts, "group").sortWithinPartitions("group")
        rows = dealt.mapInArrow(lambda batches, longer=longer: _subtrees(batches, longer, letters, groups, group_rows), _ROW)
    return keyed, firsts, rows.groupBy("dk").agg(F.collect_list(F.struct("did", "runs")).alias("runs"))


def _covered(runs: list[bytes] | None, n: int, depth: int) -> np.ndarray:
    edge = np.zeros(n + 1, dtype=np.int32)
    for raw in runs or ():
        pairs = np.frombuffer(raw, dtype="<i4").reshape(-1, 2)
        np.add.at(edge, pairs[:, 0], 1)
        np.add.at(edge, pairs[:, 0] + pairs[:, 1] + depth - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, depth: int = 20, group_rows: int = 1 << 18, *, with_output: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256; with_output adds the kept
    text and the removed maximal spans as arrays of first word and number of words."""
    keyed, firsts, repeats = repeated_windows(docs, depth, group_rows)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string, span_start array<int>, span_words array<int>" * with_output

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                out = []
                for no_id, did, text, first, runs in zip(*(piece.column(c).to_pylist() for c in ("no_id", "did", "text", "first", "runs")), strict=True):
                    words, runs = text.encode().split(), [r["runs"] for r in runs or () if r["did"] == did]
                    gone = _covered(runs, len(words), depth) if runs else None if first or len(words) < depth else np.ones(len(words), dtype=bool)
                    kept = words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    joined = b" ".join(kept)
                    row = [None if no_id else did, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest()]
                    if with_output:
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]).astype(int))) if gone is not None else np.zeros(0, dtype=int)
                        row += [joined.decode(), edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist()]
                    out.append(row)
                names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "span_start", "span_words"][: 7 if with_output else 4]
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in out], types[i]) for i, c in enumerate(names)})

    marked = keyed.join(firsts.withColumn("first", F.lit(True)), "dk", "left").join(repeats, "dk", "left")
    return marked.select("no_id", "did", "text", F.coalesce("first", F.lit(False)).alias("first"), "runs").mapInArrow(released(rewrite), schema)
