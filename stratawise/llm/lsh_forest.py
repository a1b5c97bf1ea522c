"""N-gram Jaccard join by a MinHash LSH forest and exact verification.

A document's set is its distinct 5-word shingles (all its words as one shingle when it
has fewer; texts without words have none and join nothing).  Documents with equal sets
form a class of copies with one representative; only representatives go on.

*Forest.*  Each set is a leaf of ``trees`` tries, on the path of its ``longest`` labels in
that tree.  A trie is its leaves sorted by path; what two neighbours share is the longest
prefix that either shares with any leaf on the other's side.  Matched prefixes are shortened
from ``longest`` labels on, until a pair at the threshold has met in some tree with the target
probability; where the prefix of two neighbours is shorter than that, a node ends.  Rows
come sorted, so one leaf is held at a time, however crowded a node is.

*Candidates.*  Leaves that meet are linked to their neighbours, and links make components.
The pairs of a small component are compared as they are.  In a component of more than
``crowd`` sets, in which a chain of weak meetings may hold unlike texts, the pairs of its
nodes are compared instead if those are fewer, each in the first tree where it meets.

*Verification.*  Pairs are compared exactly, in blocks of about ``block`` sets, or fewer
long ones: large groups are cut into blocks and pairs of blocks are dealt out, so no task holds
a whole group.  A task returns counts of links and a spanning forest, never pairs.  Only
verified links make classes.

Shingles are 64-bit hashes.  A link is a pair at or above the threshold, copies
included: ``n_links`` counts a document's linked documents.  Classes are connected
components, named by their least doc_id.  Rows with a null doc_id stand alone with null
class and no links; equal rows are one document; a repeated doc_id with different texts
is one document with several sets, and its links are summed.  An empty table gives an
empty result; columns other than doc_id and text are not read; a very long text is one set
in a block of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratawise.llm.common import checkpointed, default_parallelism, flat_words, released, slices
from stratawise.llm.graph import components
from stratawise.llm.suffix_dedup import GRAM, gram_hashes

SHINGLE = GRAM
#: _digest numbers the texts of a slice, and the end of the last one, in 14 bits.
_ROWS = (1 << 14) - 1


def forest_depth(trees: int, longest: int, threshold: float, target: float) -> int:
    """The longest prefix at which a pair at the threshold still meets with the target probability."""
    for depth in range(longest, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= target:
            return depth
    raise ValueError("too few trees for this recall")


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of all texts in order, repeats included, and the text of each."""
    words, counts = flat_words(texts)
    grams = gram_hashes(words)
    doc = np.repeat(np.arange(len(texts)), counts)
    pos = np.arange(len(grams)) - (np.cumsum(counts) - counts)[doc]
    keep = pos + SHINGLE <= counts[doc]
    # A short text's only shingle is all its words: the gram at its first word, told apart by length.
    short = (counts > 0) & (counts < SHINGLE)
    if not short.any():
        return grams[keep], doc[keep]
    h = grams.copy()
    for i in np.flatnonzero(short).tolist():
        at = int(counts[:i].sum())
        h[at] = gram_hashes(words.slice(at, int(counts[i])))[0] ^ np.uint64(0xA5A5A5A5A5A5A5A5)
    keep |= (pos == 0) & short[doc]
    return h[keep], doc[keep]


def distinct(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text and offsets by text."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(n + 1))


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    return (h ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)


def signatures(h: np.ndarray, doc: np.ndarray, labels: int) -> np.ndarray:
    """``labels`` 32-bit minima of each text that has shingles; hashes come in text order.

    The hashes are uniform already, so a bijection of 32 bits orders them at random."""
    starts = np.flatnonzero(np.diff(doc, prepend=-1)) if len(doc) else np.zeros(0, dtype=np.int64)
    out = np.zeros((len(starts), labels), dtype=np.uint32)
    rng, low, v = np.random.default_rng(7), (h ^ (h >> np.uint64(32))).astype(np.uint32), np.empty(len(h), dtype=np.uint32)
    for j in range(labels if len(starts) else 0):
        np.bitwise_xor(low, np.uint32(rng.integers(1 << 32)), out=v)
        np.multiply(v, np.uint32(rng.integers(1 << 32) | 1), out=v)
        out[:, j] = np.minimum.reduceat(v, starts)
    return out


def _binary(h: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * 8).astype(np.int32)), pa.py_buffer(h.astype("<u8"))])


def _digest(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two order-free 64-bit sums over each text's distinct hashes (their upper 50 bits), and how many."""
    packed = np.sort((doc.astype(np.uint64) << np.uint64(50)) | (h >> np.uint64(14)))
    packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])[: len(packed)]]
    at = np.searchsorted(packed, np.arange(n + 1, dtype=np.uint64) << np.uint64(50))
    low, count, out = packed & np.uint64((1 << 50) - 1), np.diff(at), []
    for seed in (0x243F6A8885A308D3, 0x13198A2E03707344):
        v = _mixed(low, seed)
        v ^= v >> np.uint64(32)
        v *= np.uint64(0xD6E8FEB86659FD93)
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(v ^ (v >> np.uint64(29)), dtype=np.uint64)])
        out.append((total[at[1:]] - total[at[:-1]] + count.astype(np.uint64)).view(np.int64))
    return out[0], out[1], count


def forest_paths(sig: np.ndarray, trees: int, longest: int, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each tree every leaf's node at ``depth`` labels, as one hash, and the labels below it (upper bits, in order)."""
    for t in range(trees):
        node = np.full(len(sig), t + 1, dtype=np.uint64)
        for j in range(t * longest, t * longest + depth):
            node = _mixed(node ^ sig[:, j], 0x452821E638D01377)
            node ^= node >> np.uint64(29)
        below, bits = np.zeros(len(sig), dtype=np.uint64), 63 // max(1, longest - depth)
        for j in range(t * longest + depth, (t + 1) * longest):
            below = (below << np.uint64(bits)) | (sig[:, j].astype(np.uint64) >> np.uint64(max(0, 32 - bits)))
        yield node, below


def _planted(texts: DataFrame, trees: int, longest: int, depth: int) -> DataFrame:
    """One pass over the texts.  Rows with null leaf: (doc_id, dk, s1, s2, n), the digest of a document's set.
    Rows with leaf: its place in one tree, (node, below, tree)."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("doc_id", "dk", "s1", "s2", "n", "leaf", "node", "below", "tree")

        def rows(count: int, **columns: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({c: columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(np.ascontiguousarray(columns[c])) if c in columns else pa.nulls(count, pa.int64()) for c in names})

        for batch in batches:
            for piece in slices(batch, most=8_000_000, rows=_ROWS):
                h, doc = shingles(piece.column("text"))
                s1, s2, n = _digest(h, doc, piece.num_rows)
                yield rows(piece.num_rows, doc_id=piece.column("doc_id"), dk=piece.column("dk"), s1=s1, s2=s2, n=n)
                s, leaf = np.unique(s1[n > 0], return_index=True)  # copies are one leaf
                for t, (node, below) in enumerate(forest_paths(signatures(h, doc, trees * longest)[leaf], trees, longest, depth)):
                    yield rows(len(s), leaf=s, node=node.view(np.int64), below=below.view(np.int64), tree=np.full(len(s), t))

    return texts.mapInArrow(released(plant), "doc_id long, dk long, s1 long, s2 long, n long, leaf long, node long, below long, tree long")


def _neighbours(places: DataFrame, parts: int) -> DataFrame:
    """Links (a, b) between leaves next to each other under one node, in the order of the tries."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_node, last_leaf = None, None
        for batch in batches:
            node, leaf = batch.column("node").to_numpy(), batch.column("leaf").to_numpy()
            if not len(node):
                continue
            if last_node is not None:
                node, leaf = np.concatenate([[last_node], node]), np.concatenate([[last_leaf], leaf])
            met = (node[1:] == node[:-1]) & (leaf[1:] != leaf[:-1])  # copies from several tasks are one leaf
            pairs = np.unique(np.sort(np.stack([leaf[1:][met], leaf[:-1][met]], axis=1), axis=1), axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_pydict({"a": pa.array(np.ascontiguousarray(pairs[:, 0])), "b": pa.array(np.ascontiguousarray(pairs[:, 1]))})
            last_node, last_leaf = node[-1], leaf[-1]

    dealt = places.select("node", "below", "leaf").repartition(parts, "node").sortWithinPartitions("node", "below", "leaf")
    return dealt.mapInArrow(released(meet), "a long, b long").distinct()


def _groups(planted: DataFrame, candidates: DataFrame, sizes: DataFrame, crowd: int, block: int) -> DataFrame:
    """For each leaf with candidates the groups in which it is compared: (s1, groups of (id, tree, blocks), nodes).

    ``nodes`` lists the leaf's node in every tree where its component is compared by nodes, else it is null."""
    blocks = lambda members, total: F.greatest(F.ceil(F.col(members) / block), F.ceil(F.col(total) / (block * 20_000))).cast("int")
    sized = candidates.join(sizes, "s1")
    whole = sized.groupBy("root").agg(F.count("*").alias("members"), F.sum("n").alias("total"))
    if whole.where(F.col("members") > crowd).isEmpty():
        return sized.join(whole, "root").select("s1", F.array(F.struct(F.col("root").alias("id"), F.lit(-1).cast("long").alias("tree"), blocks("members", "total").alias("blocks"))).alias("groups"), F.lit(None).cast("array<long>").alias("nodes"))
    large = sized.join(whole.where(F.col("members") > crowd), "root")
    places = checkpointed(planted.where("leaf is not null").select(F.col("leaf").alias("s1"), "tree", "node").join(large, "s1").distinct())
    nodes = places.groupBy("root", "tree", "node").agg(F.count("*").alias("met"), F.sum("n").alias("met_total"), F.max("members").alias("members")).where("met > 1")
    by_node = nodes.groupBy("root", "members").agg(F.sum(F.col("met").cast("double") * F.col("met")).alias("cost")).where("cost < double(members) * members").select("root")
    own = places.join(by_node, "root", "left_semi").join(nodes.drop("members"), ["root", "tree", "node"], "left")
    parts = own.groupBy("s1").agg(
        F.expr("collect_list(CASE WHEN met > 1 THEN struct(node AS id, tree, CAST(greatest(ceil(met / {0}), ceil(met_total / {1})) AS int) AS blocks) END)".format(block, block * 20_000)).alias("groups"),
        F.transform(F.array_sort(F.collect_list(F.struct("tree", "node"))), lambda x: x["node"]).alias("nodes"),
    )
    rest = sized.join(by_node, "root", "left_anti").join(whole, "root").select("s1", F.array(F.struct(F.col("root").alias("id"), F.lit(-1).cast("long").alias("tree"), blocks("members", "total").alias("blocks"))).alias("groups"), F.lit(None).cast("array<long>").alias("nodes"))
    return rest.unionByName(parts)


def _compare(left: list, right: list | None, tree: int, num: int, den: int, emit: list) -> None:
    """Exact links within one block (right None) or between two; appends to ``emit``.

    In a node of a tree, pairs that meet in an earlier tree are left to that one.

    Set sizes bound the candidates; the rest share shingles, counted through sorted lists.
    """
    both = left + (right or [])
    split = len(left)
    if len(both) < 2:
        return
    ids = np.array([x[0] for x in both], dtype=np.int64)
    copies = np.array([x[1] for x in both], dtype=np.int64)
    sets = [np.frombuffer(x[2], dtype="<u8") for x in both]
    size = np.array([len(x) for x in sets], dtype=np.int64)
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    count = np.bincount(code, minlength=len(values))
    shared = np.flatnonzero(count > 1)
    remap = np.full(len(values), -1)
    remap[shared] = np.arange(len(shared))
    col = remap[code]
    owner, col = owner[col >= 0], col[col >= 0]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for a in range(0, len(shared), 4096):  # intersections as products of 0/1 panels
        here = (col >= a) & (col < a + 4096)
        panel = np.zeros((len(sets), min(4096, len(shared) - a)), dtype=np.float32)
        panel[owner[here], col[here] - a] = 1
        active = np.flatnonzero(panel.any(axis=1))
        part = panel[active]
        common[np.ix_(active, active)] += part @ part.T
    inter = common.astype(np.int64)
    linked = inter * (den + num) >= num * (size[:, None] + size[None, :])
    np.fill_diagonal(linked, False)
    if right is not None:
        linked[:split, :split] = False
        linked[split:, split:] = False
    if tree > 0:
        nodes = np.array([x[3][:tree] for x in both], dtype=np.int64)
        for t in range(tree):
            linked &= nodes[:, None, t] != nodes[None, :, t]
    degree = linked @ copies
    parent = list(range(len(sets)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(*np.nonzero(np.triu(linked)), strict=True):
        a, b = find(int(i)), find(int(j))
        if a != b:
            parent[max(a, b)] = min(a, b)
    for i in np.flatnonzero(linked.any(axis=1)).tolist():
        emit.append((int(ids[i]), int(degree[i]), int(ids[find(i)])))


def jaccard_join(docs: DataFrame, threshold: tuple[int, int] = (4, 5), trees: int = 24, longest: int = 8, target: float = 0.9999, block: int = 128, crowd: int = 512) -> DataFrame:
    """One row a document: doc_id, class_id, n_links, n_copies (documents with its set, itself included)."""
    sets, named = set_classes(docs.where("doc_id is not null"), threshold, trees, longest, target, block, crowd)
    out = sets.select("doc_id", "s1", "s2").distinct().join(named, ["s1", "s2"], "left").groupBy("doc_id").agg(
        F.coalesce(F.min("class_id"), F.col("doc_id")).alias("class_id"),
        F.sum(F.coalesce(F.col("degree") + F.col("copies") - 1, F.lit(0))).alias("n_links"),
        F.max(F.coalesce("copies", F.lit(1))).alias("n_copies"),
    )
    alone = docs.where("doc_id is null").select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return out.union(alone)


def row_key(doc_id: Column, text: Column) -> Column:
    """One hash of a row's id and text; a null text counts as empty."""
    return F.xxhash64(doc_id.cast("long"), F.coalesce(text, F.lit("")))


def set_classes(docs: DataFrame, threshold: tuple[int, int] = (4, 5), trees: int = 24, longest: int = 8, target: float = 0.9999, block: int = 128, crowd: int = 512) -> tuple[DataFrame, DataFrame]:
    """(doc_id, dk, s1, s2, n) of each row, its row_key and the digest of its set; and s1, s2, copies, class_id,
    root (the same for all sets of a class) and degree of each set.  Rows with null ids have sets like any other."""
    spark = docs.sparkSession
    parts, (num, den) = default_parallelism(spark), threshold
    depth = forest_depth(trees, longest, num / den, target)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("dk"), F.coalesce("text", F.lit("")).alias("text"))
    planted = checkpointed(_planted(texts, trees, longest, depth))
    sets = planted.where("leaf is null").select("doc_id", "dk", "s1", "s2", "n")
    classes = sets.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("title"), F.min("dk").alias("rep"), F.count_distinct("doc_id").alias("copies"), F.max("n").alias("n"))
    candidates = components(_neighbours(planted.where("leaf is not null"), parts)).withColumnRenamed("node", "s1")
    groups = _groups(planted, candidates, classes.groupBy("s1").agg(F.max("n").alias("n")), crowd, block)
    reps = checkpointed(classes.join(groups, "s1").select(F.col("rep").alias("dk"), "s1", "s2", "copies", "groups", "nodes"))
    wanted = texts.select("dk", "text").join(reps, "dk")

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, rows=_ROWS):
                h, doc = shingles(piece.column("text"))
                h, at = distinct(h, doc, piece.num_rows)
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("s1", "copies", "groups", "nodes")), _binary(h, at)], ["s1", "copies", "groups", "nodes", "shingles"])

    members = wanted.mapInArrow(released(dealt), "s1 long, copies long, groups array<struct<id: long, tree: long, blocks: int>>, nodes array<long>, shingles binary")
    members = members.select("s1", "copies", "nodes", "shingles", F.inline("groups")).withColumn("mine", F.pmod(F.xxhash64("s1"), F.col("blocks")).cast("int"))
    pairs = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("id", "tree", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "s1", "copies", "nodes", "shingles")
    pairs = pairs.withColumn("route", F.xxhash64("id", "tree", "i", "j"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by block pair, so one block pair is in memory at a time."""
        emit: list = []
        held, key = {}, None

        def done() -> None:
            if key is None:
                return
            _, tree, i, j = key
            if i == j:
                _compare(held.get(i, []), None, tree, num, den, emit)
            else:
                _compare(held.get(i, []), held.get(j, []), tree, num, den, emit)

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("id", "tree", "i", "j", "mine", "s1", "copies", "nodes", "shingles")), strict=True)
            for *new, mine, s1, copies, nodes, held_set in rows:
                if key != new:
                    done()
                    held, key = {}, new
                members = held.setdefault(mine, [])
                if not members or members[-1][0] != s1:  # an equal row of the representative comes next to it
                    members.append((s1, copies, held_set, nodes))
            if len(emit) > 20_000:
                yield _emitted(emit)
                emit = []
        done()
        yield _emitted(emit)

    checked = checkpointed(pairs.repartition(parts, "route").sortWithinPartitions("id", "tree", "i", "j", "mine", "s1").drop("route").mapInArrow(released(verify), "s1 long, degree long, near long"))
    degree = checked.groupBy("s1").agg(F.sum("degree").alias("degree"))
    roots = components(checked.select(F.col("s1").alias("a"), F.col("near").alias("b"))).withColumnRenamed("node", "s1")
    titles = roots.join(classes, "s1").groupBy("root").agg(F.min("title").alias("least"))
    named = classes.join(degree, "s1", "left").join(roots.join(titles, "root"), "s1", "left")
    return sets, named.select("s1", "s2", "copies", F.coalesce("least", "title").alias("class_id"), F.coalesce("root", "s1").alias("root"), F.coalesce("degree", F.lit(0)).alias("degree"))


def _emitted(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in rows], pa.int64()) for k, c in enumerate(("s1", "degree", "near"))})


def expected_recall(similarity: float, trees: int, depth: int) -> float:
    return 1 - math.pow(1 - similarity**depth, trees)
