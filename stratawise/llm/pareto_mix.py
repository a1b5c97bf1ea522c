"""Mixing sources to target weights by Pareto order sampling.

A document's size is its number of words.  Sources in code point order (null last)
take the weights in turn and share the total size; a target stops at ``most`` times
its source's size and the excess is shared again by weight until none is above.

Every document of a source first gets its certain whole copies, the integer part of target
over source size.  The words still missing are drawn without replacement, with unequal
inclusion probabilities: a document's is proportional to the square root of its size class
(eight classes a doubling), at most 1, and calibrated per source so that the expected words
are the missing ones; those at 1 are certain.  Document i has the rank odds(u) / odds(p), u
from a hash of the document, and the smallest ranks are taken until the missing words are
filled.  The document at the cut is taken if that comes nearer, and then documents of the
cut's bin are exchanged, one for another, while that brings the words nearer.  A rerun ranks
alike.

Ranks never meet in one task: a source's ranks are counted in at most ``bins`` bins, the bin
of the cut comes from prefix sums over them and is split again until it holds about
``bin_rows`` documents, and only that bin's documents are sorted.  Near the cut ranks are
no denser than documents over bins.  Nulls: a null text has size 0, a null source is one of
its own; a null id is ranked by its text.  Equal documents (id and text) have one rank and
are numbered by salted prefix sums.  Texts without words are never drawn.  An empty table
gives an empty mix.  Columns of the table keep their values; the four added ones replace
columns of the same name.  Only rows per source and size class come to the driver.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratawise.llm.common import WORD_SPACE, checkpointed

#: The columns that a mix adds.
ADDED = ("__size", "__source_size", "__target", "__copies")
_BROADCAST_ROWS = 100_000


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_SPACE + "+"), "")).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> dict[str | None, float]:
    """Target words of each source from (source, size) pairs."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, total = dict(order), sum(n for _, n in order)
    target: dict[str | None, float] = {}
    open_ = [s for s, _ in order]
    left = total
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * unit > most * size[s]]
        if not full:
            target |= {s: weight[s] * unit for s in open_}
            break
        target |= {s: float(most * size[s]) for s in full}
        left -= sum(most * size[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return target


def size_class(size: Column) -> Column:
    """Eight classes a doubling; 0 for texts without words."""
    return F.when(size > 0, 1 + F.floor(F.log2(size.cast("double")) * 8 + 1e-9)).otherwise(0).cast("int")


def calibrated(words: dict[int, int], missing: float) -> float:
    """The factor at which min(1, factor * 2 ** (class / 16)) of each class's words make up the missing ones."""
    classes = sorted((k for k, n in words.items() if k and n), reverse=True)
    certain, rest = 0.0, sum(words[k] * 2 ** (k / 16) for k in classes)
    for k in classes:  # the largest reach 1 first
        factor = max(0.0, missing - certain) / rest
        if factor * 2 ** (k / 16) <= 1:
            return factor
        certain, rest = certain + words[k], rest - words[k] * 2 ** (k / 16)
        if rest <= 0:
            break
    return math.inf


def draw(key: Column) -> Column:
    """52 bits of a hash in (0, 1)."""
    return (F.shiftrightunsigned(key, 12).cast("double") + 0.5) / F.lit(float(1 << 52))


def fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one source's documents in the bin of the cut, by rank: how many of each to take."""
    rows = rows.sort_values(["place", "key"], kind="stable").reset_index(drop=True)
    size, n, left = rows["size"].to_numpy(), rows["n"].to_numpy(), float(rows["left"].iloc[0])
    before = np.cumsum(size * n) - size * n
    took = np.clip((left - before) // size, 0, n).astype(np.int64)
    took[1:][np.cumsum(took < n)[:-1] > 0] = 0  # nothing after the document at the cut
    left -= float((took * size).sum())
    at = np.flatnonzero(took < n)
    if len(at) and abs(left - size[at[0]]) < abs(left):
        took[at[0]] += 1
        left -= size[at[0]]
    for _ in range(8):  # add, drop or exchange one document
        more, less = np.concatenate([[0], np.where(took < n, size, 0)]), np.concatenate([[0], np.where(took > 0, size, 0)])
        gain, who = np.unique(more, return_index=True)
        want = less + left
        near = np.clip(np.searchsorted(gain, want), 1, len(gain) - 1) if len(gain) > 1 else np.zeros(len(want), dtype=int)
        near = np.where(np.abs(gain[near] - want) <= np.abs(gain[np.maximum(near - 1, 0)] - want), near, np.maximum(near - 1, 0))
        off = np.abs(gain[near] - want)
        out = int(np.argmin(off))
        if off[out] >= abs(left) - 1e-9:
            break
        into = int(who[near[out]])
        left += float(less[out]) - float(more[into])
        if less[out]:
            took[out - 1] -= 1
        if more[into]:
            took[into - 1] += 1
    return rows.assign(take=took)[["s", "key", "take"]]


class _Names:
    """Column names that no table has."""

    def __init__(self):
        self.tag = uuid.uuid4().hex

    def __getattr__(self, name: str) -> str:
        return f"{name}_{self.tag}"


def _sized(docs: DataFrame, seed: int, x: _Names) -> DataFrame:
    """Adds the size, the source and a hash of id and text."""
    key = F.xxhash64(F.col("doc_id").cast("string"), F.coalesce(F.col("text"), F.lit("")), F.lit(seed))
    return docs.withColumns({x.size: word_count(F.col("text")), x.source: F.col("source"), x.key: key})


def _decided(sized: DataFrame, slim: DataFrame, x: _Names, weights: tuple[int, ...], most: int, bins: int, bin_rows: int) -> DataFrame:
    """``sized`` with the added columns; ``slim`` has its rows' source, size and key."""
    spark = sized.sparkSession
    by_class = slim.groupBy(x.source, size_class(F.col(x.size)).alias("k")).agg(F.sum(x.size).alias("words"), F.count("*").alias("docs")).collect()
    sources: dict[str | None, dict[int, tuple[int, int]]] = {}
    for s, k, words, n in by_class:
        sources.setdefault(s, {})[k] = (words, n)
    size = {s: sum(w for w, _ in own.values()) for s, own in sources.items()}
    plan, target = {}, targets(list(size.items()), weights, most)
    for s, own in sources.items():
        whole = min(most, int(target[s] // size[s])) if size[s] else 0
        rest = max(0.0, target[s] - whole * size[s]) if size[s] else 0.0
        plan[s] = (s, size[s], target[s], whole, rest, calibrated({k: w for k, (w, _) in own.items()}, rest) if rest else 0.0)
    same = F.col(x.source).eqNullSafe(F.col(x.s))

    def joined(df: DataFrame, more: dict, columns: str) -> DataFrame:
        rows = [p + more.get(s, ()) for s, p in plan.items() if not columns or s in more]
        made = spark.createDataFrame(rows, f"{x.s} string, {x.whole_size} long, {x.target} double, {x.whole} int, {x.rest} double, {x.factor} double" + columns)
        df = df.join(F.broadcast(made) if len(rows) <= _BROADCAST_ROWS else made, same)
        p = F.least(F.lit(1.0), F.col(x.factor) * F.pow(F.lit(2.0), size_class(F.col(x.size)) / 16))
        u = draw(F.col(x.key))
        # The rank odds(u) / odds(p) on a scale of 0 to 1: u (1 - p) / (u (1 - p) + p (1 - u)).
        return df.withColumn(x.place, F.when((F.col(x.rest) > 0) & (F.col(x.size) > 0), u * (1 - p) / (u * (1 - p) + p * (1 - u))))

    # (low, high, words before) of the bin of each source's cut, narrowed level by level.
    docs = {s: sum(n for _, n in own.values()) for s, own in sources.items()}
    cut = {s: (0.0, 1.0, 0) for s, p in plan.items() if p[4] > 0}
    wide = {s for s in cut if docs[s] > bin_rows}
    while wide:
        here = {s: (cut[s][0], cut[s][1], float(cut[s][2]), min(bins, -(-docs[s] * 2 // bin_rows))) for s in wide}
        ranked = joined(slim, here, f", {x.low} double, {x.high} double, {x.before} double, {x.bins} int").where((F.col(x.place) >= F.col(x.low)) & (F.col(x.place) < F.col(x.high)))
        bin_ = F.floor((F.col(x.place) - F.col(x.low)) / (F.col(x.high) - F.col(x.low)) * F.col(x.bins)).cast("int")
        counted = ranked.groupBy(x.s, x.rest, x.before, bin_.alias("bin")).agg(F.sum(x.size).alias("words"), F.count("*").alias("docs"))
        upto = F.col(x.before) + F.coalesce(F.sum("words").over(Window.partitionBy(x.s).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = counted.withColumn("upto", upto).where((F.col("upto") < F.col(x.rest)) & (F.col("upto") + F.col("words") >= F.col(x.rest)))
        wide = set()
        for s, b, before, n in found.select(x.s, "bin", "upto", "docs").collect():
            low, high, _, k = here[s]
            cut[s] = (low + (high - low) * b / k, low + (high - low) * (b + 1) / k, before)
            if n > 2 * bin_rows and k > 1 and high - low > 1e-12:
                docs[s] = n
                wide.add(s)
    final = {s: (*cut.get(s, (0.0, 0.0, 0)), plan[s][4] - cut.get(s, (0, 0, 0))[2]) for s in plan}
    final = {s: (float(a), float(b), float(c), float(d)) for s, (a, b, c, d) in final.items()}
    columns = f", {x.low} double, {x.high} double, {x.before} double, {x.left} double"
    inside = (F.col(x.place) >= F.col(x.low)) & (F.col(x.place) < F.col(x.high))
    equal = joined(slim, final, columns).where(inside).groupBy(F.col(x.s).alias("s"), F.col(x.key).alias("key"), F.col(x.place).alias("place"), F.col(x.size).alias("size"), F.col(x.left).alias("left")).agg(F.count("*").alias("n"))
    chosen = equal.groupBy("s").applyInPandas(fill, "s string, key long, take long").where("take > 0").select(F.col("s").alias(x.t), F.col("key").alias(x.k), F.col("take").alias(x.take))
    out = joined(sized, final, columns)
    sure = out.where(F.col(x.place).isNull() | ~inside).withColumn(x.extra, F.coalesce(F.col(x.place) < F.col(x.low), F.lit(False)).cast("int"))
    # Equal documents share a key; the first ones up to the number taken are taken.
    on = out.where(inside).join(chosen, F.col(x.s).eqNullSafe(F.col(x.t)) & (F.col(x.key) == F.col(x.k)), "left").withColumn(x.salt, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(64)))
    several = on.where(F.col(x.take).isNotNull()).select(x.s, x.key, x.take).groupBy(x.s, x.key, x.take).agg(F.count("*").alias(x.n)).where(F.col(x.n) > F.col(x.take))
    extra = F.col(x.take).isNotNull().cast("int")
    if several.isEmpty():  # every equal document of a key is taken, or none
        on = on.withColumn(x.extra, extra)
    else:
        on = checkpointed(on)
        counts = on.groupBy(x.s, x.key, x.salt).agg(F.count("*").alias(x.n))
        earlier = F.coalesce(F.sum(x.n).over(Window.partitionBy(x.s, x.key).orderBy(x.salt).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.select(F.col(x.s).alias(x.t2), F.col(x.key).alias(x.k2), F.col(x.salt).alias(x.salt2), earlier.alias(x.earlier))
        nth = F.row_number().over(Window.partitionBy(x.s, x.key, x.salt).orderBy(x.size))
        on = on.withColumn(x.nth, nth).join(counts, F.col(x.s).eqNullSafe(F.col(x.t2)) & (F.col(x.key) == F.col(x.k2)) & (F.col(x.salt) == F.col(x.salt2)))
        on = on.withColumn(x.extra, F.coalesce(F.col(x.nth) + F.col(x.earlier) <= F.col(x.take), F.lit(False)).cast("int"))
    given = [F.col(f"`{c}`") for c in sized.columns if c not in (x.size, x.source, x.key, *ADDED)]
    kept = [*given, F.col(x.size).alias("__size"), F.col(x.whole_size).alias("__source_size"), F.col(x.target).alias("__target"), (F.col(x.whole) + F.col(x.extra)).alias("__copies")]
    return sure.select(*kept).unionByName(on.select(*kept))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 20, bins: int = 1024, bin_rows: int = 2000) -> DataFrame:
    """The documents, all columns kept, with __size, __source_size, __target and __copies."""
    x = _Names()
    sized = _sized(docs, seed, x)
    return _decided(sized, checkpointed(sized.select(x.source, x.size, x.key)), x, weights, most, bins, bin_rows)


def mix_sizes(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 20, bins: int = 1024, bin_rows: int = 2000) -> DataFrame:
    """The same decisions without the texts, which are then read once: doc_id, source and the added columns."""
    x = _Names()
    slim = checkpointed(_sized(docs.select("doc_id", "source", "text"), seed, x).drop("text"))
    return _decided(slim, slim, x, weights, most, bins, bin_rows)
