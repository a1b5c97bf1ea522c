"""Quality classifier: a sparse ensemble of rules, compiled to Spark columns.

Statistics of whole texts are Column expressions.  Shallow trees are boosted on
a bounded sample of labelled rows (``sample_rows``, taken by hash of the id, the
only sample here); every root-to-node path is a conjunctive rule.  A lasso
logistic regression over the rules keeps few of them, and the score, one Column,
runs over all documents in the same scan as the statistics.

Only text statistics are inputs.  An empty or null text has all statistics zero
and is scored like any other, a very long one by the same counts; repeated rows get
repeated scores, and an id with labels of both kinds counts as label 1; with no labelled
row of one of the classes the score is the share of label 1 (0.5 without labels).  An
empty table has no scores.  Columns of the table keep their values and names.  Of repeated
ids at most ``sample_rows`` further rows of other statistics are learnt from.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The statistics, in the order of the model's columns.
STATISTICS = ("words", "word_length", "distinct", "variety", "upper", "symbols", "marks", "bars", "digits", "stops", "line_words")


def statistics(docs: DataFrame, prefix: str) -> DataFrame:
    """The rows with one column for each statistic, ``prefix`` and its name, from the whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def count(others: str) -> Column:
        return F.length(F.regexp_replace(text, others, ""))

    words = f"{prefix}list"
    out = docs.withColumn(words, F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""))
    size, distinct = F.size(words), F.size(F.array_distinct(words))
    out = out.withColumns({f"{prefix}size": size, f"{prefix}letters": count(r"[^\p{L}]+"), f"{prefix}different": distinct})
    size, letters, distinct = F.col(f"{prefix}size"), F.col(f"{prefix}letters"), F.col(f"{prefix}different")
    n = F.greatest(size, F.lit(1))
    columns = {
        "words": size.cast("double"),
        "word_length": letters / n,
        "distinct": distinct / n,
        # log distinct over log words: of like height in short and long texts
        "variety": F.when(size > 1, F.log(distinct.cast("double")) / F.log(size.cast("double"))).otherwise(F.lit(1.0)),
        "upper": count(r"[^\p{Lu}]+") / F.greatest(letters, F.lit(1)),
        "symbols": count(r"[^#*$%&<>]+") / n,
        "marks": count(r"[^!?]+") / n,
        "bars": count(r"[^|]+") / n,
        "digits": count(r"[^0-9]+") / n,
        "stops": count(r"[^.,]+") / n,
        "line_words": n / (1 + count(r"[^\n]+")),
    }
    # Made by a generator of one row: a later filter on the score can't be pushed below it,
    # where it would repeat the statistics in every rule.
    row = F.inline(F.array(F.struct(*[F.round(v, 6).alias(f"{prefix}{k}") for k, v in columns.items()])))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], row)


@dataclass(frozen=True)
class RuleModel:
    """bias + sum of weights of the rules that hold; a rule is a conjunction of (statistic, is_above, bound)."""

    bias: float
    rules: tuple[tuple[tuple[tuple[int, bool, float], ...], float], ...]

    def score(self, prefix: str) -> Column:
        total = F.lit(self.bias)
        for parts, weight in self.rules:
            holds = F.lit(True)
            for k, above, bound in parts:
                c = F.col(f"{prefix}{STATISTICS[k]}")
                holds = holds & (c > bound if above else c <= bound)
            total = total + F.when(holds, weight).otherwise(0.0)
        return F.round(1 / (1 + F.exp(-total)), 9)


def _split(x: np.ndarray, residual: np.ndarray, hessian: np.ndarray, least: int) -> tuple[float, int, float] | None:
    """The split of best gain: (gain, statistic, bound)."""
    best = None
    for k in range(x.shape[1]):
        order = np.argsort(x[:, k], kind="stable")
        v, g, h = x[order, k], np.cumsum(residual[order]), np.cumsum(hessian[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        cut = cut[(cut + 1 >= least) & (len(v) - cut - 1 >= least)]
        if len(cut):
            gain = g[cut] ** 2 / (h[cut] + 1) + (g[-1] - g[cut]) ** 2 / (h[-1] - h[cut] + 1)
            i = int(np.argmax(gain))
            if best is None or gain[i] > best[0] + 1e-12:
                best = float(gain[i]), k, float((v[cut[i]] + v[cut[i] + 1]) / 2)
    return best


def _grow(x: np.ndarray, residual: np.ndarray, hessian: np.ndarray, depth: int, least: int, path: tuple, rows: np.ndarray, paths: list, fitted: np.ndarray) -> None:
    found = _split(x[rows], residual[rows], hessian[rows], least) if depth and len(rows) >= 2 * least else None
    if path:
        paths.append(path)
    if not found:
        fitted[rows] = residual[rows].sum() / (hessian[rows].sum() + 1)
        return
    _, k, bound = found
    for above in (False, True):
        own = rows[(x[rows, k] > bound) == above]
        _grow(x, residual, hessian, depth - 1, least, (*path, (k, above, bound)), own, paths, fitted)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 2, rate: float = 0.3, least: int = 5) -> list[tuple]:
    """The paths of boosted trees, each once."""
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    margin, paths = np.full(len(y), math.log(share / (1 - share))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))
        _grow(x, y - p, p * (1 - p), depth, least, (), np.arange(len(y)), paths, step)
        margin += rate * step
    return sorted(set(paths))


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 600) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient; the bias is not penalised."""
    n, m = z.shape
    weight, bias, ahead, bias_ahead, t = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
    step = 4.0 / (1 + np.linalg.norm(z, 2) ** 2 / n if m else 1.0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ ahead + bias_ahead, -40, 40)))
        error = (p - y) / n
        new = ahead - step * (z.T @ error)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_bias = bias_ahead - step * error.sum()
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, bias_ahead = new + (t - 1) / t_new * (new - weight), new_bias + (t - 1) / t_new * (new_bias - bias)
        weight, bias, t = new, new_bias, t_new
    return bias, weight


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.002) -> RuleModel:
    if not len(y):
        return RuleModel(0.0, ())
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    if y.min() == y.max():
        return RuleModel(math.log(share / (1 - share)), ())
    paths = tree_rules(x, y)
    z = np.ones((len(y), len(paths)))
    for j, parts in enumerate(paths):
        for k, above, bound in parts:
            z[:, j] *= (x[:, k] > bound) == above
    bias, weight = lasso_logistic(z, y, penalty)
    return RuleModel(round(float(bias), 6), tuple((p, round(float(w), 6)) for p, w in zip(paths, weight, strict=True) if abs(w) > 1e-4))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000) -> RuleModel:
    """Fit on at most ``sample_rows`` labelled rows; ids whose CRC-32 modulo 3 is 1 are held out."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    picked = usable.groupBy("doc_id").agg(F.max("quality").alias("__label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # At most sample_rows ids: a list of fixed bound, so the scan stays free of shuffles.
    prefix = _prefix()
    own = docs.select("doc_id", "text").join(F.broadcast(picked.withColumnRenamed("doc_id", "__id")), F.col("doc_id") == F.col("__id"))
    # Rows of a repeated id with equal statistics count once, before any of them come to the driver.
    rows = statistics(own, prefix).select("__id", "__label", *[f"{prefix}{k}" for k in STATISTICS]).distinct().orderBy(F.xxhash64("__id"), "__id", *[f"{prefix}{k}" for k in STATISTICS]).limit(2 * sample_rows).collect()
    rows = sorted({tuple(r) for r in rows}, key=lambda r: r)
    x = np.array([r[2:] for r in rows], dtype=float).reshape(len(rows), len(STATISTICS))
    return fit(x, np.array([float(r[1] > 0) for r in rows]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _prefix() -> str:
    """A prefix of column names that no table has."""
    return f"s_{uuid.uuid4().hex}_"


def score_quality(docs: DataFrame, model: RuleModel) -> DataFrame:
    """All rows and columns with __score (0 to 1) and __predicted, which replace columns of these names."""
    prefix = _prefix()
    scored = statistics(docs.drop("__score", "__predicted"), prefix).withColumn("__score", model.score(prefix)).withColumn("__predicted", (F.col("__score") >= 0.5).cast("int"))
    return scored.drop(*[f"{prefix}{k}" for k in STATISTICS])
