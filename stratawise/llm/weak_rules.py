"""Quality rules under weak supervision, all in DataFrame functions.

Each rule votes good, bad or abstains on a document from its whole text; most rules
know only one kind of fault, so they vote bad or abstain.  Rules are noisy judges:
expectation-maximisation over the counts of vote patterns (at most 3 to the number of
rules, whatever the number of documents) estimates the share of good documents and how
often each rule's votes are right, and a document is kept when its posterior
probability of being good is at least one half.  An abstention says nothing.  The
posterior is a sum of log weights, compiled to one Column expression.

Words are runs of characters other than space and \\t..\\r.  A null text has no
words.  A hard base rule (too few words, or too many of them in repeated 5-word
windows) overrides the posterior.  Repeated rows give repeated results; over an
empty table the prior weights stand.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratawise.llm.common import checkpointed

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, good where ``good`` holds, else abstains."""

    name: str
    bad: Column
    good: Column


def rules() -> list[Rule]:
    n, c, never = F.col("n_words"), F.col, F.lit(False)
    return [
        Rule("length", n < 10, never),
        Rule("word_length", (c("word_chars") < 2 * n) | (c("word_chars") > 15 * n), never),
        Rule("symbols", c("n_symbols") * 10 > n, never),
        Rule("shouting", c("n_upper") * 2 > c("n_letters"), never),
        Rule("marks", c("n_marks") * 3 > n, never),
        Rule("repeats", c("n_repeat_words") * 5 > n, never),
        Rule("lines", c("n_dup_lines") * 3 > c("n_lines"), never),
        Rule("variety", c("n_distinct") * c("n_distinct") < n, never),
        Rule("sentences", (n >= 50) & (c("n_stops") == 0), (n >= 10) & (c("n_stops") * 40 >= n) & (c("n_stops") * 2 <= n)),
    ]


def _count(text: Column, kept: str) -> Column:
    """Characters of a class, given the pattern of all others."""
    return F.length(F.regexp_replace(text, kept, "")).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that rules read, one pass, no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # Splitting leaves an empty string where a text begins or ends with white space.
    base = base.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    base = base.withColumn("n_words", F.size("words").cast("long"))
    hashes = F.expr(f"""CASE WHEN n_words < {WINDOW} THEN CAST(array() AS array<bigint>)
        ELSE transform(sequence(1, CAST(n_words AS int) - {WINDOW - 1}), i -> xxhash64(slice(words, i, {WINDOW}))) END""")
    base = base.withColumn("windows", hashes)
    # Windows that occur twice, by sorting (hash, position) and looking at both neighbours.
    again = F.expr(f"""CASE WHEN size(windows) = size(array_distinct(windows)) THEN 0L ELSE
        aggregate(
            array_sort(transform(
                filter(
                    transform(array(array_sort(transform(windows, (h, i) -> struct(h AS h, i AS i)))), s ->
                        filter(transform(s, (x, k) -> IF((k > 0 AND s[k - 1].h = x.h) OR (k + 1 < size(s) AND s[k + 1].h = x.h), x.i, -1)), p -> p >= 0))[0],
                    p -> true), p -> p)),
            struct(0L AS n, -{WINDOW} AS last),
            (a, p) -> struct(a.n + least({WINDOW}, p - a.last) AS n, p AS last),
            a -> a.n) END""")
    lines = F.expr(r"filter(split(text, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')")
    return base.select(
        "doc_id",
        "n_words",
        F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        _count(F.col("text"), r"[^#*$%&|<>]+").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        again.alias("n_repeat_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        _count(F.col("text"), r"[^\p{Lu}]+").alias("n_upper"),
        _count(F.col("text"), r"[^\p{L}]+").alias("n_letters"),
        _count(F.col("text"), r"[^!?]+").alias("n_marks"),
        _count(F.col("text"), r"[^.,]+").alias("n_stops"),
    )


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


@dataclass(frozen=True)
class Model:
    """Share of good documents, and for each rule the share among those it votes bad and votes good on."""

    share: float
    bad: tuple[float, ...]
    good: tuple[float, ...]

    def weights(self) -> list[tuple[float, float]]:
        """Log-odds that a bad and a good vote of each rule add to those of the share."""
        base = _logit(self.share)
        return [(_logit(b) - base, _logit(g) - base) for b, g in zip(self.bad, self.good, strict=True)]

    def log_odds(self, votes: tuple[int, ...]) -> float:
        return _logit(self.share) + sum((b if v < 0 else g) if v else 0.0 for v, (b, g) in zip(votes, self.weights(), strict=True))


#: Before any data: the share of good documents, overall and under a bad and a good vote.
PRIOR = (0.85, 0.05, 0.93)


def fit(patterns: dict[tuple[int, ...], int], n_rules: int, rounds: int = 50, strength: float = 0.5) -> Model:
    """EM from a prior in which votes are mostly right.

    Half as many prior votes stand beside each rule's own, so a rule that no other ever
    meets keeps its prior, while rules that meet correct each other; and a rule never
    counts against its own sense.  Documents without a vote say nothing about the share,
    so it is estimated beside as many prior documents and stays above one half: where all
    rules abstain, a document is kept.
    """
    share, prior_bad, prior_good = PRIOR
    model = Model(share, (prior_bad,) * n_rules, (prior_good,) * n_rules)
    items, total = sorted(patterns.items()), sum(patterns.values())
    for _ in range(rounds if total else 0):
        weight = [n / (1 + math.exp(-max(-60.0, min(60.0, model.log_odds(v))))) for v, n in items]
        share = min(max((sum(weight) + total * PRIOR[0]) / (2 * total), 0.55), 0.98)
        bad, good = [], []
        for j in range(n_rules):
            for sign, prior, out in ((-1, prior_bad, bad), (1, prior_good, good)):
                cast = sum(n for v, n in items if v[j] == sign)
                own = sum(w for (v, _), w in zip(items, weight, strict=True) if v[j] == sign)
                k = max(10.0, strength * cast)
                p = min(max((own + k * prior) / (cast + k), 1e-4), 1 - 1e-4)
                out.append(min(p, share) if sign < 0 else max(p, share))
        model = Model(share, tuple(bad), tuple(good))
    return model


def _vote(rule: Rule) -> Column:
    return F.when(rule.bad, -1).when(rule.good, 1).otherwise(0)


def judge(docs: DataFrame) -> tuple[DataFrame, Model]:
    """Every document's statistics with base_failed, probability and kept; and the model."""
    counts = checkpointed(statistics(docs))
    own = rules()
    votes = [_vote(r).alias(f"vote_{r.name}") for r in own]
    seen = counts.select(*votes).groupBy(*[f"vote_{r.name}" for r in own]).count()
    model = fit({tuple(int(x) for x in r[:-1]): r[-1] for r in seen.collect()}, len(own))
    # Rounded so that the order of additions can't decide a document.
    odds = F.lit(_logit(model.share))
    for r, (bad, good) in zip(own, model.weights(), strict=True):
        odds = odds + F.when(r.bad, bad).when(r.good, good).otherwise(0.0)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    scored = counts.withColumn("probability", F.round(1 / (1 + F.exp(-odds)), 9)).withColumn("base_failed", failed)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= 0.5)), model
