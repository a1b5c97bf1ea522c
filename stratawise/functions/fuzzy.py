"""Greedy fuzzy scoring, sequential by nature, as an Arrow-batched pandas UDF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Points of each hit; further ones right after the hit before, at a word's start, and for a whole prefix.
HIT, RUN, WORD_START, PREFIX = 1, 5, 10, 20


def begins_word(target: str, at: int) -> bool:
    """At the beginning, after white space, - or _, or where capitals (or digits) follow what isn't one."""
    if at == 0 or at >= len(target):
        return True
    before, here = target[at - 1], target[at]
    return before.isspace() or before in "-_" or (before == before.lower() and here == here.upper())


def score(query: str, target: str | None) -> int | None:
    """Points of matching the query's characters in order, each at its first place; null without a match, 0 without a query."""
    if target is None or not query:
        return None if target is None else 0
    low, wanted, places, at = target.lower(), query.lower(), [], -1
    for c in wanted:
        at = low.find(c, at + 1)
        if at < 0:
            return None
        places.append(at)
    total = sum(HIT + WORD_START * begins_word(target, p) for p in places)
    total += sum(RUN for a, b in zip(places, places[1:], strict=False) if b == a + 1)
    return total + PREFIX * low.startswith(wanted)


def fuzzy_score(target: Column, query: str) -> Column:
    @F.pandas_udf(IntegerType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: score(query, v)).astype("Int32")

    return run(target)
