"""Order-defined survival: which of several rows with one key counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """One row a key: the first by ``order``, which must be total to be repeatable.

    Written as row_number = 1, which Spark turns into a per-partition group limit
    before the shuffle, so a hot key sends one row a task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a key: the last by the given columns."""
    return first_wins(df, keys, [F.col(c).desc_nulls_last() for c in order])


def ranked_union(sources: Sequence[tuple[str, DataFrame]], tag: str = "_db", rank: str = "_rank") -> DataFrame:
    """All rows of all sources with their name and their place in the list."""
    tagged = [df.withColumns({tag: F.lit(name), rank: F.lit(i)}) for i, (name, df) in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def union_first_wins(sources: Sequence[tuple[str, DataFrame]], keys: Sequence[str], within: Sequence[Column] = ()) -> DataFrame:
    """Ranked union in which an earlier source hides a key of a later one."""
    return first_wins(ranked_union(sources), keys, [F.col("_rank"), *within]).drop("_rank")


def overlay(base: DataFrame, over: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Base rows whose key the overlay lacks, and all overlay rows."""
    return base.join(over.select(*keys).distinct(), list(keys), "left_anti").unionByName(over)


def overlay_tombstones(base: DataFrame, over: DataFrame, keys: Sequence[str], deleted: str) -> DataFrame:
    """Overlay in which a row marked deleted removes its key."""
    kept = over.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted)
    return base.join(over.select(*keys).distinct(), list(keys), "left_anti").unionByName(kept)


def keep_under_survivors(children: DataFrame, survivors: DataFrame, on: Sequence[str]) -> DataFrame:
    """Children of surviving parents only: a parent that lost takes its subtree along."""
    return children.join(survivors.select(*on).distinct(), list(on), "left_semi")


def newest(df: DataFrame, order: Column, n: int) -> DataFrame:
    """The n rows that come first by ``order``; a top-k, not a full sort."""
    return df.orderBy(order).limit(n)


def module_priority(name: Column, priorities: dict[str, int], default: int) -> Column:
    """Precedence number of a module name."""
    found = F.lit(default)
    for module, value in priorities.items():
        found = F.when(name == module, F.lit(value)).otherwise(found)
    return found


def synthetic_key(*parts: Column) -> Column:
    """A repeatable key for rows without one."""
    return F.concat(F.lit("_row_"), F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256).substr(1, 16))


def main_table(tables: DataFrame) -> DataFrame:
    """Per region the table to query: no parents first, then ``…__root`` parents, then more rows, then name."""
    group = F.when(F.coalesce("parent_tables", F.lit("")) == "", 0).when(F.col("parent_tables").endswith("__root"), 1).otherwise(2)
    return first_wins(tables, ["region_id"], [group, F.col("row_count").desc_nulls_last(), F.col("table_name")])


def present_in(df: DataFrame, key: str, sources: Sequence[DataFrame]) -> DataFrame:
    """Rows whose key some source has; sources are united before the one semi join."""
    return df.join(reduce(lambda a, b: a.unionByName(b), [s.select(key) for s in sources]), key, "left_semi")
