"""References between tables of several namespaces."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unresolved(df: DataFrame, column: str, target: DataFrame, target_key: str, fallbacks: Sequence[DataFrame] = ()) -> DataFrame:
    """Distinct non-null values of a reference that neither the target nor a fallback has.

    Anti-joins on distinct values: null targets can't hide findings, and no row is counted twice."""
    values = df.select(F.col(column).alias("value")).where("value is not null").distinct()
    for t in (target, *fallbacks):
        values = values.join(t.select(F.col(target_key).alias("value")).where("value is not null"), "value", "left_anti")
    return values


def reference_report(df: DataFrame, column: str, target: DataFrame, target_key: str, fallbacks: Sequence[tuple[str, DataFrame]] = ()) -> DataFrame:
    """(status, rows): rows that resolve in the target, in each fallback by order, or nowhere; null rows left out."""
    out = df.select(F.col(column).alias("value")).where("value is not null")
    found = F.lit(None).cast("string")
    for name, t in (("main", target), *fallbacks):
        keys = t.select(F.col(target_key).alias("value")).where("value is not null").distinct().withColumn(f"__{name}", F.lit(name))
        out = out.join(keys, "value", "left")
        found = F.coalesce(found, F.col(f"__{name}"))
    return out.groupBy(F.coalesce(found, F.lit("unresolved")).alias("status")).agg(F.count("*").alias("rows"))


def backfill(target: DataFrame, key: str, references: Sequence[tuple[DataFrame, str]], fallback: DataFrame | None = None, **defaults) -> DataFrame:
    """The target and a placeholder row for every referenced key that it and the fallback lack."""
    wanted = reduce(DataFrame.union, [df.select(F.col(c).alias(key)) for df, c in references]).where(F.col(key).isNotNull()).distinct()
    missing = wanted.join(target.select(key), key, "left_anti")
    if fallback is not None:
        missing = missing.join(fallback.select(key), key, "left_anti")
    rest = [F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name) for f in target.schema if f.name != key]
    return target.unionByName(missing.select(key, *rest))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unknown_references(df: DataFrame, column: str, names: DataFrame, name: str, known: Sequence[str] = ()) -> DataFrame:
    """Rows that refer to a name which is neither in the table nor well known."""
    out = df.where(F.col(column).isNotNull() & ~F.col(column).isin(list(known) or [""]))
    return out.join(names.select(F.col(name).alias(column)).distinct(), column, "left_anti")


def integrity_check(df: DataFrame, keys: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """(problem, n): duplicate keys, null keys and nulls in required columns; empty when sound."""
    found = [duplicates(df, keys).agg(F.lit("duplicate key").alias("problem"), F.count("*").alias("n"))]
    found += [df.where(F.col(c).isNull()).agg(F.lit(f"null {c}").alias("problem"), F.count("*").alias("n")) for c in (*keys, *required)]
    return reduce(DataFrame.union, found).where("n > 0")
