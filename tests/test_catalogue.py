"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

from stratawise.plans import catalogue, catalogue_documents, catalogue_more  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    cell = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NA else v if isinstance(v, str) else round(float(v), 6)
    return sorted((tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, FOLDER).toPandas()
    if name in catalogue.ORACLES:
        want = duck.sql(catalogue.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_parsers_cover_whole_tables(spark):
    count = lambda t, k: spark.read.parquet(f"{FOLDER}/{t}.parquet").select(*k).distinct().count()
    for name, t, keys in (("costs_parse", "lineitem", ["l_orderkey", "l_linenumber"]), ("list_items_explode", "part", ["p_partkey"])):
        assert catalogue.QUERIES[name](spark, FOLDER).select(*keys).distinct().count() == count(t, keys) > 0


def test_entry_points():
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
