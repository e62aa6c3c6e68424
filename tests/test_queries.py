"""Each registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__

QUERIES = [n for n in __spark_entry__._markup.QUERIES]


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return con


def rows(df):
    return df[sorted(df.columns)].astype(str).sort_values(sorted(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf_dir, oracle, name):
    found = __spark_entry__.queries()[name](spark, sf_dir).toPandas()
    assert len(found)
    if name in __spark_entry__.oracle_sql():
        assert rows(found).equals(rows(oracle.execute(__spark_entry__.oracle_sql()[name]).df()))
