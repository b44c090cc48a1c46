"""Every query with SQL against DuckDB, at the smallest scale."""

import numbers

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def one(v):
        if pd.isna(v):
            return ""
        number = isinstance(v, numbers.Number) and not isinstance(v, (bool, np.bool_))
        return f"{float(v):.6f}" if number else str(v)  # integers with nulls come as floats from one side

    cols = sorted(frame.columns)
    return sorted(tuple(map(one, row)) for row in frame[cols].itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, sf_dir, duck, name):
    ours, theirs = entry.queries()[name](spark, sf_dir).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
