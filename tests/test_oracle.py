"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from lodeframe.plans import queries as core
from tests.conftest import TESTDATA


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"{v:.6f}"
    return str(v)


def rows(df: pd.DataFrame):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v) else plain(v) for v in r) for r in df.astype(object).values.tolist())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{TESTDATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_equals_sql(spark, duck, name):
    ours = core.QUERIES[name](spark, TESTDATA).toPandas()
    theirs = duck.sql(core.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry_has_rows_and_every_oracle_a_query(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(core.QUERIES) <= set(entry.queries())


def test_core_imports_nothing_of_the_optional_subpackage():
    for path in glob.glob("lodeframe/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "lodeframe.llm" not in open(path).read(), path
