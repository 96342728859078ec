"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from glossa.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    if name not in catalog.oracle_sql():
        assert mine
        return
    other = duck.sql(catalog.oracle_sql()[name])
    assert sorted(other.columns) == cols
    names = ", ".join(f'"{c}"' for c in cols)
    theirs = sorted((tuple(plain(v) for v in r) for r in duck.sql(f"SELECT {names} FROM ({catalog.oracle_sql()[name]})").fetchall()), key=repr)
    assert mine == theirs
