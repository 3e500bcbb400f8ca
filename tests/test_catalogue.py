"""Every registered query of the engine against the same question in SQL."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from codeloom import catalogue

SF = "/root/testdata/sf0.001"
#: Regions come from moves that depend on their order; tests of the engine hold them against a plain version.
WITHOUT_SQL = {"region_map"}


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6f}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}') t")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, duck):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in WITHOUT_SQL:
        return
    result = duck.execute(catalogue.ORACLE_SQL[name])
    heads = [d[0] for d in result.description]
    assert sorted(heads) == columns
    assert got == sorted(tuple(plain(r[heads.index(c)]) for c in columns) for r in result.fetchall())
