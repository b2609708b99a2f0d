"""The registered queries run and agree with their SQL."""

import importlib
import os

import duckdb
import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in e.queries() if n in e.oracle_sql()]


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return float(f"{v:.7g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_its_sql(spark, tables, name):
    df = e.queries()[name](spark, SF)
    names = sorted(df.columns)
    found = tables.execute(e.oracle_sql()[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == names
    want = sorted((tuple(plain(r[order.index(c)]) for c in names) for r in found.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    assert got == want


def test_every_query_with_sql_is_registered():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert importlib.import_module("tessera.plans.catalog").queries()


def test_entry(spark):
    if os.path.isdir(SF):
        assert e.entry(spark).columns == ["lang", "doc_id", "idx", "jsd", "rank"]
