"""Every query with SQL against that SQL, on the smallest tables."""

import glob
import importlib.util
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
OWN = sorted(n for n in entry.oracle_sql() if n.startswith("q_"))


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    try:
        return repr(round(float(value), 6))
    except (TypeError, ValueError):
        return str(value)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", OWN)
def test_query_matches_sql(spark, sql, name):
    found = entry.queries()[name](spark, SF)
    want = sql.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(names)
    rows = [tuple(plain(r[c]) for c in names) for r in found.collect()]
    assert sorted(rows) == sorted(tuple(map(plain, r)) for r in want.fetchall())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_imports_without_llm(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    spec = importlib.util.spec_from_file_location("entry_alone", entry.__file__)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert module.queries() and not any(n.startswith("op") for n in module.queries())
