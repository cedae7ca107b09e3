"""Every registered query against its SQL on the smallest tables."""

import importlib.util
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
spec = importlib.util.spec_from_file_location("entry", Path(__file__).parents[1] / "__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat()
    return value


@pytest.mark.parametrize("name", sorted(entry.ORACLES))
def test_query_equals_sql(spark, sql, name):
    frame = entry.queries()[name](spark, FOLDER)
    order = sorted(frame.columns)
    cursor = sql.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == order
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in order)) for r in cursor.fetchall())
    got = sorted(repr(tuple(plain(r[c]) for c in order)) for r in frame.collect())
    assert got == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    """Of the page library; queries of the corpus operators have tests of their own."""
    assert set(entry.QUERIES) == set(entry.ORACLES)
