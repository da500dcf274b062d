"""Every query with SQL gives DuckDB's rows at the smallest scale; the others give a row for each row of theirs."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    found = duck.execute(entry.oracle_sql()[name])
    types = {c[0]: str(c[1]) for c in found.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    order = sorted(types)
    at = [list(types).index(c) for c in order]
    assert sorted(repr(plain(tuple(r[c] for c in order))) for r in df.collect()) == sorted(repr(plain(tuple(r[i] for i in at))) for r in found.fetchall())


@pytest.mark.parametrize(("name", "n"), [("sources_cleaned", 150), ("compatibility", 200), ("guides", 20)])
def test_row_counts(spark, name, n):
    rows = entry.queries()[name](spark, DATA).collect()
    assert len(rows) == n


def test_entry(spark):
    assert entry.entry(spark).count() == 200 and set(entry.oracle_sql()) <= set(entry.queries())
