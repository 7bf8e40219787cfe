"""Every query against its SQL in DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from unitflow.plans import engine, formats, queries  # noqa: F401  the others add their own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return round(v, 9) if not math.isnan(v) else "nan"
    return v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, db, name):
    got = queries.QUERIES[name](spark, SF)
    want = db.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in sorted(want.columns)]
    expected = sorted((tuple(norm(r[i]) for i in order) for r in want.fetchall()), key=str)
    rows = sorted((tuple(norm(r[c]) for c in sorted(want.columns)) for r in got.collect()), key=str)
    assert rows and len(rows) == len(expected)
    assert [r for r, e in zip(rows, expected, strict=True) if r != e][:3] == [e for r, e in zip(rows, expected, strict=True) if r != e][:3]


def test_entry(spark):
    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_cache_is_read_from_files_after_its_first_join(spark):
    """Its three states don't each parse and join all texts again."""
    got = queries.QUERIES["cache_maintenance"](spark, SF)
    assert not [f for f in got.inputFiles() if "documents" in f]
