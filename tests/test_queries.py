"""Every registered query beside its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the sample tables")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return float(value) if type(value).__name__ == "Decimal" else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    result = duck.execute(entry.oracle_sql()[name])
    heads = [c[0] for c in result.description]
    assert sorted(heads) == sorted(got.columns)
    at = [heads.index(c) for c in got.columns]
    want = sorted(repr(tuple(plain(row[i]) for i in at)) for row in result.fetchall())
    assert sorted(repr(tuple(map(plain, row))) for row in got.collect()) == want


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
