"""Every registered query that has SQL agrees with DuckDB at the smallest scale."""

import os

import duckdb
import pytest

from pagequarry.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "events", "conversations", "embeddings", "labels", "benchmark")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rounded(row):
    return tuple(round(v, 9) if isinstance(v, float) else v for v in row)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr(rounded(r[c] for c in columns)) for r in df.collect())
    if name not in catalogue.SQL:
        assert rows
        return
    found = con.execute(catalogue.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(repr(rounded(r[k] for k in at)) for r in found.fetchall())
