"""Every query with SQL returns the same rows as DuckDB over the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from auditlake.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 9)
        return v

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_duckdb(spark, duck, name):
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = plain(df.select(*columns).collect())
    cur = duck.execute(oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = plain([tuple(r[names.index(c)] for c in columns) for r in cur.fetchall()])
    assert sorted(names) == columns
    assert got == want


def test_names_do_not_clash_and_queries_have_sql():
    assert set(oracle_sql()) <= set(queries())
    assert len(oracle_sql()) >= 60
