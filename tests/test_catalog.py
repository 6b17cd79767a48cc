"""Every registered query against its SQL, row by row, on the smallest tables."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from gridloom.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return db


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    return v if isinstance(v, (int, str, bool, type(None))) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT * FROM ({ORACLE[name].strip().rstrip(';')})" if not ORACLE[name].lstrip().startswith("PIVOT") else ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = Counter(tuple(norm(r[k]) for k in order) for r in want.fetchall())
    assert Counter(tuple(norm(r[c]) for c in columns) for r in got.collect()) == expected


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
