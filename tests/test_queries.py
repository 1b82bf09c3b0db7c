"""Every query with SQL against DuckDB on the smallest tables, where these are at hand."""

import os

import pytest

from gazeloom.plans.queries import QUERIES, SQL

DATA = os.environ.get("QUERY_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return float(f"{v:.8g}")
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    found = duck.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    got, want = rows(df.columns, df.collect()), rows(names, found.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, rel=1e-7) if all(isinstance(x, (int, float)) for x in (*a, *b)) else a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_folds_run(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    assert QUERIES[name](spark, DATA).count() > 0
