import duckdb
import pytest

from rivulet.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("events", "conversations"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = db.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted(tuple(plain(r[c]) for c in want.columns) for r in df.collect())
    assert got == sorted(tuple(map(plain, r)) for r in want.fetchall())
