"""Registered queries of the engine against their SQL, over the smallest tables."""

import duckdb
import pytest

from lodestone.plans import queries

TABLES = "region nation customer documents embeddings pages benchmark labels".split()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(queries.REGISTRY))
def test_equals_sql(spark, small, con, name):
    run, sql = queries.REGISTRY[name]
    got = run(spark, small)
    if sql is None:
        assert got.count() > 0
        return
    want = con.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    plain = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
