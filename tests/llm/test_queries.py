"""Registered queries of the subpackage against their SQL."""

import duckdb
import pytest

from lodestone.llm import queries

TABLES = ("documents", "embeddings", "labels")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    got = queries.queries()[name](spark, small)
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    plain = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(want.fetchall())


def test_one_query_for_each_operator():
    assert [f"op{n}" for n in range(1, 11)] == sorted((q.split("_")[0] for q in queries.queries()), key=lambda q: int(q[2:]))
