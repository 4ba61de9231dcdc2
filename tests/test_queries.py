"""Every registered library query against its SQL on the same tables."""

import math

import duckdb
import pytest

from lumenlake.operators import queries as Q


def rows(columns, got):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(round(r[i], 6) if isinstance(r[i], float) and not math.isnan(r[i]) else str(r[i]) for i in order) for r in got)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings conversations".split():
        con.execute(f"create view {t} as from '{sf}/{t}.parquet'")
    want = con.execute(Q.ORACLES[name])
    columns = [d[0] for d in want.description]
    df = Q.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


def test_entry_has_them(spark):
    import __spark_entry__ as entry

    assert set(Q.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns
