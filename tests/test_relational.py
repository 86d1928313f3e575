import os

import duckdb
import pytest

from lakeloom.plans import relational

SF = "/root/testdata/sf0.001"


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr(tuple(round(r[k], 6) + 0.0 if isinstance(r[k], float) else r[k] for k in order)) for r in data)


@pytest.mark.parametrize("name", sorted(relational.QUERIES))
def test_same_rows_as_duckdb(spark, name):
    df = relational.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    want = con.execute(relational.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    got = df.collect()
    assert got and rows(df.columns, got) == rows(names, want.fetchall())
