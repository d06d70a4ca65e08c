"""Registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from postworks.plans import captured, catalogue

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, list) else value


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, sql, name):
    found = catalogue.QUERIES[name](spark, SF)
    got = sorted((tuple(plain(r[c]) for c in sorted(found.columns)) for r in found.collect()), key=repr)
    if name in catalogue.ORACLE_SQL:
        cur = sql.execute(catalogue.ORACLE_SQL[name])
        names = [d[0] for d in cur.description]
        expected = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in cur.fetchall()), key=repr)
        assert sorted(found.columns) == sorted(names)
        assert got == expected


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert captured.__name__ and catalogue.FLAGSHIP in entry.queries()
