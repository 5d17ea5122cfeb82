"""Every registered query of the core library against its SQL on the smallest tables."""

import decimal

import duckdb
import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    def one(x):
        if isinstance(x, (float, decimal.Decimal)) or (isinstance(x, int) and not isinstance(x, bool)):
            return f"{float(x):.6f}"
        return str(x)

    return sorted(tuple(one(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, SF)
    rows, columns = got.collect(), got.columns
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    found = con.execute(registry.ORACLE_SQL[name])
    theirs = [d[0] for d in found.description]
    assert sorted(columns) == sorted(theirs)
    order = sorted(columns)
    assert plain([[r[c] for c in order] for r in rows]) == plain([[r[theirs.index(c)] for c in order] for r in found.fetchall()])
