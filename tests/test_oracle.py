"""Every query with SQL gives the SQL's rows; the others give rows."""

import os
from collections import Counter

import duckdb
import pytest

from lumenframe.plans import queries as plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def counted(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_rows(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    rows = got.collect()
    if name not in plans.ORACLE_SQL:
        assert rows
        return
    want = duck.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    expected = want.fetchall()
    a, b = counted([tuple(r) for r in rows], got.columns), counted(expected, names)
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
