"""Every registered query against its SQL on the smallest tables; those without SQL must run and give rows."""

import decimal
import math

import duckdb
import pytest

from corpuslake.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in catalogue.ORACLE_SQL:
        assert got
        return
    r = con.execute(catalogue.ORACLE_SQL[name])
    cols = [c[0] for c in r.description]
    order = sorted(cols)
    assert sorted(df.columns) == order
    want = sorted((tuple(plain(x[cols.index(c)]) for c in order) for x in r.fetchall()), key=repr)
    assert sorted((tuple(plain(x[c]) for c in order) for x in got), key=repr) == want
