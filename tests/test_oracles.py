"""Every query against its SQL on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from footreach import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_oracle(spark, name):
    out = plans.QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in (x.asDict(True) for x in out.collect())), key=repr)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.sql(plans.ORACLES[name])
    assert sorted(found.columns) == columns
    want = sorted((tuple(plain(dict(zip(found.columns, r))[c]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == want
    assert got or name in {"nothing"}
