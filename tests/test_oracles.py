"""Every registered query of the reference's own operators against DuckDB on the same Parquet files."""

import datetime
import math
import os

import duckdb
import pytest

from marlow import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(([plain(r[c]) if not isinstance(r[c], list) else str(r[c]) for c in names] for r in df.collect()), key=str)
    if name not in plans.ORACLES:
        assert got
        return
    found = duck.execute(plans.ORACLES[name])
    columns = [x[0] for x in found.description]
    assert sorted(columns) == names
    want = sorted(([plain(dict(zip(columns, r))[c]) for c in names] for r in found.fetchall()), key=str)
    assert len(got) == len(want)
    assert got == want and want
