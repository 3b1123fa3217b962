"""Queries against their SQL on rows where roundings and boundaries differ."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from marlow import plans


def compared(spark, folder, name, table, rows):
    """Rows of a query and of its SQL over a small table."""
    pq.write_table(rows, f"{folder}/{table}.parquet")
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    found = c.execute(plans.ORACLES[name])
    columns = [x[0] for x in found.description]
    want = sorted(map(tuple, found.fetchall()))
    got = sorted(tuple(r) for r in plans.QUERIES[name](spark, str(folder)).select(*columns).collect())
    return got, want


def test_colour_at_half_brightness(spark, tmp_path):
    # 62594 * 7919 is #8B815E: 299 * 139 + 587 * 129 + 114 * 94 is 128000, no less
    got, want = compared(spark, tmp_path, "customer_colours", "customer", pa.table({"c_custkey": pa.array([1, 62593, 62594, 62595], pa.int64())}))
    assert got == want and not dict((r[0], r[3]) for r in got)[62594]


def test_half_of_a_decimal_goes_to_the_even_one(spark, tmp_path):
    # 262144 * 12345 / 2 ** 20 is 3086.25, 786432 the same with 9258.75
    keys = [1, 262143, 262144, 262145, 786432]
    got, want = compared(spark, tmp_path, "scales", "customer", pa.table({"c_custkey": pa.array(keys, pa.int64()), "c_acctbal": [-1.0, 0.5, 595.75, 5000.0, 7000.0], "c_nationkey": pa.array([0, 1, 5, 8, 16], pa.int32())}))
    assert got == want and {r[4] for r in got} >= {"3086.2 GB", "9258.8 GB"}


def test_poll_at_the_nearest_second(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1, 23, 59, 59)
    micros = [0, 499_999, 500_000, 500_001, 999_999, 1_000_000, -86_400_000_000, -500_000]
    ts = [day + datetime.timedelta(microseconds=m) for m in micros]
    rows = pa.table({"user_id": pa.array([0, 1, 2, 3, 4, 5, 6, 6], pa.int64()), "ts": pa.array(ts, pa.timestamp("us")), "value": [float(i) for i in range(8)]})
    got, want = compared(spark, tmp_path, "polled_values", "events", rows)
    assert got == want and len({r[1] for r in got}) == 3
