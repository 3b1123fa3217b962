"""Scans over shards against loops: one key with all rows, many small keys, null keys, ties."""

import random

import pytest
from pyspark.sql import functions as F

from marlow.operators import scans, series


def table(spark, n, keys, seed=1):
    r = random.Random(seed)
    rows = [(keys[r.randrange(len(keys))], r.randrange(n * 3), k, None if r.random() < 0.4 else float(r.randrange(100))) for k in range(n)]
    return rows, spark.createDataFrame(rows, "k string, t int, id int, v double").repartition(7)


def groups(rows):
    out = {}
    for row in sorted(rows, key=lambda x: (x[1], x[2])):
        out.setdefault(row[0], []).append(row)
    return out


@pytest.mark.parametrize("keys", [["a"], ["a", "a", "a", "b", None], list("abcdefghijklmnopqrstuvwxyz") * 4 + [None]])
def test_against_loops(spark, keys):
    rows, df = table(spark, 700, keys)
    by = (["k"], ["t", "id"])
    want = {}
    for g in groups(rows).values():
        known, total = None, 0.0
        filled = [x[3] if x[3] is not None else 0.5 for x in g]
        for i, x in enumerate(g):
            known = x[3] if x[3] is not None else known
            total += x[3] or 0.0
            nxt = next((y[3] for y in g[i + 1 :] if y[3] is not None), None)
            around = [filled[min(max(j, 0), len(g) - 1)] for j in range(i - 3, i + 4)]
            want[x[2]] = (i + 1, 100 * (i + 1) / len(g), known, nxt, total, sum(around) / 7)
    got = scans.numbered(df, *by, percent="p")
    got = scans.last_known(got, F.col("v"), *by, "last")
    got = scans.next_known(got, F.col("v"), *by, "next")
    got = scans.running_sum(got, F.col("v"), *by, "sum")
    got = scans.clamped_average(got, F.coalesce("v", F.lit(0.5)), *by, "smooth", radius=3)
    assert got.columns == ["k", "t", "id", "v", "number", "p", "last", "next", "sum", "smooth"]
    got = {r.id: tuple(r)[4:] for r in got.collect()}
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i] == pytest.approx(w), i


def test_one_key_is_spread_over_tasks(spark):
    rows, df = table(spark, 4000, ["a"])
    placed = scans.sharded(df, ["k"], ["t", "id"])
    sizes = [r["count"] for r in placed.groupBy("_shard").count().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 2 * 4000 / len(sizes)
    at = [r.id for r in placed.orderBy("_at").collect()]
    assert at == [x[2] for x in sorted(rows, key=lambda x: (x[1], x[2]))]


def test_ties_are_spread_too(spark):
    df = spark.range(3000).select(F.lit("a").alias("k"), F.lit(1).alias("t"), "id")
    sizes = [r["count"] for r in scans.sharded(df, ["k"], ["t"]).groupBy("_shard").count().collect()]
    assert max(sizes) < 2 * 3000 / int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(r.number for r in scans.numbered(df, ["k"], ["t"]).collect()) == list(range(1, 3001))


def test_no_rows_and_descending(spark):
    _, df = table(spark, 50, ["a"])
    assert scans.clamped_average(df.limit(0), F.col("v"), ["k"], ["t"], "s").count() == 0
    got = [r.id for r in scans.numbered(df, [], [F.desc("id")]).orderBy("number").collect()]
    assert got == list(range(49, -1, -1))


def test_shards_grow_in_number_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(scans, "SHARD_ROWS", 100)
    df = spark.range(2000).select("id", (F.col("id") % 7).alias("v"))
    sizes = [r["count"] for r in scans.sharded(df, [], ["id"]).groupBy("_shard").count().collect()]
    assert sum(sizes) == 2000 and len(sizes) >= 15 and max(sizes) <= 400
    out = scans.numbered(df, [], ["id"], percent="p", total=F.col("v")).collect()
    assert sorted((r.id, r.number, r.p, r.total) for r in out) == [(i, i + 1, 100 * (i + 1) / 2000, sum(j % 7 for j in range(i + 1))) for i in range(2000)]


def test_no_frame_is_folded_anew_for_each_row(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 9 == 4, F.col("id")).alias("v"), (F.col("id") % 3).alias("k"))
    both = scans.around(df, F.col("v"), ["k"], ["id"], last="a", following="b")
    marked = df.select("id", series.next_marked(F.col("id"), F.col("v").isNotNull(), ["k"], ["id"]).alias("b"))
    for out in (both, marked):
        assert "unboundedfollowing" not in out._jdf.queryExecution().executedPlan().toString().lower()
    v = lambda k, js: next((j for j in js if j % 3 == k and j % 9 == 4), None)
    assert sorted((r.id, r.a, r.b) for r in both.collect()) == [(i, v(i % 3, range(i, -1, -1)), v(i % 3, range(i + 1, 100))) for i in range(100)]
    assert sorted((r.id, r.b) for r in marked.collect()) == [(i, v(i % 3, range(i + 1, 100))) for i in range(100)]
