"""Joins with crowded keys, and the folder for tables."""

import types

import pytest
from pyspark.sql import functions as F

from marlow.llm import _graph, _io


@pytest.mark.parametrize("most", [200_000, 1])
def test_crowded_keys_are_dealt_at_any_number(spark, monkeypatch, most):
    """Above BROADCAST_ROWS crowded keys the same rows come from salted shuffles, and no broadcast."""
    monkeypatch.setattr(_graph, "BROADCAST_ROWS", most)
    rows = spark.range(2000).selectExpr("id as node", "case when id < 900 then 1 when id < 1500 then 2 when id < 1990 then id end as key")
    known = rows.where("key is not null").groupBy("key").agg(F.ceil(F.count("*") / 100).cast("int").alias("parts")).where("key < 1800")
    joined = _graph.crowded_join(rows, known, "key", "parts", F.col("node"))
    got = sorted((r.node, r.key, r.parts) for r in joined.select("node", "key", "parts").collect())
    assert got == [(k, 1 if k < 900 else 2 if k < 1500 else k, 9 if k < 900 else 6 if k < 1500 else 1) for k in range(1800)]
    assert ("Broadcast" in joined._jdf.queryExecution().sparkPlan().toString()) == (most > 2)


def test_a_cluster_needs_a_shared_folder():
    conf = types.SimpleNamespace(get=lambda k, d: None)
    context = types.SimpleNamespace(applicationId="none", master="spark://host:7077")
    with pytest.raises(RuntimeError):
        _io.shared_folder(types.SimpleNamespace(conf=conf, sparkContext=context))


def test_components_of_chains_hubs_and_repeats(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 300)] + [(100, 101), (101, 100), (7, 7), (None, 3), (500, 501)]
    got = dict(_graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 400)} | {500: 500, 501: 500}
    assert _graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
