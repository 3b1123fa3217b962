"""Joins over a k-d tree against all pairs, in crowded places and on planes of any extent."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlow.operators import rectangles


def frame(spark, rects):
    rows = [(int(k), *map(float, r)) for k, r in rects]
    return spark.createDataFrame(rows, "k int, x double, y double, width double, height double").select("k", F.struct("x", "y", "width", "height").alias("rect"))


def iou(a, b):
    return float(rectangles.ratio(np.array(a, float), np.array(b, float)))


def scene(n, rng, hot=0.0):
    """Rectangles of all sizes; a share of them lies in one small place."""
    out = []
    for k in range(n):
        size = 4.0 * 1.08 ** (k % 80)
        at = rng.uniform(-1e6, 1e6, 2) if rng.random() >= hot else rng.uniform(500, 501, 2)
        out.append((k, (at[0], at[1], size, size * rng.uniform(0.3, 1.5))))
    return out


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(rectangles, "PART", 40)
    monkeypatch.setattr(rectangles, "LEAF", 30)


@pytest.mark.parametrize("hot", [0.0, 0.9])
def test_against_all_pairs(spark, small_parts, hot):
    rng = np.random.default_rng(5)
    rects = scene(500, rng, hot) + [(900, (5.0, 5.0, 0.0, 0.0)), (901, (-50.0, -60.0, 20.0, 20.0)), (902, (-50.0, -60.0, 20.0, 20.0)), (903, (float("nan"), 1.0, 5.0, 5.0)), (904, (-2e6, -2e6, 4e6, 4e6))]
    left, right = ([r for r in rects if (r[0] % 3 > 0) == side] for side in (True, False))
    a, b = frame(spark, left), frame(spark, right)
    nulls = spark.sql("SELECT 990 AS k, CAST(NULL AS struct<x: double, y: double, width: double, height: double>) AS rect")
    for least in (0.0, 0.3):
        want = {k for k, r in left if not any(iou(r, o) > least for _, o in right)} | {990}
        assert {x.k for x in rectangles.without_overlap(a.union(nulls), b.union(nulls), "k", threshold=least).collect()} == want
    pairs = [(x.left_key, x.right_key) for x in rectangles.overlapping(a, b, "k", least=0.2).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(k, j) for k, r in left for j, o in right if iou(r, o) > 0.2}
    assert rectangles.without_overlap(a, b.limit(0), "k").count() == len(left) and rectangles.without_overlap(a.limit(0), b, "k").count() == 0
    assert rectangles.overlapping(a, b.limit(0), "k").count() == 0


def test_first_rectangle_of_points(spark, small_parts):
    rng = np.random.default_rng(6)
    rects = scene(300, rng, 0.7)
    points = [(i, *(rng.uniform(495, 520, 2) if i % 4 else rng.uniform(-1e6, 1e6, 2))) for i in range(400)] + [(1000, 500.0, 500.0), (1001, *rects[7][1][:2]), (1002, rects[8][1][0] + rects[8][1][2], rects[8][1][1])]
    df = frame(spark, rects).withColumns({"priority": F.col("k") % 3, "pos": F.col("k")})
    at = spark.createDataFrame([(int(i), float(x), float(y)) for i, x, y in points], "pt int, x double, y double")
    inside = lambda r, x, y: r[0] <= x <= r[0] + r[2] and r[1] <= y <= r[1] + r[3]
    want = {i: min(((k % 3, k) for k, r in rects if inside(r, x, y)), default=(None, None))[1] for i, x, y in points}
    got = rectangles.first_containing(at, df, "pt").collect()
    assert len(got) == len(points) and {r.pt: r.k for r in got} == want
    assert all(r.rect.x == dict(rects)[r.k][0] for r in got if r.k is not None)


def test_a_crowded_place_is_dealt_and_its_pairs_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(rectangles, "PART", 100)
    rng = np.random.default_rng(7)
    made = {}
    for n in (4000, 8000):
        rects = scene(n, rng, 0.9)
        a, b = frame(spark, rects[: n // 2]), frame(spark, rects[n // 2 :])
        looked = spark.sparkContext.accumulator(0)
        rectangles.without_overlap(a, b, "k", looked=looked).count()
        made[n] = looked.value
        # what a task is given at once
        flat = [rectangles._flat(x, F.col("rect"), [F.col("k").alias("_key")]) for x in (a, b)]
        tree = rectangles.tree_for(*flat)
        n_a, n_b = (rectangles._counts(f, tree) for f in flat)
        both = np.maximum(rectangles._parts(n_a), rectangles._parts(n_b))
        most = max(rectangles._dealt(f, tree, both, None, f is flat[0]).groupBy("_leaf", "_i", "_j").count().agg(F.max("count")).first()[0] for f in flat)
        assert most < 0.05 * n, (n, most)
    assert made[8000] < 3 * made[4000] and made[8000] < 40 * 8000, made


def test_tree_follows_the_rectangles():
    rng = np.random.default_rng(8)
    r = np.concatenate([rng.uniform(0, 1e9, (3000, 4)) * [1, 1, 1e-7, 1e-7], np.tile([5e8, 5e8, 10, 10], (500, 1))])
    tree = rectangles.grown(r, 50)
    row, leaf = tree.touched(r)
    n = np.bincount(leaf, minlength=tree.leaves)
    assert (n > 0).all() and np.sort(n)[-2] <= 50 and len(row) < 1.2 * len(r)
    assert set(zip(range(len(r)), tree.home(r[:, :2]).tolist())) <= set(zip(row.tolist(), leaf.tolist()))
    assert rectangles.grown(r[:0], 50).leaves == 1


def test_copies_are_paired_by_their_keys(spark, monkeypatch):
    """Equal rectangles are compared once; the pairs told are all of them, whatever number of rows keys are dealt to."""
    monkeypatch.setattr(rectangles, "MEMBERS", 3)
    some = [(0.0, 0.0, 10.0, 10.0), (1.0, 1.0, 10.0, 10.0), (5.0, 5.0, 9.0, 9.0), (50.0, 0.0, 3.0, 3.0), (0.0, 0.0, 0.0, 4.0)]
    rows = [(100 * c + n, *r) for c in range(11) for n, r in enumerate(some)]
    df = spark.createDataFrame(rows, "k long, x double, y double, width double, height double").select("k", F.struct("x", "y", "width", "height").alias("rect"))
    seen, plain = [], rectangles._places_overlapping
    monkeypatch.setattr(rectangles, "_places_overlapping", lambda a, b, *more: seen.append((a.count(), b.count())) or plain(a, b, *more))
    got = sorted((r.left_key, r.right_key, r.iou) for r in rectangles.overlapping(df, df, "k", least=0.05, told=lambda iou: F.round(iou, 6)).collect())
    ratio = lambda a, b: float(rectangles.ratio(np.array(a), np.array(b)))
    assert got == sorted((i, j, round(ratio(a, b), 6)) for i, *a in rows for j, *b in rows if ratio(a, b) > 0.05)
    assert seen == [(5, 5)]
