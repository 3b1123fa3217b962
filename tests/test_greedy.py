"""Selections in rounds against loops, in one crowded group and along chains."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlow.operators import greedy, rectangles
from marlow.plans import QUERIES


def frame(spark, rects):
    rows = [(int(k), *map(float, r)) for k, r in rects]
    return spark.createDataFrame(rows, "pos int, x double, y double, width double, height double").select("pos", F.struct("x", "y", "width", "height").alias("rect"), F.lit("a").alias("_area_of"))


def iou(a, b):
    return float(rectangles.ratio(np.array(a, float), np.array(b, float)))


def scene(n, seed, extent):
    rng = np.random.default_rng(seed)
    return [(k, (*rng.integers(0, extent, 2), *rng.integers(5, 40, 2))) for k in rng.permutation(n).tolist()]


@pytest.mark.parametrize("extent", [40, 400])
def test_suppress(spark, extent):
    rects = scene(220, 3, extent) + [(500 + k, (7 * k, 0, 10, 10)) for k in range(12)]
    for threshold in (0.2, 0.6):
        kept = []
        for k, r in sorted(rects, key=lambda x: (-x[1][2] * x[1][3], x[0])):
            if all(iou(r, o) < threshold for _, o in kept):
                kept.append((k, r))
        got = greedy.suppress(frame(spark, rects), threshold, first=30).collect()
        assert len(got) == len(kept) and {r.pos for r in got} == {k for k, _ in kept}
        assert got[0].__fields__ == ["pos", "rect", "_area_of"]


@pytest.mark.parametrize("extent", [60, 500])
def test_keep_smaller(spark, extent):
    rects = sorted(scene(200, 4, extent) + [(500 + k, (0, 8 * k, 10, 10)) for k in range(9)])
    gone = set()
    for n, (i, a) in enumerate(rects):
        for j, b in rects[n + 1 :]:
            if i not in gone and j not in gone and iou(a, b) > 0:
                gone.add(i if a[2] * a[3] > b[2] * b[3] else j)
    got = greedy.keep_smaller(frame(spark, rects)).collect()
    assert len(got) == len(rects) - len(gone) and {r.pos for r in got} == {k for k, _ in rects} - gone


def test_none_and_nulls(spark):
    df = frame(spark, scene(3, 1, 900))
    assert greedy.suppress(df.limit(0)).count() == 0 and greedy.keep_smaller(df.limit(0)).count() == 0
    nulls = spark.sql("SELECT 77 AS pos, CAST(NULL AS struct<x: double, y: double, width: double, height: double>) AS rect, 'b' AS _area_of")
    assert greedy.suppress(df.union(nulls)).count() == 4 and greedy.keep_smaller(df.union(nulls)).count() == 4


def test_rows_settle_in_order(spark):
    pairs = [(k, k + 1) for k in range(7)] + [(20, 21), (20, 22), (21, 22)]
    got = sorted(r.k for r in greedy.overruled(spark.createDataFrame(pairs, "a int, b int")).collect())
    assert got == [1, 3, 5, 7, 21, 22]


def test_kept_smaller_over_all_parts(spark, sf):
    p = np.array(sorted((r.p_partkey, r.p_size) for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_size").collect()))
    k, n = p.T
    r = np.stack([k * 37 % 1000, k * 61 % 800, 10 + n, 5 + n], 1).astype(float)
    size, gone = r[:, 2] * r[:, 3], np.zeros(len(r), bool)
    for i in range(len(r)):
        if not gone[i]:
            for j in np.flatnonzero((rectangles.ratio(r[i], r) > 0) & ~gone & (np.arange(len(r)) > i)):
                gone[i if size[i] > size[j] else j] = True
                if gone[i]:
                    break
    got = [x.k for x in QUERIES["kept_smaller_all"](spark, sf).collect()]
    assert len(got) == (~gone).sum() and set(got) == set(k[~gone].tolist())


def test_copies_fall_without_pairs(spark, monkeypatch):
    some = scene(60, 6, 120)
    rects = sorted((1000 * c + k, r) for c in range(12) for k, r in some)
    standing = []
    for k, r in rects:
        falls = False
        for i, a in list(standing):
            if iou(a, r) > 0:
                if a[2] * a[3] <= r[2] * r[3]:
                    falls = True
                    break
                standing.remove((i, a))
        if not falls:
            standing.append((k, r))
    seen, settle = [], greedy._smaller_left
    monkeypatch.setattr(greedy, "_smaller_left", lambda df: seen.append(df.count()) or settle(df))
    got = greedy.keep_smaller(frame(spark, rects), first=90).collect()
    assert sorted(r.pos for r in got) == [k for k, _ in standing] and got[0].__fields__ == ["pos", "rect", "_area_of"]
    # the rows that are compared in pairs are few, whatever number of copies there is
    assert sum(seen) < len(rects) / 2


def test_only_the_first_of_equal_rectangles_is_settled(spark, monkeypatch):
    some = scene(40, 9, 120) + [(90, (3, 3, 0, 5))]
    rects = [(1000 * c + k, r) for c in range(9) for k, r in some]
    kept = []
    for k, r in sorted(rects, key=lambda x: (-x[1][2] * x[1][3], x[0])):
        if all(iou(r, o) < 0.3 for _, o in kept):
            kept.append((k, r))
    seen, batch = [], greedy._batch
    monkeypatch.setattr(greedy, "_batch", lambda rows, size, n: seen.append(n) or batch(rows, size, n))
    got = greedy.suppress(frame(spark, rects), 0.3).collect()
    assert sorted(r.pos for r in got) == sorted(k for k, _ in kept)
    # what has no area overlaps nothing, so all its copies stay
    assert seen[0] == 40 + 9
