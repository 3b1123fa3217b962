"""Joins of rectangles over a k-d tree: overlap pairs, overlap anti-join, first rectangle around a point.

The tree is grown on the driver from a sample of at most about SAMPLE rectangles of both sides: the fullest leaf
is cut near a median as long as that parts its rectangles, so leaves are small where rectangles are many, whatever
the extent of the plane. Every rectangle stands in the leaves it touches, every point in one. Leaves are counted;
those with more than PART rows of a side are dealt by hash into parts, and a task sees one part of either side at a
time: it holds the right one, and the left one streams past. Within parts a plane sweep along x finds what can
meet. A pair that meets in several leaves is told in the one that holds the lower corner of its overlap. Pairs are looked for among
different rectangles; those with equal ones are told by joining keys, MEMBERS at a time.

The anti-join stops at a row's first hit. Crowded leaves are first compared part by part, which decides nearly all
rows of a place where everything overlaps; only rows still open meet the other parts, so what is looked at grows
with the rows and not with their square.

Rectangles are struct(x, y, width, height). Null rectangles and such with NaN touch nothing.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlow.sources.shared import written

SAMPLE, LEAF, MOST_LEAVES, PART = 200_000, 2048, 1 << 16, 8192
# A cut must leave at most this share of a leaf's rectangles on either side; it is tried at and beside these quantiles, and rectangles it would put on both sides count thrice.
PARTS_WELL, CUTS = 0.75, (0.35, 0.5, 0.65)
AT_ONCE, STEP = 1 << 20, 32
# Rows of both sides in a task of a sweep, keys of equal rectangles in a row, pairs of rectangles in a task that tells their keys, about.
TASK_ROWS, MEMBERS, TASK_PAIRS = 4096, 1024, 2000
SIDES = ("_x", "_y", "_w", "_h")


class Tree(NamedTuple):
    """Nodes: the axis they are cut along (-1: a leaf), where, their two children, the number of a leaf."""

    axis: np.ndarray
    at: np.ndarray
    child: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def touched(self, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that rectangles x, y, width, height touch, edges included."""
        row, node = np.arange(len(r)), np.zeros(len(r), np.int64)
        out = []
        while len(row):
            end = self.axis[node] < 0
            out.append((row[end], self.leaf[node[end]]))
            row, node = row[~end], node[~end]
            axis = self.axis[node]
            low = r[row, axis]
            down, up = low <= self.at[node], low + r[row, axis + 2] >= self.at[node]
            row, node = np.concatenate([row[down], row[up]]), np.concatenate([self.child[node[down], 0], self.child[node[up], 1]])
        return (np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])) if out else (row, node)

    def home(self, p: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        node = np.zeros(len(p), np.int64)
        while len(at := np.flatnonzero(self.axis[node] >= 0)):
            n = node[at]
            node[at] = self.child[n, (p[at, self.axis[n]] >= self.at[n]).astype(np.int64)]
        return self.leaf[node]


def grown(r: np.ndarray, limit: int, most: int = MOST_LEAVES) -> Tree:
    """A tree whose leaves touch at most `limit` of the rectangles, unless no cut parts them or there are `most` leaves."""
    axis, at, child = [-1], [0.0], [(0, 0)]
    heap = [(-len(r), 0, np.arange(len(r)))]
    leaves = 1
    while heap and leaves < most:
        n, node, rows = heapq.heappop(heap)
        if -n <= limit:
            break
        best = None
        for a in (0, 1):
            low = r[rows, a]
            high = low + r[rows, a + 2]
            cuts = np.quantile((low + high) / 2, CUTS)
            # also beside all that such a cut would go through, so that copies stay on one side
            through = [(low <= c) & (high >= c) for c in cuts]
            beside = [b for t in through if t.any() for b in (np.nextafter(low[t].min(), -np.inf), np.nextafter(high[t].max(), np.inf))]
            for cut in {*cuts.tolist(), *map(float, beside)}:
                down, up = low <= cut, high >= cut
                fuller = max(down.sum(), up.sum())
                worth = fuller + 2 * (down.sum() + up.sum() - len(rows))
                if fuller <= PARTS_WELL * len(rows) and (best is None or (worth, a, cut) < best[:3]):
                    best = worth, a, cut, rows[down], rows[up]
        if best is None:
            continue
        axis[node], at[node], child[node] = best[1], best[2], (len(axis), len(axis) + 1)
        for side in best[3:]:
            heapq.heappush(heap, (-len(side), len(axis), side))
            axis.append(-1)
            at.append(0.0)
            child.append((0, 0))
        leaves += 1
    ends = np.array(axis) < 0
    return Tree(np.array(axis), np.array(at), np.array(child), np.where(ends, np.cumsum(ends) - 1, 0))


def _flat(df: DataFrame, rect: Column, columns: list[Column]) -> DataFrame:
    sides = [rect[n].cast("double").alias(s) for n, s in zip(("x", "y", "width", "height"), SIDES)]
    whole = F.struct(*columns, *sides)
    return df.where(rect.isNotNull()).select(*columns, *sides, F.xxhash64(whole).alias("_hash"))


def _matrix(b: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([b.column(s).to_numpy() for s in SIDES], 1)


def tree_for(*sides: DataFrame) -> Tree:
    """A tree of the rectangles of flat tables. Its leaves hold about LEAF rectangles, or more if that would make too many of them."""
    both = sides[0].select(*SIDES)
    for s in sides[1:]:
        both = both.unionByName(s.select(*SIDES))
    n = both.count()
    share = min(1.0, SAMPLE / max(n, 1))
    sample = (both if share == 1 else both.sample(share, 7)).toPandas().to_numpy(float).reshape(-1, 4)
    sample = sample[~np.isnan(sample).any(1)]
    return grown(sample, max(16, int(LEAF * share)))


def _counts(df: DataFrame, tree: Tree, points: bool = False) -> np.ndarray:
    """Rows of a flat table in each leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(tree.leaves, np.int64)
        for b in batches:
            r = _matrix(b)
            n += np.bincount(tree.home(r) if points else tree.touched(r)[1], minlength=tree.leaves)
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(n[has])], ["leaf", "n"])

    out = np.zeros(tree.leaves, np.int64)
    # a row for each leaf
    for r in df.select(*SIDES).mapInArrow(run, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        out[r.leaf] = r.n
    return out


def _dealt(df: DataFrame, tree: Tree, own: np.ndarray, other: np.ndarray | None, left: bool, points: bool = False) -> DataFrame:
    """df with leaf and parts (i of the left side, j of the right one): in one of `own` parts of its side, once for each of the `other` parts of the other side.

    Without `other` both sides are compared part by part. Leaves with no parts are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = _matrix(b)
            row, leaf = (np.arange(len(r)), tree.home(r)) if points else tree.touched(r)
            there = (own[leaf] > 0) & (other is None or other[leaf] > 0)
            row, leaf = row[there], leaf[there]
            mine = b.column("_hash").to_numpy()[row] % np.maximum(own[leaf], 1)
            times = np.ones(len(row), np.int64) if other is None else other[leaf]
            each = np.repeat(np.arange(len(row)), times)
            theirs = mine if other is None else np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
            row, leaf, mine = row[each], leaf[each], mine[each]
            i, j = (mine, theirs) if left else (theirs, mine)
            taken = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*taken.columns, *map(pa.array, (leaf, i.astype(np.int64), j.astype(np.int64)))], [*b.schema.names, "_leaf", "_i", "_j"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInArrow(run, f"{kinds}, _leaf long, _i long, _j long")


Meet = Callable[[pa.RecordBatch, pa.Table, int], Iterator[pa.RecordBatch]]


def _swept(left: DataFrame, right: DataFrame, meet: Meet, schema: str, tasks: int | None = None) -> DataFrame:
    """What `meet` makes of batches of left rows with all right rows of the same leaf and parts, these sorted by x. `tasks`: how many, where the work is not seen from the size of the rows."""
    names = right.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, table = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(n).to_numpy() for n in ("_leaf", "_i", "_j", "_left")], 1)
            edge = np.append(np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))), len(keys))
            for lo, hi in zip(edge[:-1], edge[1:]):
                place, rows = tuple(keys[lo, :3]), b.slice(lo, hi - lo)
                if place != now:
                    now, held, table = place, [], None
                if not keys[lo, 3]:
                    held.append(rows.select(names))
                elif held or table is not None:
                    if table is None:
                        table, held = pa.Table.from_batches(held).combine_chunks(), []
                    yield from meet(rows, table, int(place[0]))

    both = left.withColumn("_left", F.lit(1)).unionByName(right.withColumn("_left", F.lit(0)), allowMissingColumns=True)
    by = ["_leaf", "_i", "_j", "_left", "_x"]
    place = ("_leaf", "_i", "_j")
    return (both.repartition(tasks, *place) if tasks else both.repartition(*place)).sortWithinPartitions(*by).mapInArrow(run, schema)


def _range(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each left rectangle where right ones, sorted by x, can begin to meet it and where they end to."""
    widest = b[:, 2].max(initial=0)
    return np.searchsorted(b[:, 0], a[:, 0] - widest, "left"), np.searchsorted(b[:, 0], a[:, 0] + a[:, 2], "right")


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of rectangles side by side; 0 if the union has no area."""
    w = np.minimum(a[..., 0] + a[..., 2], b[..., 0] + b[..., 2]) - np.maximum(a[..., 0], b[..., 0])
    h = np.minimum(a[..., 1] + a[..., 3], b[..., 1] + b[..., 3]) - np.maximum(a[..., 1], b[..., 1])
    both = np.maximum(w, 0) * np.maximum(h, 0)
    union = a[..., 2] * a[..., 3] + b[..., 2] * b[..., 3] - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0)


def over(iou: np.ndarray, least: float, inclusive: bool) -> np.ndarray:
    return (iou >= least) & (iou > 0) if inclusive else iou > least


def any_hit(a: np.ndarray, b: np.ndarray, threshold: float, inclusive: bool = False) -> tuple[np.ndarray, int]:
    """Which of the rectangles a overlap one of b by more than the threshold (or by it and more), and how many pairs were looked at: STEP more for those still open."""
    lo, hi = _range(a, b)
    hit, looked = np.zeros(len(a), bool), 0
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        for k in range(0, len(open_), AT_ONCE // STEP):
            rows = open_[k : k + AT_ONCE // STEP]
            at = lo[rows, None] + np.arange(STEP)
            good = at < hi[rows, None]
            looked += int(good.sum())
            hit[rows] = (over(ratio(a[rows, None], b[np.minimum(at, len(b) - 1)]), threshold, inclusive) & good).any(1)
        lo[open_] += STEP
        open_ = open_[~hit[open_] & (lo[open_] < hi[open_])]
    return hit, looked


def _candidates(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a and b that may meet, AT_ONCE pairs or one row at a time."""
    lo, hi = _range(a, b)
    ends = np.cumsum(hi - lo)
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        n = (hi - lo)[at:to]
        i = np.repeat(np.arange(at, to), n)
        yield i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + lo[i]
        at = to


def _parts(n: np.ndarray) -> np.ndarray:
    return -(-n // PART)


def without_overlap(left: DataFrame, right: DataFrame, key: str, rect: str = "rect", threshold: float = 0.0, inclusive: bool = False, looked: Accumulator | None = None) -> DataFrame:
    """Rows of left that overlap no row of right by more than the threshold (IoU), or by it and more. key identifies left's rows. `looked` counts pairs."""
    r, kind = F.col(rect), dict(left.dtypes)[key]
    a, b = _flat(left, r, [F.col(key).alias("_key")]), _flat(right, r, [])
    tree = tree_for(a, b)
    n_a, n_b = _counts(a, tree), _counts(b, tree)

    def meet(rows: pa.RecordBatch, others: pa.Table, leaf: int) -> Iterator[pa.RecordBatch]:
        hit, n = any_hit(_matrix(rows), _matrix(others), threshold, inclusive)
        if looked is not None:
            looked.add(n)
        yield pa.RecordBatch.from_arrays([rows.column("_key").filter(pa.array(hit))], ["_key"])

    both = np.where((n_a > 0) & (n_b > 0), np.maximum(_parts(n_a), _parts(n_b)), 0)
    hits = _swept(_dealt(a, tree, both, None, True), _dealt(b, tree, both, None, False), meet, f"_key {kind}").distinct()
    if (both > 1).any():
        hits = written(hits, "hits")
        rest = a.join(hits, "_key", "left_anti")
        crowded = both > 1
        n_rest = np.where(crowded, _counts(rest, tree), 0)
        parts_a, parts_b = _parts(n_rest), np.where(crowded, _parts(n_b), 0)
        hits = hits.unionByName(_swept(_dealt(rest, tree, parts_a, parts_b, True), _dealt(b, tree, parts_b, parts_a, False), meet, f"_key {kind}"))
    return left.join(hits.withColumnRenamed("_key", key).distinct(), key, "left_anti")


def _members(df: DataFrame, rect: Column, key: str) -> DataFrame:
    """(place, keys): the sides of each different rectangle with the keys that have it, in rows of about MEMBERS."""
    place = F.struct(*[rect[n].cast("double").alias(s) for n, s in zip(("x", "y", "width", "height"), SIDES)])
    flat = df.where(rect.isNotNull()).select(place.alias("place"), F.col(key).alias("k"))
    crowded = flat.groupBy("place").agg(F.count("*").alias("n")).where(F.col("n") > MEMBERS)
    # at most one in MEMBERS rows has such a place
    parts = flat.join(F.broadcast(crowded), "place", "left").withColumn("part", F.pmod(F.xxhash64("k"), F.coalesce(F.ceil(F.col("n") / MEMBERS), F.lit(1))))
    return written(parts.groupBy("place", "part").agg(F.collect_list("k").alias("keys")).select("place", "keys"), "members")


def overlapping(left: DataFrame, right: DataFrame, key: str, rect: str = "rect", least: float = 0.0, inclusive: bool = False, told: Callable[[Column], Column] = lambda iou: iou) -> DataFrame:
    """(left_key, right_key, iou) of every pair that overlaps by more than `least` (or by `least` and more), once. `told`: what is made of the iou."""
    ours = _members(left, F.col(rect), key)
    theirs = ours if left is right else _members(right, F.col(rect), key)
    places = lambda m, name: _flat(m.select("place").distinct().select("place", _sides(F.col("place")).alias("r")), F.col("r"), [F.col("place").alias(name)])
    a, b = places(ours, "left_key"), places(theirs, "right_key")
    met = written(_places_overlapping(a, b, least, inclusive), "met")
    n = -(-met.count() // TASK_PAIRS)
    met = met.select("left_key", "right_key", told(F.col("iou")).alias("iou"))
    met = met.join(ours.select(F.col("place").alias("left_key"), F.col("keys").alias("i")), "left_key").join(theirs.select(F.col("place").alias("right_key"), F.col("keys").alias("j")), "right_key")
    both = met.select("i", "j", "iou").repartition(max(n, 1)).select(F.explode("i").alias("left_key"), "j", "iou")
    return both.select("left_key", F.explode("j").alias("right_key"), "iou")


def _sides(place: Column) -> Column:
    return F.struct(*[place[s].alias(n) for n, s in zip(("x", "y", "width", "height"), SIDES)])


def _places_overlapping(a: DataFrame, b: DataFrame, least: float, inclusive: bool) -> DataFrame:
    """overlapping() of flat tables with left_key and right_key."""
    tree = tree_for(a, b)
    n_a, n_b = _counts(a, tree), _counts(b, tree)
    parts_a, parts_b = _parts(n_a), _parts(n_b)

    def meet(rows: pa.RecordBatch, others: pa.Table, leaf: int) -> Iterator[pa.RecordBatch]:
        x, y = _matrix(rows), _matrix(others)
        for i, j in _candidates(x, y):
            iou = ratio(x[i], y[j])
            at = np.flatnonzero(over(iou, least, inclusive))
            at = at[tree.home(np.maximum(x[i[at], :2], y[j[at], :2])) == leaf]
            yield pa.RecordBatch.from_arrays([rows.column("left_key").take(pa.array(i[at])), others.column("right_key").combine_chunks().take(pa.array(j[at])), pa.array(iou[at])], ["left_key", "right_key", "iou"])

    kinds = f"left_key {dict(a.dtypes)['left_key']}, right_key {dict(b.dtypes)['right_key']}, iou double"
    tasks = -(-int((n_a * parts_b + n_b * parts_a).sum()) // TASK_ROWS)
    return _swept(_dealt(a, tree, parts_a, parts_b, True), _dealt(b, tree, parts_b, parts_a, False), meet, kinds, max(tasks, 1))


def first_containing(points: DataFrame, rects: DataFrame, key: str, rect: str = "rect") -> DataFrame:
    """Each point (key, x, y) with the first rectangle that holds it, edges included, by priority, then pos; points outside all have nulls.

    A task tells one rectangle a point, and those of several parts are folded before they are shuffled.
    """
    zero = F.lit(0.0)
    a = _flat(points, F.struct("x", "y", zero.alias("width"), zero.alias("height")), [F.col(key).alias("_key")])
    b = _flat(rects, F.col(rect), [F.col(c) for c in rects.columns if c != rect])
    tree = tree_for(a, b)
    parts_a, parts_b = _parts(_counts(a, tree, True)), _parts(_counts(b, tree))
    names = [c for c in rects.columns if c != rect]

    def meet(rows: pa.RecordBatch, others: pa.Table, leaf: int) -> Iterator[pa.RecordBatch]:
        x, y = _matrix(rows), _matrix(others)
        order = np.lexsort((others.column("pos").to_numpy(), others.column("priority").to_numpy()))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        first = np.full(len(x), len(order))
        for i, j in _candidates(x, y):
            p, q = x[i], y[j]
            inside = (p[:, 0] >= q[:, 0]) & (p[:, 0] <= q[:, 0] + q[:, 2]) & (p[:, 1] >= q[:, 1]) & (p[:, 1] <= q[:, 1] + q[:, 3])
            np.minimum.at(first, i[inside], rank[j[inside]])
        at = np.flatnonzero(first < len(order))
        found = others.take(pa.array(order[first[at]]))
        sides = pa.StructArray.from_arrays([found.column(s).combine_chunks() for s in SIDES], ["x", "y", "width", "height"])
        columns = [rows.column("_key").take(pa.array(at)), *(found.column(n).combine_chunks() for n in names), sides]
        yield pa.RecordBatch.from_arrays(columns, ["_key", *names, "_rect"])

    types = dict(rects.dtypes)
    schema = ", ".join([f"_key {dict(points.dtypes)[key]}", *(f"`{n}` {types[n]}" for n in names), "_rect struct<x: double, y: double, width: double, height: double>"])
    found = _swept(_dealt(a, tree, parts_a, parts_b, True, points=True), _dealt(b, tree, parts_b, parts_a, False), meet, schema)
    best = found.groupBy("_key").agg(F.min_by(F.struct(*names, F.col("_rect").cast(types[rect]).alias(rect)), F.struct("priority", "pos")).alias("_b"))
    return points.join(best.select(F.col("_key").alias(key), "_b.*"), key, "left")
