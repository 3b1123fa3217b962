"""Approximate nearest neighbours by counting collisions on single projections.

A vector is projected onto LINES random lines, each a sorted array. A query opens a window around its own
projection on every line and widens all windows together, as if buckets were merged (virtual rehashing): at
radius R a window reaches WINDOW * R to both sides. A vector at distance R lies in such a window with a known
probability, so its collisions are binomial; vectors that collide on at least `needed` lines are verified by
their exact distance, and one at distance R or less is missed with a probability of MISS at most. When k
are verified, the k-th best distance is the last radius: nothing nearer can turn up but what was missed.

The vectors are dealt into blocks: cells of a grid of quantiles over a few orthonormal directions, large
cells in parts by hash. A task builds the sorted arrays of one block after the other, each of bounded size,
and lets the queries that visit it pass by in batches; neither all vectors nor all queries of a block are held
but for one block's. A query first visits the part it lies in and one cell of EARLY; the k-th distance found
there bounds its radius. Then it visits the other cells that a ball of that radius touches, which is exact,
since orthonormal projections shorten distances. k rows at most leave a visit. Where vectors have no structure
a ball touches most cells: the work is then that of all queries against all rows, in blocks.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do
rows with a null vec_id. A vec_id names one vector: rows that repeat it are one, that with the smallest
components first. Vectors of different lengths are never neighbours. Ties go to the smaller vec_id; fewer
candidates than k are all returned; without queries or candidates there are no rows. Other columns are not
looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlow.llm._graph import BROADCAST_ROWS, spread_join
from marlow.llm._io import drop, small_batches, written

NEAREST, EVERY = 10, 100
LINES, WINDOW, MISS, GROWTH, SEED = 128, 1.5, 1e-3, 1.2, 0xA11
# Doubles of a block: vectors, their projections and the order of these.
BLOCK_VALUES = 1 << 22
AXES, EARLY = 3, 64
AT_ONCE = 64
# Relative slack of radii, and that of projections by the size of what is projected: more than rounding.
SLACK, ROUNDING = 1 + 1e-9, 1e-12
FOUND = "query_id long, vec_id long, score double"


def needed(lines: int = LINES, window: float = WINDOW, miss: float = MISS) -> int:
    """Collisions that a vector at the radius has with a probability of 1 - miss at least."""
    p, below, n = math.erf(window / math.sqrt(2)), 0.0, 0
    while below + (now := math.comb(lines, n) * p**n * (1 - p) ** (lines - n)) <= miss:
        below, n = below + now, n + 1
    return n


def block_rows(dims: int) -> int:
    return max(1, BLOCK_VALUES // (dims + 2 * LINES))


def axes(dims: int) -> np.ndarray:
    """Orthonormal directions, as columns."""
    return np.linalg.qr(np.random.default_rng([SEED, dims, 1]).normal(size=(dims, min(AXES, dims))))[0]


class Block:
    """The sorted arrays of one block of vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, lines: int = LINES, window: float = WINDOW, miss: float = MISS):
        self.ids, self.columns, self.window = ids, np.ascontiguousarray(x.T), window
        self.lines = np.random.default_rng([SEED, x.shape[1]]).normal(size=(x.shape[1], lines))
        at = (x @ self.lines).T
        self.order = np.argsort(at, 1)
        self.sorted = np.take_along_axis(at, self.order, 1)
        self.needed = needed(lines, window, miss)

    def distances(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Summed in the order of the components."""
        return np.sqrt(np.add.accumulate((np.take(self.columns, rows, 1) - q[:, None]) ** 2, 0)[-1])

    def search(self, own: np.ndarray, q: np.ndarray, most: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query, vec_id, distance) of up to k nearest of each query but itself within `most`, and how many vectors were verified.

        All queries widen their windows in steps of the same kind, each by its own radius.
        """
        n, c = len(self.ids), q @ self.lines
        blur = ROUNDING * (np.abs(c).max(1) + np.abs(self.sorted).max(initial=0))
        lo = np.stack([np.searchsorted(s, c[:, i]) for i, s in enumerate(self.sorted)], 1)
        hi = lo.copy()
        count = np.zeros((len(q), n), np.int16)
        # the first windows hold about an eighth of the vectors, too few for others than near ones to collide often enough,
        # or reach as far as an earlier search has left to look
        side = max(k, n // 16)
        near = np.stack([np.maximum(s[np.minimum(lo[:, i] + side, n - 1)] - c[:, i], c[:, i] - s[np.maximum(lo[:, i] - side, 0)]) for i, s in enumerate(self.sorted)], 1)
        least = np.ptp(self.sorted, 1).max(initial=0) * 1e-6 + 1e-300
        radius = np.where(np.isfinite(most), most, np.maximum(np.median(near, 1) / self.window, 0))
        known = [(np.zeros(0, np.int64), np.zeros(0)) for _ in q]
        seen = self.ids == own[:, None]
        open_, verified, lines = np.arange(len(q)), 0, list(self.order)
        while len(open_):
            reach = self.window * radius[open_] * SLACK + blur[open_]
            new_lo, new_hi = lo[open_], hi[open_]
            for i, s in enumerate(self.sorted):
                new_lo[:, i] = np.minimum(new_lo[:, i], np.searchsorted(s, c[open_, i] - reach, "left"))
                new_hi[:, i] = np.maximum(new_hi[:, i], np.searchsorted(s, c[open_, i] + reach, "right"))
            left = []
            for j, a in enumerate(open_):
                on_left, on_right = zip(lines, new_lo[j].tolist(), lo[a].tolist()), zip(lines, hi[a].tolist(), new_hi[j].tolist())
                more = [line[s:e] for side in (on_left, on_right) for line, s, e in side if s < e]
                if more:
                    count[a] += np.bincount(np.concatenate(more), minlength=n).astype(np.int16)
                rows = np.flatnonzero((count[a] >= self.needed) & ~seen[a])
                seen[a, rows] = True
                verified += len(rows)
                ids, far = known[a]
                ids, far = np.append(ids, self.ids[rows]), np.append(far, self.distances(q[a], rows))
                best = np.lexsort((ids, far))[:k]
                known[a] = ids[best], far[best]
                whole = (new_lo[j] == 0).all() and (new_hi[j] == n).all()
                target = min(far[best[-1]], most[a]) if len(best) == k else most[a]
                if radius[a] < target and not whole:
                    radius[a] = target if len(best) == k else min(max(radius[a] * GROWTH, least), target)
                    left.append(a)
            lo[open_], hi[open_] = new_lo, new_hi
            open_ = np.array(left, np.int64)
        near = [(ids[far <= m], far[far <= m]) for (ids, far), m in zip(known, most)]
        size = [len(i) for i, _ in near]
        return np.repeat(own, size), np.concatenate([i for i, _ in near]), np.concatenate([f for _, f in near]), verified


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    return np.stack([np.frombuffer(v.as_buffer(), np.float64) for v in column]) if len(column) else np.zeros((0, dims))


def _projected(vectors: DataFrame) -> DataFrame:
    """(vec_id, dims, vector, place): the vectors that take part, one for each vec_id; place: on the axes."""
    x = F.col("embedding")
    good = (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & x.isNotNull() & good)
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("embedding")
            size, flat = np.diff(np.asarray(column.offsets)), column.flatten().to_numpy().astype(np.float64)
            edge = np.append(0, np.cumsum(size))
            blob, place = [b""] * len(size), np.zeros((len(size), AXES))
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                v = flat[edge[at][:, None] + np.arange(d)]
                p = v @ axes(int(d))
                place[at, : p.shape[1]] = p
                for r, row in zip(at, v):
                    blob[r] = row.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(size.astype(np.int32)), pa.array(blob, pa.binary()), *map(pa.array, place.T)], ["vec_id", "dims", "vector", *(f"p{a}" for a in range(AXES))])

    return rows.mapInArrow(run, "vec_id long, dims int, vector binary, " + ", ".join(f"p{a} double" for a in range(AXES)))


Grid = dict[int, list[np.ndarray]]


def grid(rows: DataFrame) -> Grid:
    """For each length of vectors the inner edges of the slices along each axis: quantiles, as many as give blocks their size."""
    out: Grid = {}
    for r in rows.groupBy("dims").count().collect():
        n_axes = min(AXES, r.dims)
        slices = math.ceil(math.ceil(r["count"] / block_rows(r.dims)) ** (1 / n_axes) - 1e-9)
        if slices == 1:
            out[r.dims] = [np.zeros(0)] * n_axes
            continue
        cuts = [k / slices for k in range(1, slices)]
        q = rows.where(F.col("dims") == r.dims).agg(*[F.percentile_approx(f"p{a}", cuts, 10_000) for a in range(n_axes)]).first()
        out[r.dims] = [np.unique(np.array(v)) for v in q]
    return out


def _cell(at: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    """Numbers of cells from slices along each axis."""
    out = np.zeros(len(at[0]), np.int64)
    for s, e in zip(at, edges):
        out = out * (len(e) + 1) + s
    return out


def with_cell(rows: DataFrame, cuts: Grid) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, cell = b.column("dims").to_numpy(), np.zeros(b.num_rows, np.int64)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                cell[at] = _cell([np.searchsorted(e, b.column(f"p{a}").to_numpy()[at], "right") for a, e in enumerate(cuts[int(d)])], cuts[int(d)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], [*b.schema.names, "cell"])

    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, cell long")


def touched(p: np.ndarray, radius: float, edges: list[np.ndarray]) -> np.ndarray:
    """The cells that a ball around a point on the axes touches."""
    cells, gaps = np.zeros(1, np.int64), np.zeros(1)
    for v, e in zip(p, edges):
        lo, hi = np.searchsorted(e, v - radius, "left"), np.searchsorted(e, v + radius, "right")
        s = np.arange(lo, hi + 1)
        left, right = np.append(-np.inf, e)[s], np.append(e, np.inf)[s]
        gap = np.maximum(0, np.maximum(left - v, v - right))
        cells = (cells[:, None] * (len(e) + 1) + s).ravel()
        gaps = (gaps[:, None] + gap**2).ravel()
    return cells[gaps <= radius * radius * SLACK] if np.isfinite(radius) else cells


def visits(queries: DataFrame, cells: DataFrame, cuts: Grid, early: bool) -> DataFrame:
    """(dims, cell, part, vec_id, vector, most): the blocks each of queries(vec_id, dims, vector, p.., cell, home, most) visits, in the first or the second turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = np.stack([b.column(f"p{a}").to_numpy() for a in range(AXES)], 1)
            for r, (d, most, home) in enumerate(zip(b.column("dims").to_pylist(), b.column("most").to_pylist(), b.column("cell").to_pylist())):
                edges = cuts[d]
                if early:
                    to = np.append(np.arange(0, math.prod(len(e) + 1 for e in edges), EARLY), home)
                    to = to[: len(to) - (home % EARLY == 0)]
                else:
                    to = touched(places[r], most * SLACK + ROUNDING * np.linalg.norm(np.frombuffer(b.column("vector")[r].as_buffer())), edges)
                    to = to[to % EARLY != 0]
                for k in range(0, len(to), 4096):
                    same = pa.array(np.full(len(to[k : k + 4096]), r))
                    yield pa.RecordBatch.from_arrays([*(b.column(n).take(same) for n in ("dims", "vec_id", "vector", "most", "cell", "home")), pa.array(to[k : k + 4096])], ["dims", "vec_id", "vector", "most", "lives", "home", "cell"])

    rows = queries.mapInArrow(run, "dims int, vec_id long, vector binary, most double, lives long, home int, cell long")
    rows = _with_parts(rows, cells).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    at_home = (F.col("cell") == F.col("lives")) & (F.col("part") == F.col("home"))
    first = (F.col("cell") % EARLY == 0) | at_home
    return rows.where(first if early else ~first).select("dims", "cell", "part", "vec_id", "vector", "most")


def _with_parts(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """rows with the parts of their cell. Cells are counted; beyond what may be broadcast, rows of a cell are dealt by salts."""
    if cells.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(cells), ["dims", "cell"])
    named = rows.withColumn("key", F.struct("dims", "cell"))
    return spread_join(named, cells.select(F.struct("dims", "cell").alias("key"), "parts"), "key", "vec_id").drop("key")


def _searched(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: up to k of each visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for b in batches:
            keys = np.stack([b.column(n).to_numpy().astype(np.int64) for n in ("dims", "cell", "part", "asks")], 1)
            edge = np.append(np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))), len(keys)) if len(keys) else []
            for lo, hi in zip(edge[:-1], edge[1:]):
                at, rows = tuple(keys[lo, :3]), b.slice(lo, hi - lo)
                if at != now:
                    now, held, block = at, [], None
                x = _matrix(rows.column("vector"), int(at[0]))
                ids = rows.column("vec_id").to_numpy()
                if not keys[lo, 3]:
                    held.append((ids, x))
                    continue
                if block is None:
                    if not held:
                        continue
                    block = Block(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]))
                    held = []
                most = rows.column("most").to_numpy()
                for s in range(0, len(ids), AT_ONCE):
                    part = slice(s, s + AT_ONCE)
                    query, vec, far, _ = block.search(ids[part], x[part], most[part], k)
                    yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(vec), pa.array(far)], ["query_id", "vec_id", "score"])

    both = vectors.select("dims", "cell", "part", F.lit(0).alias("asks"), "vec_id", "vector", F.lit(0.0).alias("most")).unionByName(queries.withColumn("asks", F.lit(1)))
    return both.repartition("dims", "cell", "part").sortWithinPartitions("dims", "cell", "part", "asks").mapInArrow(run, FOUND)


def nearest(found: DataFrame, k: int) -> DataFrame:
    """The first k of each query by distance, then vec_id, with their rank."""
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, every: int = EVERY, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by `every`."""
    small_batches(vectors.sparkSession)
    rows = written(_projected(vectors), "projected")
    cuts = grid(rows)
    placed = with_cell(rows, cuts)
    size = F.create_map(*[F.lit(v) for d in cuts for v in (d, block_rows(d))])[F.col("dims")] if cuts else F.lit(1)
    cells = written(placed.groupBy("dims", "cell").count().select("dims", "cell", F.ceil(F.col("count") / size).cast("int").alias("parts")), "cells")
    placed = _with_parts(placed, cells).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
    asks = placed.where(F.col("vec_id") % every == 0).withColumnRenamed("part", "home")
    first = written(_searched(placed, visits(asks.withColumn("most", F.lit(float("inf"))), cells, cuts, True), k), "first")
    bound = nearest(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("most"))
    bounded = asks.join(bound.hint("merge"), "vec_id", "left").withColumn("most", F.coalesce("most", F.lit(float("inf"))))
    second = _searched(placed.where(F.col("cell") % EARLY != 0), visits(bounded, cells, cuts, False), k)
    out = written(nearest(first.unionByName(second), k), "neighbours")
    for t in (rows, cells, first):
        drop(t)
    return out
