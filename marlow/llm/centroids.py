"""Centroid clustering: exact k-means over integer vectors with Yinyang bounds.

The centroids are clustered into groups once. A vector keeps an upper bound of the distance to its own
centroid and, for each group, one lower bound of the distance to the others in it. When centroids move,
bounds move by their drifts. A vector whose upper bound stays below all its lower bounds keeps its
centroid (global filter); of the others only groups whose lower bound was reached are looked at (group
filter), and in these each centroid that is left is measured exactly. Distances are integers, bounds are
doubles widened by more than their rounding error, so that the result is that of a full scan, ties
included.

Vectors, clusters and bounds are a table in the shared folder, written anew in each round; a task adds
its vectors up by cluster, so k rows a task are shuffled and k rows reach the driver, however many vectors
one cluster holds. k and its groups are parameters, not corpus sizes.

Defined cases: vectors that are null, of another length, or hold null or non-finite components have no
row; fewer vectors than k give as many centroids as vectors; equal vectors may start several centroids, of
which the smallest number takes all; repeated rows each have a row, and so have null vec_ids, which start
no centroid; ties of start hashes (repeated vec_ids) are ordered by components; no rows give none. Other
columns are not looked at. Components beyond 2^26 in size after scaling raise an ArithmeticError, since
squared distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlow.llm._io import drop, small_batches, written

CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, 2
GROUP_SIZE = 10
MOST, EXACT = 1 << 26, 1 << 22  # components in size: any at all, and those whose products are whole in doubles
WIDEN = 1e-9
STATE = "vec_id long, point array<int>, cluster int, distance long, upper double, lower array<double>"


def points(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, point): the vectors that take part, as integers."""
    x = F.col("embedding")
    good = (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    fits = F.forall(whole, lambda v: F.abs(v) <= MOST)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(x.isNotNull() & good)
    return rows.select("vec_id", F.when(fits, F.transform(whole, lambda v: v.cast("int"))).alias("point"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length from a list column."""
    if column.null_count:
        raise ArithmeticError(f"a component is beyond {MOST} after scaling")
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to centroids."""
    small = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT
    both = (x.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64) if small else x @ c.T
    return (x * x).sum(1)[:, None] - 2 * both + (c * c).sum(1)


def grouped(c: np.ndarray, size: int = GROUP_SIZE, rounds: int = 5) -> np.ndarray:
    """The group of each centroid: a few rounds of k-means over the centroids, of which there are k."""
    t = max(1, -(-len(c) // size))
    mid = c[:t].astype(np.float64)
    for _ in range(rounds):
        near = ((c[:, None] - mid) ** 2).sum(2).argmin(1)
        for g in range(t):
            if (near == g).any():
                mid[g] = c[near == g].mean(0)
    return np.unique(near, return_inverse=True)[1] if len(c) else np.zeros(0, np.int64)


def _away(d: np.ndarray) -> np.ndarray:
    """A lower bound of the root of exact squared distances."""
    return np.sqrt(d.astype(np.float64)) * (1 - WIDEN)


def first_scan(x: np.ndarray, c: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """cluster, distance, upper and lower bounds from all distances."""
    d = squared(x, c)
    at = d.argmin(1)
    best = d[np.arange(len(x)), at]
    rest = _away(d)
    rest[np.arange(len(x)), at] = np.inf
    lower = np.stack([rest[:, group == g].min(1) for g in range(group.max() + 1)], 1)
    return at, best, np.sqrt(best.astype(np.float64)) * (1 + WIDEN), lower


def rescan(x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray, c: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after centroids moved from `old` to `c`, and how many distances to centroids of other clusters were measured."""
    drift = np.sqrt(((c - old).astype(np.float64) ** 2).sum(1)) * (1 + WIDEN)
    at, upper, lower = at.copy(), upper + drift[at], lower.copy()
    step = np.array([drift[group == g].max() for g in range(group.max() + 1)])
    lower -= step
    own = ((x - c[at]) ** 2).sum(1)
    # the exact distance is a row's tightest bound and a result; it costs one centroid a row
    upper = np.minimum(upper, np.sqrt(own.astype(np.float64)) * (1 + WIDEN))
    rows = np.flatnonzero(lower.min(1) <= upper)
    before, measured = at.copy(), 0
    best, cluster = own.copy(), at.copy()
    seen = []
    for g in range(len(step)):
        row = rows[lower[rows, g] <= upper[rows]]
        if not len(row):
            continue
        members = np.flatnonzero(group == g)
        # a centroid that moved less than its group's fastest is left out where its own drift keeps it away
        reach = (lower[row, g] + step[g])[:, None] - drift[members] <= upper[row][:, None]
        d = squared(x[row], c[members])
        measured += int(reach.sum())
        bound = np.where(reach, _away(d), (lower[row, g] + step[g])[:, None] - drift[members])
        far = np.where(reach | (members == before[row][:, None]), d, np.iinfo(np.int64).max)
        low = far.min(1)
        name = members[far.argmin(1)]
        wins = (low < best[row]) | ((low == best[row]) & (name < cluster[row]))
        best[row[wins]], cluster[row[wins]] = low[wins], name[wins]
        seen.append((g, row, members, np.where(members == before[row][:, None], _away(d), bound)))
    for g, row, members, bound in seen:
        lower[row, g] = np.where(members == cluster[row][:, None], np.inf, bound).min(1)
    moved = np.flatnonzero(cluster != before)
    home = group[before[moved]]
    lower[moved, home] = np.minimum(lower[moved, home], _away(own[moved]))
    upper[moved] = np.sqrt(best[moved].astype(np.float64)) * (1 + WIDEN)
    return cluster, best, upper, lower, measured


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel(), kind))


def assigned(state: DataFrame, old: np.ndarray | None, c: np.ndarray, group: np.ndarray) -> DataFrame:
    """The state after one assignment; without `old`, of points() alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("point"))
            if old is None:
                at, best, upper, lower = first_scan(x, c, group)
            else:
                bounds = b.column("lower").flatten().to_numpy().reshape(len(x), -1)
                at, best, upper, lower, _ = rescan(x, b.column("cluster").to_numpy(), b.column("upper").to_numpy(), bounds, old, c, group)
            columns = [b.column("vec_id"), b.column("point"), pa.array(at.astype(np.int32)), pa.array(best), pa.array(upper), _lists(lower, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in STATE.split(", ")])

    return state.mapInArrow(run, STATE)


def added_up(state: DataFrame, k: int, dims: int) -> DataFrame:
    """(cluster, n, distance, total): vectors, distances and components of each cluster that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, far, total = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            if b.num_rows:
                at = b.column("cluster").to_numpy()
                n += np.bincount(at, minlength=k)
                np.add.at(far, at, b.column("distance").to_numpy())
                np.add.at(total, at, matrix(b.column("point")))
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(n[has]), pa.array(far[has]), _lists(total[has], pa.int64())], ["cluster", "n", "distance", "total"])

    parts = state.select("cluster", "distance", "point").mapInArrow(run, "cluster int, n long, distance long, total array<long>")
    whole = lambda c: F.sum(c.cast("decimal(38,0)"))
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), whole(F.col("distance")).alias("distance"), F.array(*[whole(F.col("total")[i]) for i in range(dims)]).alias("total"))


def start(rows: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The k points with the smallest hashes of their vec_ids, in that order."""
    named = rows.where("vec_id is not null").select("vec_id", "point", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("hash"))
    first = named.orderBy("hash", "point").limit(k).collect()
    if any(r.point is None for r in first):
        raise ArithmeticError(f"a component is beyond {MOST} after scaling")
    return np.array([r.point for r in first], np.int64)


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (array<long>), centroid_sha256: one row for each vector that takes part."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = points(vectors, dims, scale)
    c, old = start(rows, k, seed), None
    about, state = [], rows
    if len(c):
        group = grouped(c)
        for r in range(rounds + 1):
            new = written(assigned(state, old, c, group), "clusters")
            if r:
                drop(state)
            state, sums = new, added_up(new, len(c), dims).collect()
            if r < rounds:
                old, c = c, c.copy()
                for s in sums:
                    c[s.cluster] = [int(v) // s.n for v in s.total]
        inertia = sum(int(s.distance) for s in sums)
        about = [(s.cluster, int(s.distance), inertia, c[s.cluster].tolist(), hashlib.sha256(",".join(map(str, c[s.cluster])).encode()).hexdigest()) for s in sums]
    else:
        # no vector with a vec_id takes part, so there is no centroid
        state = spark.createDataFrame([], STATE)
    # one row a cluster, at most k
    known = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")
