import hashlib

import numpy as np
import pytest

from marlow.llm import centroids, queries


def brute(rows, k=40, rounds=5, dims=64, seed=2):
    kept = []
    for i, e in rows:
        if e is not None and len(e) == dims and all(v is not None and np.isfinite(v) for v in e):
            kept.append((i, [int(np.floor(256 * float(v))) for v in e]))
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), p) for i, p in kept if i is not None)
    c = [p for _, p in order[:k]]
    if not c:
        return []
    x = np.array([p for _, p in kept], dtype=object)
    for r in range(rounds + 1):
        d = np.array([((x - np.array(m, dtype=object)) ** 2).sum(1) for m in c]).T
        at = [min(range(len(c)), key=lambda j, q=q: (q[j], j)) for q in d]
        if r < rounds:
            for j in range(len(c)):
                own = x[[a == j for a in at]]
                if len(own):
                    c[j] = [int(s) // len(own) for s in own.sum(0)]
    far = [d[i, a] for i, a in enumerate(at)]
    inertia = {j: sum(f for f, a in zip(far, at) if a == j) for j in set(at)}
    sha = {j: hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest() for j in set(at)}
    return sorted(((i, a, f, inertia[a], sum(far), sha[a]) for (i, _), a, f in zip(kept, at, far)), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


def test_against_brute_force(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(12, 8))
    rows = [(k, [float(v) for v in base[k % 12] + rng.normal(size=8) * 0.2]) for k in range(900)]
    # a third of all rows are copies of one vector; repeated rows and ids; ties between equal centroids
    rows += [(1000 + k, rows[0][1]) for k in range(400)]
    rows += [rows[3], rows[3], (5, [1.0] * 8), (None, [0.5] * 8)]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 7), (2003, [float("nan")] + [1.0] * 7), (2004, [None] + [1.0] * 7), (2005, [float("inf")] * 8), (2006, [0.0] * 8)]
    df = spark.createDataFrame([(i, e, 7, "x") for i, e in rows], "vec_id long, embedding array<double>, cluster int, point string")
    assert found(centroids.cluster(df, dims=8)) == brute(rows, dims=8)
    assert found(centroids.cluster(df, k=3, rounds=1, dims=8)) == brute(rows, k=3, rounds=1, dims=8)


def test_few_rows_and_none(spark):
    rows = [(k, [float(k)] * 4) for k in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert found(centroids.cluster(df, dims=4)) == brute(rows, dims=4)
    assert centroids.cluster(df.limit(0), dims=4).count() == 0
    assert centroids.cluster(df, dims=5).count() == 0
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(spark.createDataFrame([(1, [1e300] * 4)], "vec_id long, embedding array<double>"), dims=4)


def test_components_beyond_whole_doubles(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(v) for v in rng.integers(-200_000, 200_000, 6)]) for k in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(centroids.cluster(df, k=15, dims=6)) == brute(rows, k=15, dims=6)


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(2)
    base = rng.integers(-300, 300, (40, 16))
    x = base[rng.integers(0, 40, 4000)] + rng.integers(-40, 40, (4000, 16))
    c = x[:40]
    group = centroids.grouped(c)
    at, _, upper, lower = centroids.first_scan(x, c, group)
    measured = []
    for _ in range(6):
        new = c.copy()
        for j in set(at.tolist()):
            new[j] = x[at == j].sum(0) // (at == j).sum()
        at, d, upper, lower, n = centroids.rescan(x, at, upper, lower, c, new, group)
        c = new
        full = centroids.squared(x, c)
        assert (at == full.argmin(1)).all() and (d == full.min(1)).all()
        root = np.sqrt(full)
        assert (upper >= root[np.arange(len(x)), at]).all()
        root[np.arange(len(x)), at] = np.inf
        assert all((lower[:, g] <= root[:, group == g].min(1)).all() for g in range(group.max() + 1))
        measured.append(n / full.size)
    assert measured[-1] < 0.2, measured


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert found(queries.op11_centroid_clustering(spark, sf)) == brute(rows)
