import numpy as np

from marlow.llm import near_vectors, queries


def brute(rows, threshold=0.9):
    x = {}
    for k, (_, e) in enumerate(rows):
        if e and all(v is not None and np.isfinite(v) for v in e) and any(e):
            x[k] = np.array(e, float) / np.linalg.norm(np.array(e, float))
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in x:
        for b in x:
            if a < b and len(x[a]) == len(x[b]) and x[a] @ x[b] >= threshold:
                n[a] += 1
                n[b] += 1
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i)
    return sorted((i, n[k], low[find(k)], low[find(k)] == i) for k, (i, _) in enumerate(rows))


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = []
    base = rng.normal(size=(30, 24))
    for k in range(260):
        c = base[k % 30] if k % 3 else base[0]
        rows.append((k * 3 % 260, [float(v) for v in c + rng.normal(size=24) * rng.choice([0.02, 0.1, 0.25, 1.0])]))
    rows += [(300, rows[4][1]), (301, rows[4][1]), (302, None), (303, [0.0] * 24), (304, [float("nan")] + [1.0] * 23), (305, [None] + [1.0] * 23), (306, []), (307, [1.0, 2.0]), (308, [2.0, 4.0]), (309, [float("inf")] * 24), (310, [0.0] * 24)]
    df = spark.createDataFrame([(i, e, "x", 1) for i, e in rows], "vec_id long, embedding array<double>, node string, n_links int")
    got = sorted(tuple(r) for r in near_vectors.near_vectors(df).collect())
    assert got == brute(rows)
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(3000, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    p, q = near_vectors.codes(a), near_vectors.codes(b)
    met = ((p[:, :, :1] == q) | (q[:, :, :1] == p)).any((1, 2))
    assert met.mean() > 0.998


def test_recall_at_every_width():
    rng = np.random.default_rng(9)
    for dims, width in ((64, 2), (64, 3), (64, 4), (2, 3), (4, 3), (8, 3), (256, 3)):
        a, b = rng.normal(size=(2, 1500, dims))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(1, keepdims=True) * a
        b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
        tables = near_vectors.tables_for(dims, width)
        p, q = (near_vectors.codes(x, tables, width=width) for x in (a, b))
        assert ((p[:, :, :1] == q) | (q[:, :, :1] == p)).any((1, 2)).mean() > 0.998, (dims, width, tables)


def test_against_brute_force_at_width_four(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "width_for", lambda rows, dims: 4)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(200, 64))
    near = rng.normal(size=(200, 64))
    near -= (near * base).sum(1, keepdims=True) / (base * base).sum(1, keepdims=True) * base
    near = 0.901 * base + np.sqrt(1 - 0.901**2) * near * (np.linalg.norm(base, axis=1) / np.linalg.norm(near, axis=1))[:, None]
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([base, near]))]
    got = sorted(tuple(r) for r in near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == brute(rows) and sum(r[1] for r in got) == 400


def test_wide_codes_of_many_dimensions(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "width_for", lambda rows, dims: 4)
    rng = np.random.default_rng(6)
    for dims in (1024, 4100):
        base = rng.normal(size=(12, dims))
        rows = [(k, [float(v) for v in base[k % 12] + rng.normal(size=dims) * 0.2]) for k in range(36)]
        got = sorted(tuple(r) for r in near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tables=40).collect())
        assert got == brute(rows) and sum(r[1] for r in got) == 72


def test_bucket_keys_tell_table_dimensions_and_code_apart():
    c = np.array([[[0, 1, 2**62, 17592186044411]] * 200])
    keys = np.concatenate([near_vectors.bucket_keys(c, d).ravel() for d in (5, 1024, 4104)])
    assert len(np.unique(keys)) == 3 * 800


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op2_near_vectors(spark, sf).collect()) == brute(rows)
