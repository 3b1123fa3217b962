import math

import numpy as np
import pytest

from marlow.llm import neighbours, queries


def brute(rows, every=100, k=10):
    """Every query against every row, distances summed in the order of the components."""
    good = {}
    for i, e in rows:
        if i is not None and e and all(v is not None and np.isfinite(v) for v in e) and any(e):
            good[i] = min(good.get(i, tuple(e)), tuple(e))
    out = []
    for q, e in good.items():
        if q % every == 0:
            near = []
            for i, f in good.items():
                if i != q and len(e) == len(f):
                    total = 0.0
                    for a, b in zip(e, f):
                        total += (b - a) * (b - a)
                    near.append((math.sqrt(total), i))
            out += [(q, r + 1, i, d) for r, (d, i) in enumerate(sorted(near)[:k])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, e, 1, b"x", 2) for i, e in rows], "vec_id long, embedding array<double>, dims int, vector binary, rank int")


def found(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def recall(got, wanted):
    pairs = {(q, i) for q, _, i, _ in wanted}
    return len(pairs & {(q, i) for q, _, i, _ in got}) / len(pairs)


@pytest.mark.parametrize("values", [neighbours.BLOCK_VALUES, 9000])
def test_against_brute_force(spark, monkeypatch, values):
    monkeypatch.setattr(neighbours, "BLOCK_VALUES", values)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(25, 12))
    rows = [(k, [float(v) for v in base[k % 25] + rng.normal(size=12) * 0.3]) for k in range(1000)]
    # a third of all rows are copies of one vector, so that ties go to the smaller ids; repeated rows and ids
    rows += [(2000 + k, rows[0][1]) for k in range(500)]
    rows += [rows[100], rows[100], (7, [0.1] * 12)]
    rows += [(3000, None), (3100, []), (3200, [0.0] * 12), (3300, [None] + [1.0] * 11), (3400, [float("nan")] * 12), (3500, [float("inf")] * 12), (None, [1.0] * 12)]
    # another length has neighbours of its own, fewer than asked for; one stands alone
    rows += [(4000, [1.0, 2.0]), (4001, [2.0, 2.0]), (4100, [1.0, 1.0]), (5000, [3.0])]
    wanted = brute(rows)
    assert found(neighbours.neighbours(table(spark, rows))) == wanted


def test_none(spark):
    df = table(spark, [(k, [1.0 + k, 2.0]) for k in range(1, 20)])
    assert neighbours.neighbours(df).count() == 0
    assert neighbours.neighbours(df.limit(0)).count() == 0
    assert found(neighbours.neighbours(df, every=19, k=3)) == brute([(k, [1.0 + k, 2.0]) for k in range(1, 20)], 19, 3)


def test_recall_without_structure(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_VALUES", 320_000)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 64))
    rows = [(k, [float(v) for v in r / np.linalg.norm(r)]) for k, r in enumerate(x)]
    got, wanted = found(neighbours.neighbours(table(spark, rows))), brute(rows)
    assert len(got) == len(wanted) and recall(got, wanted) > 0.99


def test_collisions_leave_most_unverified():
    rng = np.random.default_rng(8)
    base = rng.normal(size=(50, 64))
    x = base[rng.integers(0, 50, 5000)] + rng.normal(size=(5000, 64)) * 0.2
    block = neighbours.Block(np.arange(5000), x)
    own = np.arange(0, 5000, 100)
    query, vec, far, verified = block.search(own, x[own], np.full(50, np.inf), 10)
    exact = np.sqrt(((x[own][:, None] - x) ** 2).sum(2))
    exact[np.arange(50), own] = np.inf
    near = np.argsort(exact, 1)[:, :10]
    hits = sum(len(set(near[k]) & set(vec[query == q])) for k, q in enumerate(own))
    assert hits >= 0.99 * near.size
    assert verified < 0.05 * exact.size, verified / exact.size


def test_ball_touches_the_cells_of_its_points():
    rng = np.random.default_rng(3)
    edges = [np.array([-0.5, 0.0, 0.4]), np.array([0.1]), np.array([])]
    p, x = rng.normal(size=3), rng.normal(size=(3000, 3))
    cells = neighbours._cell([np.searchsorted(e, x[:, a], "right") for a, e in enumerate(edges)], edges)
    for radius in (0.1, 0.6, 1.5):
        to = set(neighbours.touched(p, radius, edges).tolist())
        assert set(cells[((x - p) ** 2).sum(1) <= radius**2].tolist()) <= to
    assert len(neighbours.touched(p, np.inf, edges)) == 8


def test_query(spark, sf):
    rows = [(r.vec_id, [float(v) for v in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert found(queries.op13_neighbours(spark, sf)) == brute(rows)
