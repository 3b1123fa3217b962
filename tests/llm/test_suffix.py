import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from marlow.llm import _repeats, queries, suffix
from tests.llm.test_substring import brute, cases, swapped


def test_passages_cover_what_brute_force_removes(spark):
    rows = cases()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, s string")
    for least in (10, 7):
        lost = [(d, n, k) for d, n, k, _ in brute(rows, least)]
        out = suffix.without_passages(df, least)
        assert out.columns == df.columns
        kept = sorted([(d, t) for d, _, k, t in brute(rows, least) if not k], key=str)
        texts = [(r.doc_id, " ".join((r.text or "").split())) for r in out.collect()]
        assert [x for x in kept if x not in texts] == [] and len(texts) == sum(not n or k < n for _, n, k in lost)
        assert {r.doc_id for r in suffix.passages(df, least).collect()} == {d for d, _, k in lost if k}
    assert suffix.passages(df.limit(0)).count() == 0 and suffix.without_passages(df.limit(0)).count() == 0


def test_order_and_common_words():
    r = random.Random(3)
    lists = [[r.randrange(3) for _ in range(r.randrange(6))] for _ in range(200)]
    run = np.array([r.randrange(4) for _ in lists])
    order, place, shared = suffix.common(run, pa.chunked_array([pa.array(lists[:90], pa.list_(pa.int32())), pa.array(lists[90:], pa.list_(pa.int32()))]), 5)
    keys = [(run[k], lists[k] + [9] * (6 - len(lists[k]))) for k in order]
    assert keys == sorted(keys) and [place[k] for k in order] == list(range(200))
    for (a, x), (b, y), n in zip(keys, keys[1:], shared[1:]):
        want = 0
        while x[want] == y[want] != 9:
            want += 1
        assert n == (want if a == b else -1)


def test_neighbours_on_the_right_alone_would_lose_a_pair(spark):
    """Between two texts that share a passage around a prefix sort others with other words on the left, or on the right."""
    r = random.Random(6)
    w = lambda n: ["w%d" % r.randrange(10**6) for _ in range(n)]
    passage = w(50)
    rows = [(i, " ".join(w(9) + passage + w(9))) for i in range(2)]
    rows += [(10 + i, " ".join(w(40) + passage[i : i + 30] + w(40))) for i in range(20)] + [(40 + i, " ".join(w(5) + passage[5:45] + w(30))) for i in range(20)]
    got = suffix.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(x.doc_id, x.start, x.end, x.sources) for x in got] == [(1, 9, 59, [0])]


def test_crowded_runs_and_regular_texts(spark, monkeypatch):
    monkeypatch.setattr(_repeats, "GROUP_ROWS", 16)
    r = random.Random(8)
    w = lambda n: ["w%d" % r.randrange(10**6) for _ in range(n)]
    run, half = ["c%d" % i for i in range(25)], w(60)
    rows = [(i, " ".join(w(40) + (half if i % 3 == 0 else run) + w(40))) for i in range(90)] + [(300 + k, t) for k, t in enumerate(swapped())]
    got = {x.doc_id: (x.start, x.end, x.sources) for x in suffix.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (40, 100, [0]) for i in range(3, 90, 3)}


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    words = {d: len(t.split()) for d, t in rows}
    gone = defaultdict(set)
    for r in queries.op5_suffix_dedup(spark, sf).collect():
        assert r.sources and all(x < r.doc_id for x in r.sources) and not gone[r.doc_id] & set(range(r.start, r.end or r.start))
        gone[r.doc_id] |= set(range(r.start, words[r.doc_id] if r.whole else r.end))
    assert {d: len(x) for d, x in gone.items()} == {d: k for d, _, k, _ in brute(rows, 50) if k}
