import itertools
import random
from collections import Counter, defaultdict

from marlow.llm import packing, queries


def padding(lengths, counts, chosen):
    return sum(c * (min(b for b in chosen if b >= x) - x) for x, c in zip(lengths, counts))


def test_bounds_are_optimal():
    r = random.Random(2)
    for _ in range(60):
        lengths = sorted(r.sample(range(1, 40), r.randint(1, 9)))
        counts = [r.randint(1, 30) for _ in lengths]
        k = r.randint(1, 4)
        got = packing.bounds(lengths, counts, k)
        best = min(padding(lengths, counts, c + (lengths[-1],)) for n in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], n))
        assert len(got) <= k and got == sorted(got) and padding(lengths, counts, got) == best
    assert packing.bounds([], [], 4) == []


def check(rows, want, longest, budget):
    batches = defaultdict(list)
    for r in rows:
        assert r.n_tokens <= r.padded <= longest
        batches[r.bucket, r.batch].append(r)
    for (bucket, _), own in batches.items():
        assert len({r.padded for r in own}) == 1 and len(own) * own[0].padded <= max(budget, own[0].padded)
        assert sorted(r.slot for r in own) == list(range(len(own)))
    for bucket in {b for b, _ in batches}:
        full = max(1, budget // next(r.padded for (b, _), own in batches.items() if b == bucket for r in own))
        sizes = [len(batches[k]) for k in sorted(batches) if k[0] == bucket]
        assert all(s == full for s in sizes[:-1]) and [b for a, b in sorted(batches) if a == bucket] == list(range(len(sizes)))
    got = Counter()
    for r in rows:
        assert r.start == r.piece * longest
        got[r.doc_id] += r.n_tokens
    assert got == want


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 20)
    r = random.Random(8)
    rows = [(i, "w " * r.choice([0, 1, 3, 3, 3, 9, 40, 100]), 1) for i in range(300)] + [(7, None, 2), (None, "a b", 3), (5, "x y z", 4), (5, "x y z", 4)]
    want = Counter()
    for d, t, _ in rows:
        if t and t.split():
            want[d] += len(t.split())
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, bucket int"), longest=32, buckets=4, budget=64)
    check(out.collect(), want, 32, 64)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, sf):
    rows = queries.op9_packing(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    import re

    check(rows, Counter({d.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", d.text)) for d in docs if d.text.split()}), packing.LONGEST, packing.BUDGET)
