from collections import defaultdict

from pyspark.sql import functions as F

from marlow.operators import geometry, records
from marlow.plans import QUERIES


def screens(spark, sf):
    out = defaultdict(list)
    for p in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_size").collect():
        k, n = p.p_partkey, p.p_size
        out[k // 400].append((k, k * 37 % 1000, k * 61 % 800, 10 + n, 5 + n))
    return {g: sorted(x) for g, x in out.items()}


def iou(a, b):
    w = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    h = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])
    both = max(w, 0) * max(h, 0)
    return both / (a[3] * a[4] + b[3] * b[4] - both)


def test_suppressed_over_every_part(spark, sf):
    want = set()
    for g, rects in screens(spark, sf).items():
        kept = []
        for r in sorted(rects, key=lambda r: (-r[3] * r[4], r[0])):
            if all(iou(r, k) < 0.3 for k in kept):
                kept.append(r)
        want |= {(g, r[0]) for r in kept}
    got = [tuple(r) for r in QUERIES["suppressed"](spark, sf).collect()]
    assert len(got) == len(want) and set(got) == want and max(k for _, k in got) > 400


def test_kept_smaller_over_every_part(spark, sf):
    want = set()
    for g, rects in screens(spark, sf).items():
        gone = set()
        for i, a in enumerate(rects):
            for b in rects[i + 1 :]:
                if a[0] not in gone and b[0] not in gone and iou(a, b) > 0:
                    gone.add(a[0] if a[3] * a[4] > b[3] * b[4] else b[0])
        want |= {(g, r[0]) for r in rects if r[0] not in gone}
    got = [tuple(r) for r in QUERIES["kept_smaller"](spark, sf).collect()]
    assert len(got) == len(want) and set(got) == want and max(k for _, k in got) > 400


def test_numbers_in_order(spark):
    rows = [(p, (i * 7919) % 1000 / 3, f"t{i}") for i in range(3000) for p in [i % 2]] + [(1, None, "none")]
    df = spark.createDataFrame(rows, "p int, v double, t string")
    got = records.numbered(df, "n", F.col("v"), F.col("t"), part=F.col("p"))
    assert got.columns == ["p", "v", "t", "n"]
    got = [r.t for r in got.orderBy("n").collect()]
    assert got == [t for _, _, t in sorted(rows, key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2]))]
    assert records.numbered(df.limit(0), "n", F.col("v")).count() == 0


def test_names_in_no_text(spark):
    names = spark.createDataFrame([("ab",), ("b",), ("zz",), ("é漢",), ("",)], "name string")
    texts = spark.createDataFrame([("xabx",), ("é漢é",), (None,), ("",)], "t string")
    assert sorted(r.name for r in records.not_contained(names, texts, "name", "t", exact=False).collect()) == ["zz"]
    assert records.not_contained(names, texts.limit(0), "name", "t", exact=False).count() == 5
