"""Fuzzy joins against the score of every target."""

import random

from marlow import plans
from marlow.functions import fuzzy
from marlow.operators import fuzzy_join


def every(queries, targets, k):
    """All targets scored, by plain lists."""
    texts = sorted({t for t in targets if t})
    ready = fuzzy.Targets(texts)
    out = []
    for q in sorted({q for q in queries if q and q.strip()}):
        scores = fuzzy.search(q, ready)[0]
        found = sorted((-s, t) for s, t in zip(scores.tolist(), texts) if s > fuzzy.NEVER)[:k]
        out += [(q, t, round(-s, 9), n + 1) for n, (s, t) in enumerate(found)]
    return out


def rows(df):
    return sorted((r.query, r.target, round(r.raw, 9), r.rank) for r in df.collect())


def counted(monkeypatch):
    """The numbers of (query, target) pairs that are scored from now on."""
    seen, plain = [], fuzzy_join.scored

    def wrapped(pairs, blocks, k):
        seen.append(sum(len(r.texts) for r in pairs.join(blocks, "block").select("texts").collect()))
        return plain(pairs, blocks, k)

    monkeypatch.setattr(fuzzy_join, "scored", wrapped)
    return seen


def test_equals_the_scores_of_all(spark, monkeypatch):
    monkeypatch.setattr(fuzzy_join, "BLOCK_ROWS", 5)
    r = random.Random(5)
    parts = ["Red", "green", "bolt", "Gizmo", "éclair", "漢字", "x", "File_manager", "a-b", "12"]
    targets = [r.choice([" ", "", "_"]).join(r.choice(parts) for _ in range(r.choice([1, 2, 3, 9]))) for _ in range(300)] + ["", None, "one " * 400, "red", "red"]
    queries = ["re", "red", "gr bo", "bo gr", "fm", "é", "漢", "x", "b", "a a", "12x", "gzm", "zzz", "", "  ", None, "red", " Green bolt ", "r" * 40, "e e r", "字 x"]
    df = lambda x: spark.createDataFrame([(v, 1) for v in x], "text string, q int")
    for k in (1, 4, 1000):
        assert rows(fuzzy_join.fuzzy_join(df(queries), df(targets), "text", "text", k)) == sorted(every(queries, targets, k))
    assert fuzzy_join.fuzzy_join(df(queries).limit(0), df(targets), "text", "text").count() == 0
    assert fuzzy_join.fuzzy_join(df(queries), df(targets).limit(0), "text", "text").count() == 0


def test_query_over_the_tables(spark, sf, monkeypatch):
    """Every supplier's number in the customers' names, equal to all scores; few targets are scored."""
    seen = counted(monkeypatch)
    got = sorted((r.s_suppkey, r.c_custkey, r.rank) for r in plans.QUERIES["fuzzy_join"](spark, sf).collect())
    keys = {r.s_suppkey: f"cus {r.s_suppkey}" for r in spark.read.parquet(f"{sf}/supplier.parquet").collect()}
    names = {r.c_name: r.c_custkey for r in spark.read.parquet(f"{sf}/customer.parquet").collect()}
    want = every(keys.values(), names, 3)
    by_text = {q: [(names[t], n) for p, t, _, n in want if p == q] for q in keys.values()}
    assert got == sorted((s, c, n) for s, q in keys.items() for c, n in by_text[q])
    print("share of targets scored", sum(seen) / (len(keys) * len(names)))
    assert sum(seen) < 0.6 * len(keys) * len(names)


def test_small_blocks_turns_and_walks(spark, monkeypatch):
    for name, n in {"BLOCK_ROWS": 3, "SHARERS": 2, "KEY": 2, "TASK_PAIRS": 9, "WALK_QUERIES": 8, "SLICE_CHARS": 900, "CELLS": 3000, "STEPS": 20}.items():
        monkeypatch.setattr(fuzzy_join, name, n)
    r = random.Random(8)
    text = lambda alphabet, most: "".join(r.choice(alphabet) for _ in range(r.randrange(1, most)))
    targets = [text("abcAB _-é", 14) for _ in range(250)] + [f"Item#{n:06d}" for n in range(0, 9000, 53)]
    queries = [text("abcé ", 7) for _ in range(50)] + [f"it {n}" for n in range(0, 9999, 217)] + ["\t", "abc abc", "#0 it"]
    df = lambda x: spark.createDataFrame([(v,) for v in x], "text string")
    for k in (1, 3):
        assert rows(fuzzy_join.fuzzy_join(df(queries), df(targets), "text", "text", k)) == sorted(every(queries, targets, k))


def test_few_pairs_are_scored(spark, sf, monkeypatch):
    """By the words' own targets, not by blocks of similar ones: a fifth of what was scored before at the most."""
    seen = counted(monkeypatch)
    plans.QUERIES["fuzzy_join"](spark, sf)
    size = lambda name, c: spark.read.parquet(f"{sf}/{name}.parquet").select(c).distinct().count()
    assert 0 < sum(seen) < 0.08 * size("supplier", "s_suppkey") * size("customer", "c_name")
