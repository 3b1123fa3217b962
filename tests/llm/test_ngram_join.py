import random
import re

from pyspark.sql import functions as F

from marlow.llm import ngram_join, queries
from marlow.llm._graph import components
from tests.llm.test_substring import swapped

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(t, n=5):
    w = WORD.findall(t or "")
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, threshold=0.8):
    sets = [grams(t) if d is not None else set() for d, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    where = {}
    for k, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(k)
    for a, s in enumerate(sets):
        near = {}
        for g in s:
            for b in where[g]:
                near[b] = near.get(b, 0) + 1
        for b, both in near.items():
            if a < b and both >= threshold * (len(s) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    low = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            low[find(k)] = min(low.get(find(k), d), d)
    return sorted([(d, low.get(find(k)), links[k]) for k, (d, _) in enumerate(rows)], key=str)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    r = random.Random(9)
    vocab = ["w%d" % i for i in range(400)] + ["é漢", "x"]
    base = [[r.choice(vocab) for _ in range(r.choice([3, 6, 40, 120]))] for _ in range(25)]
    rows = []
    for k in range(220):
        w = list(base[k % 25] if k % 2 else base[0])
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((k * 7 % 220, r.choice([" ", "\n"]).join(w)))
    rows += [(300, None), (301, ""), (302, " \t"), (None, rows[0][1]), (303, rows[3][1]), (303, "other words"), (304, "word " * 30_000), (305, "a b"), (306, "a  b"), (307, "a b c")]
    df = spark.createDataFrame([(d, t, "s", 1) for d, t in rows], "doc_id long, text string, node string, keys int")
    got = ngram_join.ngram_join(df).collect()
    assert sorted([(x.doc_id, x.class_id, x.n_links) for x in got], key=str) == brute(rows)
    assert all(x.kept == (x.doc_id == x.class_id or x.doc_id is None) for x in got)
    assert ngram_join.ngram_join(df.limit(0)).count() == 0
    one = ngram_join.one_of_each(df)
    assert one.columns == df.columns and {x.doc_id for x in one.collect()} == {d for d, c, _ in brute(rows) if d is None or d == c}


def test_chains_are_verified_by_buckets(spark, monkeypatch):
    """A chain of texts, each like its neighbours alone: its sets are not copied to pairs of blocks of the whole component."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    words = ["w%d" % i for i in range(3400)]
    rows = [(k, " ".join(words[8 * k : 8 * k + 90])) for k in range(400)] + [(500 + k, " ".join([f"v{i}" for i in range(60)] + [f"u{k}"])) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted([(x.doc_id, x.class_id, x.n_links) for x in ngram_join.ngram_join(df).collect()], key=str) == brute(rows)
    bands, n_rows = ngram_join.bands_and_rows(0.8, ngram_join.RECALL)
    signed = ngram_join.signatures(df, 5, bands, n_rows)
    classes = signed.selectExpr("node", "doc_id", "1L as weight", "keys")
    in_band = classes.selectExpr("node", "explode(keys) as key")
    low = in_band.groupBy("key").agg(F.min("node").alias("b"))
    near = components(in_band.join(low, "key").selectExpr("node as a", "b"))
    got = ngram_join.groups_of(near, in_band, classes).collect()
    split = {r.doc_id for r in got if r.banded}
    assert split >= set(range(400)) and not split & set(range(500, 530))
    copies = sum(g.blocks for r in got if r.doc_id < 400 for g in r.grps)
    assert copies < 400 * 50 / 2


def test_links_do_not_depend_on_the_size_of_a_component(spark, monkeypatch):
    """At a recall where pairs are missed, the same pairs are missed in whole components and in buckets."""
    words = ["w%d" % i for i in range(1400)]
    df = spark.createDataFrame([(k, " ".join(words[8 * k : 8 * k + 90])) for k in range(120)], "doc_id long, text string")
    seen = []
    for block in (128, 8):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        seen.append(sorted((x.doc_id, x.class_id, x.n_links) for x in ngram_join.ngram_join(df, recall=0.9).collect()))
    assert seen[0] == seen[1] and 0 < sum(n for _, _, n in seen[0]) < 2 * sum(n for _, _, n in brute([(k, " ".join(words[8 * k : 8 * k + 90])) for k in range(120)]))


def test_regular_texts_are_two_classes(spark):
    rows = list(enumerate(swapped()))
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.class_id, x.copy_id, x.n_links, x.kept) for x in got) == [(0, 0, 0, 0, True), (1, 1, 1, 0, True)]


def test_bands():
    b, r = ngram_join.bands_and_rows(0.8, 0.9995)
    assert b * r <= 128 and 1 - (1 - 0.8**r) ** b >= 0.9995


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted([(x.doc_id, x.class_id, x.n_links) for x in queries.op6_ngram_join(spark, sf).collect()], key=str)
    assert got == brute(rows) and sum(n > 0 for _, _, n in got) > 20
