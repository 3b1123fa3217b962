import zlib

import numpy as np

from marlow.llm import langid, queries


def test_gradients():
    rng = np.random.default_rng(0)
    m = langid._start(["a", "b", "c"], 3, rng)
    m.x, m.u, m.out, m.bias = [x.astype(float) for x in m.x], [u.astype(float) for u in m.u], m.out.astype(float), m.bias.astype(float)
    codes, want = rng.integers(0, 5, (7, 4)), np.array([0, 1, 2, 1])
    _, grads = langid.gradients(m, codes, want)
    for w, g in zip(m.weights(), grads):
        for _ in range(6):
            at = tuple(rng.integers(0, min(n, 5)) for n in w.shape)
            old, eps = w[at], 1e-5
            w[at] = old + eps
            up = langid.gradients(m, codes, want)[0]
            w[at] = old - eps
            down = langid.gradients(m, codes, want)[0]
            w[at] = old
            assert abs((up - down) / (2 * eps) - g[at]) < 1e-6


def test_pooling_is_the_mean_over_all_positions():
    m = langid._start(["a", "b"], 8, np.random.default_rng(1))
    raw = [b"", b"x", bytes(range(1, 201)) * 2, b"y" * 128]
    offsets = np.cumsum([0, *map(len, raw)])
    got = langid.pooled(m, np.frombuffer(b"".join(raw), np.uint8), offsets)
    for k, text in enumerate(raw):
        total = np.zeros(2)
        for lo in range(0, len(text), langid.SPAN):
            part = text[lo : lo + langid.SPAN]
            codes = np.frombuffer(part.ljust(langid.SPAN, b"\0"), np.uint8).astype(int)
            states = []
            for d, order in enumerate((range(langid.SPAN), range(langid.SPAN - 1, -1, -1))):
                h, own = np.zeros((8, 1), np.float32), {}
                for t in order:
                    h = own[t] = langid._step(m.x[d][:, codes[t : t + 1]], m.u[d], h)[3]
                states.append(own)
            for t in range(len(part)):
                total += langid._softmax(m.out @ np.concatenate([states[0][t], states[1][t]]) + m.bias)[:, 0]
        assert np.allclose(got[k], total / max(1, len(text)), atol=1e-5)


def test_defined_cases(spark):
    rows = [(i, "the quick brown fox and the dog" if i % 2 else "der schnelle braune fuchs und ein hund", "en" if i % 2 else "de", "s") for i in range(40)]
    rows += [(100, None, "en", "s"), (101, "", None, None), (102, "12 34 !", "de", "s"), (None, "the fox", "en", "s"), (103, "the dog " * 40_000, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = {r.doc_id: r for r in langid.identify(df).collect()}
    assert len(out) == len(rows) and {out[k].lang_pred for k in (100, 101, 102)} == {"und"} and out[102].score == 0
    assert out[103].lang_pred == "en" and out[1].lang_pred == "en" and out[2].lang_pred == "de"
    assert out[7].held_out == (zlib.crc32(b"7") % 4 == 2)
    none = langid.identify(df.where("lang is null")).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert langid.identify(df.limit(0)).count() == 0
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {100, 101, 102}


def test_sample_is_bounded(spark):
    df = spark.range(3000).selectExpr("7L as doc_id", "repeat('word ', 9000) as text", "if(id % 2 = 0, 'aa', 'bb') as lang")
    rows = langid.sample(df, 20)
    assert sorted(x for x, _ in rows) == ["aa"] * 20 + ["bb"] * 20 and max(len(t) for _, t in rows) == langid.TEXT_CHARS
    many = spark.range(900).selectExpr("id as doc_id", "'word' as text", "concat('l', least(id, 400)) as lang")
    labels = {x for x, _ in langid.sample(many, 5)}
    assert len(labels) == langid.MOST_LABELS and "l400" in labels


def test_nothing_learned_keeps_texts_with_letters(spark):
    df = spark.createDataFrame([(1, "some words", None), (2, "12 34", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in langid.keep_identified(df).collect()] == [1] and langid.keep_identified(df.limit(0)).count() == 0


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = queries.op4_language(spark, sf).join(docs, "doc_id").where("held_out and lang is not null").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_the_bound_falls_with_many_labels():
    assert langid.least_of(0) == langid.least_of(5) == langid.LEAST and langid.least_of(100) == 0.02
