import random

import numpy as np
import pyarrow as pa

from marlow.llm import _words as w
from marlow.llm._graph import components
from marlow.llm._repeats import anchors_of, covered


def hashes(texts):
    data, offsets = w.utf8(pa.array(texts, pa.string()))
    starts, ends, first = w.words(data, offsets)
    return w.word_hashes(data, starts, ends), first, [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]


def test_words_are_those_of_the_pattern():
    texts = ["a b\tc\n", None, "", "  ", "é\x0b漢\x1c字\xa0z", "x"]
    _, first, words = hashes(texts)
    assert words == ["a", "b", "c", "é", "漢\x1c字\xa0z", "x"] and first.tolist() == [0, 3, 3, 3, 3, 5, 6]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    r = random.Random(1)
    vocab = ["w%d" % i for i in range(3000)] + ["é" * 50, "long" * 30_000, "ab", "ba", "aab"]
    text = " ".join(r.choice(vocab) for _ in range(120_000))
    h, first, words = hashes([text, text[::2] + " ab", " ab"])
    by = {}
    for word, x in zip(words, h.tolist()):
        assert by.setdefault(word, x) == x
    assert len(set(by.values())) == len(by)
    g = w.gram_hashes(h, 3)
    seen = {}
    for i, x in enumerate(g.tolist()):
        assert seen.setdefault(x, tuple(words[i : i + 3])) == tuple(words[i : i + 3])
    for d in w.text_digests(*w.utf8(pa.array(["q a b", "a b", "a  b", "", "b a", None], pa.string()))):
        assert d[1] == d[2] != d[4] and d[3] == d[5] == 0 and d[0] != d[1]


def test_hashes_of_n_words_whatever_n():
    h = np.random.default_rng(5).integers(0, 2**63, 70).astype(np.uint64)
    for n in (1, 2, 3, 5, 7, 8, 13, 50, 70):
        g = w.gram_hashes(h, n)
        assert len(g) == 70 - n + 1 == len(set(g.tolist())) and [w.gram_hashes(h[i : i + n], n)[0] for i in range(len(g))] == g.tolist()
    assert len(w.gram_hashes(h, 71)) == 0


def test_regular_patterns_do_not_collide():
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    texts = ["".join("ab"[x ^ flip] for x in bits) for flip in (0, 1)] + [" ".join("ab"[x ^ flip] for x in bits) for flip in (0, 1)]
    h, first, _ = hashes(texts)
    assert h[0] != h[1]
    for n in (256, 1024):
        a, b = (w.gram_hashes(h[first[k] : first[k + 1]], n)[0] for k in (2, 3))
        assert a != b


def test_leftmost_minima_and_anchors():
    rng = np.random.default_rng(2)
    v = rng.integers(0, 6, 400).astype(np.uint64)
    for width in (1, 2, 5, 7, 26):
        assert w.leftmost_minima(v, width).tolist() == [i + int(np.argmin(v[i : i + width])) for i in range(400 - width + 1)]
    assert len(w.leftmost_minima(v[:3], 5)) == 0
    h = rng.integers(0, 2**63, 200).astype(np.uint64)
    first = np.array([0, 60, 60, 70, 200])
    p, s, e, text, _ = anchors_of(h, first, 5, 12)
    starts = [i for a, b in zip(s, e) for i in range(a, b + 1)]
    assert starts == [i for a, b in zip(first, first[1:]) for i in range(a, b - 11)]
    assert all(first[t] <= a <= q <= b + 7 for q, a, b, t in zip(p, s, e, text)) and all((q >= b) & (q <= a + 7) for q, a, b in zip(p, s, e))


def test_covered():
    assert covered([(5, 6), (0, 1), (30, 30)], 4, 33) == [(0, 10), (30, 33)]
    assert covered([(6, 6), (0, 1)], 4, 33) == [(0, 5), (6, 10)] and covered([], 4, 9) == []


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5), (None, 7)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {a: find(a) for a in root if any(a in e and e[0] != e[1] and None not in e for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
