import hashlib
import random
import re

from marlow.llm import _repeats, queries, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    least = {}
    for d, w in words:
        for i in range(len(w) - window + 1) if d is not None else ():
            k = tuple(w[i : i + window])
            least[k] = min(least.get(k, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1) if d is not None else ():
            if least[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def cases():
    r = random.Random(4)
    w = lambda n: [r.choice("alpha béta γ delta 漢字 e f g".split()) for _ in range(n)]
    passage, other = w(14), w(11)
    docs = [w(r.randint(0, 40)) for _ in range(60)]
    for i in range(0, 60, 3):
        docs[i] = docs[i][:5] + passage[: r.randint(9, 14)] + docs[i][5:] + (other if i % 2 else [])
    rows = [(i * 7 % 60, r.choice([" ", "\n", "\t "]).join(x)) for i, x in enumerate(docs)]
    return rows + [(100, None), (101, ""), (102, " \n "), (None, " ".join(passage * 3)), (103, "x " * 3000), (104, "x " * 3000), (5, rows[5][1]), (5, " ".join(passage)), (105, "a" * 700_000 + " b")]


def test_against_brute_force(spark):
    rows = cases()
    for window in (10, 7):
        got = substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), window)
        got = sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()], key=str)
        assert got == brute(rows, window)


def parity(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def swapped(n=1024):
    """Two texts that tell polynomial hashes modulo 2**64 nothing: a Thue-Morse pattern and its swap, with words of their own behind each."""
    line = lambda a, b: " ".join(f"{(a, b)[t]} u{i}" for i, t in enumerate(parity(n)))
    return line("foo", "bar"), line("bar", "foo")


def test_regular_texts_are_told_apart(spark):
    rows = list(enumerate(swapped()))
    got = substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 50).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == brute(rows, 50)


def test_crowded_grams_are_dealt_out(spark, monkeypatch):
    """One run of words in all texts, one window in half of them: groups over GROUP_ROWS go by windows and salts, with the same result."""
    monkeypatch.setattr(_repeats, "GROUP_ROWS", 16)
    r = random.Random(8)
    run = ["c%d" % i for i in range(9)]
    w = lambda n: ["w%d" % r.randrange(10**6) for _ in range(n)]
    half = w(8) + run + w(8)
    rows = [(i, " ".join((half if i % 2 else w(5) + run + w(5)) + w(r.randrange(6)))) for i in range(120)] + [(200 + i, rows_[1]) for i, rows_ in enumerate([(0, " ".join(half))] * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for window in (10, 14):
        got = sorted([(x.doc_id, x.n_words, x.n_removed, x.kept) for x in substring.substring_dedup(df, window).collect()], key=str)
        assert got == brute(rows, window)
    level = _repeats.anchors(df, 4, 10)
    assert _repeats.shared(level).where("salts > 1").count() > 0


def test_levels_double():
    assert substring.lengths(50) == [13, 25, 50] and substring.lengths(1) == [1] and substring.lengths(7) == [2, 4, 7]


def test_text_keeps_other_columns_and_white_space(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "q\n a b  c d e f z", "y")], "doc_id long, text string, n_words string")
    out = {r[0]: tuple(r) for r in substring.remove_repeats(df, substring.repeated_windows, 6).collect()}
    assert out[2] == (2, "q\n z", "y", 8, 6, "q z") and out[1][1] == "a b c d e f"


def test_empty(spark):
    assert substring.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = {d: (n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(rows, 50)}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op10_substring_dedup(spark, sf).collect()}
    assert got == want and sum(k for _, k, _ in want.values()) > 0
