import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from marlow.llm import bpe, queries

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def e():
    return bpe.encoder(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def tok(e):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=e.v.ranks, special_tokens={})


def texts():
    r = random.Random(3)
    some = ["", " ", "a", "<|endoftext|>", "\n\n  \t x", "naïve 漢字🙂🙂", "don't we'll", "=" * 300, " " * 999, "é́" * 40, "ab" * 5000, "\x00�"]
    chars = "abcdeé ñ漢\n\t .,!123'sthing🙂-=_" + "etaoin" * 4
    return some + ["".join(r.choice(chars) for _ in range(r.randint(1, 400))) for _ in range(300)]


def test_encode_as_the_library(e, tok):
    for t in texts():
        ids = e.encode(t)
        assert ids == tok.encode_ordinary(t) and e.decode(ids) == t.encode()


def test_every_token_and_random_bytes(e, tok):
    r = random.Random(5)
    for t, i in r.sample(sorted(e.v.ranks.items()), 3000):
        assert bpe.PrefixTable(e.v, t).ids() == [i]
    for _ in range(400):
        raw = b"".join(r.choice(list(e.v.bytes_of.values())[:3000]) for _ in range(r.randint(1, 30)))
        assert bpe.PrefixTable(e.v, raw).ids() == tok._encode_single_piece(raw)


def test_append_prefixes_and_splice(e, tok):
    raw = (" international standardisation of hyphenated-words" * 40).encode()
    p = bpe.PrefixTable(e.v, raw[:500])
    p.append(raw[500:])
    assert p.ids() == tok._encode_single_piece(raw)
    for n in (1, 77, 501, 1200):
        assert p.ids(n) == tok._encode_single_piece(raw[:n])
    done = p.splice(700, 705, b"XYZ")
    raw = raw[:700] + b"XYZ" + raw[705:]
    assert p.data == raw and p.ids() == tok._encode_single_piece(raw) and done < 700


@settings(max_examples=600, deadline=None)
@given(st.lists(st.text("aBsé'stredmlv 1.!\n\t×ÿ²ªµ¿—漢\x1c\xa0\x85œ", max_size=14), min_size=1, max_size=5))
def test_splits_are_those_of_the_pattern(texts):
    raw = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    if not len(data):
        return
    starts, good = bpe.splits(data, at)
    find = regex.compile(P.PATTERN).findall
    for k, t in enumerate(texts):
        if good[k]:
            own = [int(s) for s in starts if at[k] <= s < at[k + 1]] + [int(at[k + 1])]
            assert [bytes(data[a:b]).decode() for a, b in zip(own, own[1:])] == find(t)
        assert good[k] or set(t) & set("²ªµ—漢\xa0\x85")


def test_columns(spark, e):
    df = spark.createDataFrame([(1, "a b", 5), (2, None, 6), (None, "", 7), (1, "a b", 5)], "doc_id long, text string, ids int")
    rows = bpe.encode(df, PATH, P.PATTERN)
    assert sorted([(r.doc_id, r.ids) for r in rows.collect()], key=str) == sorted([(1, e.encode("a b")), (2, []), (None, []), (1, e.encode("a b"))], key=str)
    assert sorted(bytes(r.bytes) for r in bpe.decode(rows, PATH, P.PATTERN).collect()) == [b"", b"", b"a b", b"a b"]
    assert bpe.digests(df.limit(0), PATH, P.PATTERN).count() == 0


def test_digests_of_odd_texts(spark, tok):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r.ids_sha256 for r in bpe.digests(spark.createDataFrame(rows, "doc_id long, text string"), PATH, P.PATTERN).collect()}
    assert got == {i: hashlib.sha256(" ".join(map(str, tok.encode_ordinary(t))).encode()).hexdigest() for i, t in rows}


def test_pieces_are_compared_by_bytes(spark, tok):
    data = np.frombuffer(b"ab ac ab abc", np.uint8)
    starts, ends = np.array([0, 3, 6, 9]), np.array([2, 5, 8, 12])
    assert bpe.unlike(data, starts, ends, np.array([0, 0, 0, 0])).tolist() == [1, 3] and bpe.unlike(data, starts, ends, np.arange(4)).tolist() == []
    assert bpe.unlike(data, starts[:0], ends[:0], starts[:0]).tolist() == []
    # regular pieces that polynomial hashes modulo 2**64 take for equal
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    rows = [(k, "".join("ab"[x ^ k] for x in bits)) for k in (0, 1)]
    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in bpe.digests(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), PATH, P.PATTERN).collect()}
    assert got == {k: (len(tok.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for k, t in rows}


def test_query(spark, sf, tok):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = tok.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), sha(" ".join(map(str, ids)).encode()), sha(tok.decode_bytes(ids)))
    assert {r.doc_id: tuple(r)[1:] for r in queries.op3_bpe(spark, sf).collect()} == want
