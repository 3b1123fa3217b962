import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from marlow.llm import queries, token_alignment

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    """Owners of every byte; two tokens are linked if they own a byte together, groups end where both tokens end."""
    a_tok = Tokenizer.from_file(PATHS[0])
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown}
    for b in range(256):
        if b not in shown:
            table[chr(256 + len(table) - len(shown))] = b
    out, docs, links = [], Counter(), []
    for i, text in rows:
        text = text or ""
        a = a_tok.encode(" " + text, add_special_tokens=False)
        b = b_tok.encode(text, out_type=str)
        whole = (" " + text).encode()
        cut_a = [bytes(table[c] for c in p) for p in a.tokens]
        cut_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p[:3] == "<0x" else p.replace("▁", " ").encode() for p in b]
        ids_a, ids_b = a.ids, b_tok.encode(text)
        if not text or b"".join(cut_a) != whole or b"".join(cut_b) != whole:
            ids_a, ids_b, cut_a, cut_b = [], [], [], []
        own_a = [k for k, c in enumerate(cut_a) for _ in c]
        own_b = [k for k, c in enumerate(cut_b) for _ in c]
        linked = sorted(set(zip(own_a, own_b)))
        groups, now_a, now_b = [], [], []
        for k in range(len(own_a)):
            if not now_a or now_a[-1] != own_a[k]:
                now_a.append(own_a[k])
            if not now_b or now_b[-1] != own_b[k]:
                now_b.append(own_b[k])
            if k + 1 == len(own_a) or (own_a[k + 1] != own_a[k] and own_b[k + 1] != own_b[k]):
                groups.append(",".join(str(ids_a[x]) for x in now_a) + "|" + ",".join(str(ids_b[x]) for x in now_b))
                now_a, now_b = [], []
        pairs = [(ids_a[x], ids_b[y]) for x, y in linked]
        docs.update(set(pairs))
        links.append(pairs)
        out.append([i, len(ids_a), len(ids_b), len(groups), len(linked), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""])
    most = Counter()
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    return sorted([(*o[:5], sum(docs[p] == most[p[0]] for p in pairs), sum(docs[p] for p in pairs), o[5]) for o, pairs in zip(out, links)], key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


TEXTS = [
    "The quick brown fox", "the quick brown fox jumps", "  two  spaces\tand\ttabs\n\nlines ", "naïve café — ünïcödé 漢字かな 한국어 🙂🙃", "a▁b is not a blank", "nul \x00 byte",
    "<|endoftext|> and </s> <s> <unk> <0x41>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "1234567890 3.14159 1,000", "é combining ​  odd", "x", " ", "\n", "", None, "don't we'll I've", "\r\n\r\n windows", "supercalifragilisticexpialidocious" * 20,
]


def test_against_brute_force(spark, monkeypatch):
    rows = list(enumerate(TEXTS)) + [(100 + k, TEXTS[1]) for k in range(40)] + [(5, "the other text of an id"), (None, "no id at all")]
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id int, text string, chunk int, a string, count int")
    assert found(token_alignment.digests(df.repartition(5), *PATHS)) == brute(rows)
    assert token_alignment.digests(df.limit(0), *PATHS).count() == 0
    assert found(token_alignment.digests(df.where("text is null"), *PATHS)) == brute([(14, None)])


def test_a_very_long_text(spark):
    rows = [(1, "word and number 17 " * 30_000 + "é" * 5000), (2, "word and")]
    assert found(token_alignment.digests(spark.createDataFrame(rows, "doc_id long, text string"), *PATHS)) == brute(rows)


def test_links_groups_and_products(spark):
    rows = list(enumerate(TEXTS))
    t = token_alignment.tokenizers(*PATHS)
    for r in token_alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), *PATHS).collect():
        spans = []
        for ids, size in ((r.a, t.size_a), (r.b, t.size_b)):
            ends = [0]
            for i in ids:
                ends.append(ends[-1] + int(size[i]))
            spans.append(list(zip(ends, ends[1:])))
        over = {(i, j) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if max(s, u) < min(e, v)}
        assert {(p.a, p.b) for p in r.links} == over and len(r.links) == len(over)
        x = token_alignment.aligned([r.a], [r.b], t.size_a, t.size_b)
        assert [(p.a, p.b) for p in r.groups] == list(zip(x.group_a.tolist(), x.group_b.tolist()))
        group, left, right = token_alignment.products(x)
        wanted, a0, b0 = [], 0, 0
        for g, (a1, b1) in enumerate(zip(x.group_a.tolist(), x.group_b.tolist())):
            wanted += [(g, i, j) for i in range(a0, a1) for j in range(b0, b1)]
            a0, b0 = a1, b1
        assert list(zip(group.tolist(), left.tolist(), right.tolist())) == wanted and over <= {w[1:] for w in wanted}


def test_both_libraries_of_a_agree():
    t = token_alignment.tokenizers(*PATHS)
    texts = [x for x in TEXTS if x] + ["".join(map(chr, range(1, 0x250))), "ÀÉî ñandú ß Œuvre ½ ² ª º \xa0\x85 \x1c\x1d x", "'s's 'S'LL '' don''t 've"]
    assert t.latin is not None
    for x in texts:
        assert t.latin.encode_ordinary(" " + x) == t.a.encode(" " + x, add_special_tokens=False).ids, x


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert found(queries.op12_token_alignment(spark, sf)) == brute(rows)
