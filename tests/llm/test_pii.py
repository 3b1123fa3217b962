import hashlib
import random
import re
import time

from marlow.llm import pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    """(start, kind number, end) of the base spans, by the plain patterns."""
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def joined(spans):
    return ",".join(f"{list(pii.KINDS)[k]}:{s}:{e}" for s, k, e in spans)


def texts():
    r = random.Random(6)
    bits = ["a@b.c", "x.y%z@-a.b-c.d", "@", "a@b", "@d.e", "+", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.002.3.0255", "0", "00", "10.0.0.1", "0.0.0.0", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500000000000004", "  ", "-", ".", "+1 (415) 555-0100", "+33 1 23 45 67 89", "+1((", "é漢🙂", "\n", "\t", "word", "12", "7", "(", ")", "\0"]
    some = [None, "", "a" * 50_000, "1" * 20_000, "1." * 5000, "a.b" * 9000 + "@", "+1 " + "(" * 5000, "1 " * 8000, "a@b." * 2000, "🙂" * 300 + "me@x.org" + "🙂" + "4111111111111111"]
    return some + ["".join(r.choice(bits) + r.choice(["", "", " "]) for _ in range(r.randint(1, 30))) for _ in range(1500)]


def test_base_spans_against_plain_patterns(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()}
    for i, t, _ in rows:
        want = brute(t)
        assert got[i].base == joined(want), (t, got[i].base)
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(s[1] == n for s in want) for n in range(4)]
        assert set(filter(None, got[i].base.split(","))) <= set(got[i].spans.split(","))
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_addresses_with_zero_parts(spark):
    texts = ["0.0.0.0", "at 10.0.0.1 now", "1.2.3.000", "127.0.0.1 192.168.0.10", "00.01.000.0255", "0.0.0.256", "0.0.0.0256 10.0.0.1000", "0" * 4000 + ".0.0.0", "0." * 9000 + "0", "100.200.0.250"]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert got[i].base == joined(brute(t)), (t[:50], got[i].base[:50])
    assert [got[i].n_ip for i in range(8)] == [1, 1, 1, 2, 1, 0, 0, 1]
    clean = pii.redact(spark.createDataFrame(rows[:4], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.text for r in clean] == ["[IP]", "at [IP] now", "[IP]", "[IP] [IP]"]


def test_added_kinds_and_context(spark):
    rows = [("IBAN: DE89 3704 0044 0532 0130 00.",), ("DE89370400440532013000",), ("DE88370400440532013000 bank",), ("her social security number is 219-09-9999",), ("part 219-09-9999",), ("mail me@x.org now",), ("see me@x.org",)]
    out = [r for r in pii.find_pii(spark.createDataFrame(rows, "text string").selectExpr("monotonically_increasing_id() as doc_id", "text")).orderBy("doc_id").collect()]
    assert [("iban" in r.spans, "us_ssn" in r.spans) for r in out] == [(True, False), (True, False), (False, False), (False, True), (False, False), (False, False), (False, False)]
    assert float(out[5].scores) > float(out[6].scores) and float(out[0].scores.split(",")[-1]) > 0.7


def test_redact(spark):
    rows = [(1, "a me@x.org b 1.2.3.4", "p"), (2, None, None), (3, "clean", "q"), (None, "🙂 +33 1 23 45 67 89!", "r")]
    out = pii.redact(spark.createDataFrame(rows, "doc_id long, text string, _spans string"))
    assert out.columns == ["doc_id", "text", "_spans"]
    assert sorted([tuple(r) for r in out.collect()], key=str) == sorted([(1, "a [EMAIL] b [IP]", "p"), (2, None, None), (3, "clean", "q"), (None, "🙂 [PHONE]!", "r")], key=str)


def test_redact_keeps_columns_of_any_name(spark):
    names = ["doc_id", "text", "_pii", "_pii_email", "_spans", "a.b", "column1"]
    df = spark.createDataFrame([(1, "me@x.org", "keep", "this", "one", "dotted", "placed"), (2, None, None, None, None, None, None)], "doc_id long, text string, c string, d string, e string, f string, g string").toDF(*names)
    out = pii.redact(df)
    assert out.columns == names
    assert sorted(map(tuple, out.collect())) == [(1, "[EMAIL]", "keep", "this", "one", "dotted", "placed"), (2, *[None] * 6)]


def test_time_grows_with_the_matches(spark):
    took = []
    for n in (5_000, 20_000):
        text = " ".join(f"write me{i}@x.org and 10.0.{i % 256}.1, " for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        r = pii.find_pii(df).first()
        clean = pii.redact(df).first().text
        took.append(time.perf_counter() - began)
        assert (r.n_email, r.n_ip) == (n, n) and r.base == joined(brute(text)) and clean == " ".join(["write [EMAIL] and [IP], "] * n)
    assert took[1] < 8 * took[0] + 2


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op1_pii(spark, sf).collect()
    assert len(rows) == len(docs) and sum(r.n_email + r.n_card for r in rows) > 0
    for r in rows:
        assert r.base_sha256 == hashlib.sha256(joined(brute(docs[r.doc_id])).encode()).hexdigest()
