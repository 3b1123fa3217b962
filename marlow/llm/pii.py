"""Personal data spans with DataFrame functions alone: patterns propose, checksums confirm, context words score.

Matches of a pattern are taken by regexp_extract_all and the text between them by split; the running
sum of both lengths gives code point offsets, and the text between gives the context. Runs are possessive
and start at a run's first character, or where the last match ended, and matches are gone through in
blocks, so that very long texts, with many matches too, cost time about in proportion to their length.

The kinds email, ip, card and phone are always reported. The others are added by the method: iban
(mod-97) and us_ssn are reported only if their score, raised by context words near by, is at least
LEAST. A null text has no spans, as an empty one; each input row gives one row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, NEAR = 0.5, 40
# Elements that an array grows by before it is copied to a longer one.
BLOCK = 256
_LOCAL = "[A-Za-z0-9._%+-]"
# kind: (a cheap test of the text, pattern, score without context, context words); the order is that of the contract
KINDS = {
    "email": ("@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "mail|contact|write"),
    "ip": (".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, "ip|address|server|host"),
    "card": (None, r"[0-9](?:[\x20-]?[0-9])++", 0.8, "card|visa|credit|payment|account"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]", 0.5, "phone|call|tel|mobile|fax"),
    "iban": (None, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", 0.7, "iban|bank|account|konto|compte"),
    "us_ssn": ("-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.2, "ssn|social security"),
}
BASE = ("email", "ip", "card", "phone")
_PART = "(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]?)|0++)"
_SPAN = "array<struct<start:int,kind_no:int,end:int,score:double>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        v = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, v * 2 - F.when(v > 4, 9).otherwise(0)).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number without spaces passes the mod-97 check."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 58, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        plain = F.replace(m, F.lit(" "), F.lit(""))
        return F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(False)
    return F.lit(True)


def _bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once, however often fn names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _blocks(values: Column) -> Column:
    """An array cut into arrays of BLOCK elements: what grows element by element is copied within a block alone."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(values) - 1) / BLOCK), F.lit(0)).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))


def _located(text: Column, kind: str, matches: Column) -> Column:
    """Spans of the valid matches, with offsets and scores; each match stands between two gaps."""
    no = list(KINDS).index(kind)
    _, pattern, score, context = KINDS[kind]
    none = F.array().cast(_SPAN)

    def state(at: Column, out: Column) -> Column:
        return F.struct(at.alias("at"), out.alias("out"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["m"])
        around = F.lower(F.concat_ws(" ", F.substring(x["gap"], -NEAR, NEAR), F.substring(x["next"], 1, NEAR)))
        scored = F.when(around.rlike(rf"\b(?:{context})"), F.lit(min(1.0, score + 0.4))).otherwise(F.lit(score))
        span = F.struct(begin.alias("start"), F.lit(no).alias("kind_no"), end.alias("end"), scored.alias("score"))
        return state(end, F.when(_valid(kind, x["m"]), F.array_append(acc["out"], span)).otherwise(acc["out"]))

    def add_block(acc: Column, block: Column) -> Column:
        return _bound(F.aggregate(block, state(acc["at"], none), add), lambda x: state(x["at"], F.concat(acc["out"], x["out"])))

    def spans(gaps: Column) -> Column:
        each = F.zip_with(F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, g: F.struct(m.alias("m"), g.alias("gap"))), F.slice(gaps, F.lit(2), F.size(matches)), lambda x, g: F.struct(x["m"].alias("m"), x["gap"].alias("gap"), g.alias("next")))
        return _bound(each, lambda x: F.aggregate(_blocks(x), state(F.lit(0), none), add_block, lambda acc: acc["out"]))

    found = _bound(F.split(text, pattern, -1), spans)
    return found if kind in BASE else F.filter(found, lambda s: s["score"] >= LEAST)


def with_spans(docs: DataFrame, name: str = "_spans") -> DataFrame:
    """docs with an array of (start, kind_no, end, score), by start, then kind as listed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<string>")
    digit = text.rlike("[0-9]")
    proposed = {}
    for kind, (mark, pattern, _, _) in KINDS.items():
        test = text.contains(mark) if mark else digit
        if kind in ("ip", "phone", "us_ssn"):
            test &= digit
        proposed[kind] = F.when(test, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    # the matches are a stage of their own, so that none is taken twice
    docs = docs.withColumns({f"{name}_{k}": x for k, x in proposed.items()})
    located = [F.when(F.exists(F.col(f"{name}_{k}"), partial(_valid, k)), _located(text, k, F.col(f"{name}_{k}"))).otherwise(F.array().cast(_SPAN)) for k in KINDS]
    return docs.withColumn(name, F.array_sort(F.concat(*located))).drop(*[f"{name}_{k}" for k in KINDS])


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_added, base (text of the base spans), spans, scores: one row per input row."""
    s = F.col("_spans")
    count = lambda k: F.size(F.filter(s, lambda x: x["kind_no"] == list(KINDS).index(k))).cast("long")
    return with_spans(docs.select("doc_id", "text")).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.size(F.filter(s, lambda x: x["kind_no"] >= len(BASE))).cast("long").alias("n_added"),
        _joined(F.filter(s, lambda x: x["kind_no"] < len(BASE))).alias("base"), _joined(s).alias("spans"), F.array_join(F.transform(s, lambda x: F.format_number(x["score"], 2)), ",").alias("scores"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span in text replaced by its kind in brackets; a span inside an earlier one goes with it, of overlapping ones the first names both."""
    text = F.coalesce(F.col("text"), F.lit(""))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    none = F.array().cast("array<string>")

    def state(at: Column, out: Column) -> Column:
        return F.struct(at.alias("at"), out.alias("out"))

    def add_block(acc: Column, block: Column) -> Column:
        # the block's own text, so that a place in it is not looked for from the text's beginning
        own = F.substring(text, acc["at"] + 1, F.greatest(F.array_max(F.transform(block, lambda s: s["end"])) - acc["at"], F.lit(0)))

        def add(part: Column) -> Callable[[Column, Column], Column]:
            def one(inner: Column, s: Column) -> Column:
                gap = F.substring(part, inner["at"] - acc["at"] + 1, s["start"] - inner["at"])
                more = F.array_append(F.array_append(inner["out"], gap), F.get(names, s["kind_no"]))
                return state(F.greatest(inner["at"], s["end"]), F.when(s["start"] >= inner["at"], more).otherwise(inner["out"]))

            return one

        done = _bound(own, lambda part: F.aggregate(block, state(acc["at"], none), add(part)))
        return _bound(done, lambda x: state(x["at"], F.array_append(acc["out"], F.array_join(x["out"], ""))))

    clean = F.aggregate(_blocks(F.col("_pii")), state(F.lit(0), none), add_block, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    # other columns go by their places, so that none clashes with the spans
    placed = [c if c == "text" else f"column{i}" for i, c in enumerate(docs.columns)]
    out = with_spans(docs.toDF(*placed), "_pii").withColumn("text", F.when(F.size("_pii") > 0, clean).otherwise(F.col("text")))
    return out.select(placed).toDF(*docs.columns)
