"""String similarity as column expressions. Distances count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; two empty strings are equal."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / n)


def partial_ratio(a: Column, b: Column) -> Column:
    """Best ratio of the shorter string with a substring of its length in the longer one; an empty shorter string gives 1."""
    swap = F.length(a) > F.length(b)
    short, long = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    n = F.length(short)
    at = F.sequence(F.lit(1), F.length(long) - n + 1)
    best = F.array_max(F.transform(at, lambda i: 1 - F.levenshtein(short, F.substring(long, i, n)) / n))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), best))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    n = F.least(F.length(a), F.length(b))
    found = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.get(found, F.lit(0)) - 1, n))


def _either_contains(a: Column, b: Column) -> Column:
    return a.contains(b) | b.contains(a)


def name_score(a: Column, b: Column) -> Column:
    """Similarity of two names in [0, 1]: mostly whole distance, a little of the best part.

    Other first characters and lengths apart by three or more cost; a common prefix and one name inside
    the other help. Equal names score 1, an empty one 0.
    """
    la, lb = F.length(a), F.length(b)
    gap, longer = F.abs(la - lb), F.greatest(la, lb)
    s = 0.85 * _ratio(a, b) + 0.15 * partial_ratio(a, b)
    s = s - F.when((la > 0) & (lb > 0) & (F.substring(a, 1, 1) != F.substring(b, 1, 1)), 0.05).otherwise(0.0)
    s = s - F.when(gap >= 3, 0.05 * gap / longer).otherwise(0.0)
    s = s + 0.02 * common_prefix(a, b) + F.when(_either_contains(a, b), 0.06).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)))


def text_score(a: Column, b: Column) -> Column:
    """Similarity of a query and a longer text in [0, 1]: mostly the best part, a strong bonus for containment."""
    la, lb = F.length(a), F.length(b)
    gap, longer = F.abs(la - lb), F.greatest(la, lb)
    s = 0.4 * _ratio(a, b) + 0.6 * partial_ratio(a, b)
    s = s - F.when(gap >= 10, 0.02 * gap / longer).otherwise(0.0)
    s = s + 0.01 * common_prefix(a, b) + F.when(_either_contains(a, b), 0.2).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)))


def subsequence_score(pattern: Column, text: Column) -> Column:
    """Points for the characters of pattern found in order: 2 next to the last hit, else 1; -1 if some are missing.

    The first character can not be next to a hit before the text, so it gives 1. Case is ignored.
    """
    p, t = F.lower(pattern), F.lower(text)
    start = F.struct(F.lit(0).alias("score"), F.lit(1).alias("want"), F.lit(-2).alias("last"))

    def step(acc: Column, i: Column) -> Column:
        hit = (acc["want"] <= F.length(p)) & (F.substring(t, i + 1, F.lit(1)) == F.substring(p, acc["want"], F.lit(1)))
        gain = F.when(hit & (acc["last"] == i - 1), 2).when(hit, 1).otherwise(0)
        return F.struct((acc["score"] + gain).alias("score"), (acc["want"] + hit.cast("int")).alias("want"), F.when(hit, i).otherwise(acc["last"]).alias("last"))

    at = F.when(F.length(t) > 0, F.sequence(F.lit(0), F.length(t) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(at, start, step, lambda acc: F.when(acc["want"] > F.length(p), acc["score"]).otherwise(-1))


def display_score(raw: Column) -> Column:
    """A raw match score (0 is perfect, negative is worse) on the scale 0 to 1."""
    return F.when(raw.isNull(), 0.0).when(raw > 1, raw).otherwise(F.exp((F.pow(1 - raw, F.lit(0.04307)) - 1) * -2))


def raw_score(display: Column) -> Column:
    """The inverse of display_score()."""
    return F.when(display == 0, F.lit(float("-inf"))).when(display > 1, display).otherwise(1 - F.pow(F.ln(display) / -2 + 1, F.lit(1 / 0.04307)))


def character_mask(text: Column) -> Column:
    """32 bits for the classes of characters in a text: a bit for each of a-z, one for digits (26), other ASCII (30), all others (31); spaces set none."""

    def bit(c: Column) -> Column:
        n = F.ascii(c)
        return F.when(c == " ", 0).when(c.between("a", "z"), F.pow(F.lit(2), n - 97).cast("long")).when(c.between("0", "9"), 1 << 26).when(n <= 127, 1 << 30).otherwise(1 << 31).cast("long")

    chars = F.filter(F.split(F.lower(text), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("long"), lambda acc, c: acc.bitwiseOR(bit(c)))


def may_match(search_mask: Column, target_mask: Column) -> Column:
    """Whether a target has every class of character that the search has: a cheap test before a costly score."""
    return search_mask.bitwiseAND(target_mask) == search_mask
