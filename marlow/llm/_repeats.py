"""Word windows that stand in several documents: the stages that two operators share.

Anchors: in each window of `window` words the leftmost smallest hash among its grams of `gram`
words. Which gram that is depends on the words alone, so equal windows have equal anchors, and
about 2 / (window - gram + 2) of all positions are anchors. Each window belongs to one anchor.

A group of rows with one anchor is compared in one task, up to GROUP_ROWS rows. Larger groups are
dealt by the windows' own hashes and, within one window, by salts: whatever part of all rows a gram or
a window holds, no task gets more than its share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlow.llm._graph import crowded_join
from marlow.llm._words import gram_hashes, leftmost_minima, pieces, text_digests, utf8, word_hashes, words

WINDOW_KEY = 0xC2B2AE3D27D4EB4F
# Rows of one anchor that one task compares; those of an anchor with more are dealt to several.
GROUP_ROWS = 5_000
# Windows that are compared at once.
AT_ONCE = 1 << 19


def salts(rows: F.Column) -> F.Column:
    return F.ceil(rows / GROUP_ROWS).cast("int")


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def anchors_of(hashes: np.ndarray, first: np.ndarray, gram: int, window: int):
    """Anchor positions, the first and last window start of each, its text and its gram's hash."""
    grams = gram_hashes(hashes, gram)
    best = leftmost_minima(grams, window - gram + 1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    starts = np.flatnonzero(np.arange(len(best)) + window <= first[text[: len(best)] + 1])
    at = best[starts]
    runs = np.flatnonzero(np.diff(at, prepend=-1))
    last = starts[np.append(runs[1:], len(starts)) - 1] if len(runs) else runs
    p = at[runs]
    return p, starts[runs], last, text[starts[runs]], grams[p]


def texts_of(batch: pa.RecordBatch):
    """Word hashes and digests, a few texts at a time: (row of the first, hashes, first words, digests in two halves)."""
    data, offsets = utf8(batch.column("text"))
    for lo, hi in pieces(np.diff(offsets)):
        part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, first = words(part, own)
        yield lo, word_hashes(part, starts, ends), first, text_digests(part, own)


def with_text(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def anchors(docs: DataFrame, gram: int, window: int) -> DataFrame:
    """(h, digest, doc_id, pos, check): every anchor of every text; digest tells texts apart, check is its other half at a text's first anchor, else null."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            for lo, hashes, first, (digests, checks) in texts_of(b):
                p, _, _, text, h = anchors_of(hashes, first, gram, window)
                later = np.diff(text, prepend=-1) == 0
                check = pa.array(checks[text].view(np.int64), mask=later)
                yield pa.RecordBatch.from_arrays([signed(h), signed(digests[text]), pa.array(ids[lo + text]), pa.array((p - first[text]).astype(np.int32)), check], ["h", "digest", "doc_id", "pos", "check"])

    return with_text(docs).mapInArrow(find, "h long, digest long, doc_id long, pos int, check long")


def shared(level: DataFrame) -> DataFrame:
    """(h, salts): the grams of anchors() that stand in two different texts, with the number of groups their rows are dealt to.

    A gram is known by its smallest and largest text, which every task folds before it shuffles, so one
    of any number of rows is decided without being gathered.
    """
    runs = level.groupBy("h").agg(F.min("digest").alias("low"), F.max("digest").alias("high"), F.count("*").alias("n"))
    return runs.where("low < high").select("h", salts(F.col("n")).alias("salts"))


def marked(level: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc_id, digest, pos, at, salts): the rows of anchors() whose gram is in shared(), which is a written table."""
    found = crowded_join(level.select("h", "doc_id", "digest", "pos"), runs, "h", "salts", F.struct("doc_id", "pos"))
    return found.select("doc_id", "digest", "pos", F.col("pos").alias("at"), "salts")


def own_marks(b: pa.RecordBatch, lo: int, first: np.ndarray, digests: np.ndarray, most: int):
    """Marks of a few texts of a batch with the words' own numbers: ascending keys (position * (most + 1) + distance back to `at`), and salts."""
    marks = b.column("marks")
    off = np.asarray(marks.offsets)[lo : lo + len(first)]
    digest, pos, at, n = (marks.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64)[off[0] : off[-1]] for k in range(4))
    text = np.repeat(np.arange(len(first) - 1), np.diff(off))
    good = digest == digests.view(np.int64)[text]  # rows that share a doc_id have other texts
    key = ((first[text] + pos) * (most + 1) + pos - at)[good]
    order = np.argsort(key, kind="stable")
    return key[order], n[good][order]


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted key, 0 where it isn't one; keys ascend."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def place(p: np.ndarray, s: np.ndarray, gram: int, length: int, window: int) -> np.ndarray:
    """Where the part of `length` words of the window from s on begins: around the anchor p, within the window; a longer part holds every shorter one."""
    return np.clip(p - (length - gram) // 2, s, s + window - length)


def windows(texts: DataFrame, marks: DataFrame, gram: int, before: int, length: int, window: int) -> DataFrame:
    """(h, doc_id, digest, pos, salts, at, w): for each marked anchor where its windows' parts of `length` words begin, and their hashes.

    marks(doc_id, marks array<struct<digest, pos, at, salts>>): anchors, and the beginnings of the parts
    of `before` words that were repeated; a window whose part isn't among them is given up.
    """

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            for lo, hashes, first, (digests, _) in texts_of(b):
                p, s, e, text, h = anchors_of(hashes, first, gram, window)
                keys, n = own_marks(b, lo, first, digests, window)
                marked = np.isin(p, keys // (window + 1))
                p, s, e, text, h = (x[marked] for x in (p, s, e, text, h))
                count = e - s + 1
                row = np.repeat(np.arange(len(p)), count)
                start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + s[row]
                salts = looked_up(keys, n, p[row] * (window + 1) + p[row] - place(p[row], start, gram, before, window))
                row, start, salts = row[salts > 0], start[salts > 0], salts[salts > 0]
                at = place(p[row], start, gram, length, window)
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1])
                row, at, salts = row[new], at[new], salts[new]
                full = gram_hashes(hashes, length, WINDOW_KEY ^ length)[at].view(np.int64)
                some, begin = np.unique(row, return_index=True)
                off = pa.array(np.append(begin, len(row)).astype(np.int32))
                t = text[some]
                yield pa.RecordBatch.from_arrays([signed(h[some]), pa.array(ids[lo + t]), signed(digests[t]), pa.array((p[some] - first[t]).astype(np.int32)), pa.array(salts[begin].astype(np.int32)), pa.ListArray.from_arrays(off, pa.array((at - first[text[row]]).astype(np.int32))), pa.ListArray.from_arrays(off, pa.array(full))], ["h", "doc_id", "digest", "pos", "salts", "at", "w"])

    rows = texts.join(marks.hint("merge"), "doc_id").select("doc_id", "text", "marks")
    return rows.mapInArrow(extend, "h long, doc_id long, digest long, pos int, salts int, at array<int>, w array<long>")


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, weight: Callable[[pa.RecordBatch], int]) -> Iterator[pa.Table]:
    """Batches sorted by `key` as tables of whole groups, several small ones together up to a weight of AT_ONCE."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        h = b.column(key).to_numpy()
        if held and size > AT_ONCE:
            # what ends before the last group of this batch is whole
            cut = int(np.searchsorted(h != held[-1].column(key)[-1].as_py(), True))
            if cut < len(h):
                yield pa.Table.from_batches([*held, b.slice(0, cut)])
                held, size, b = [], 0, b.slice(cut)
        held.append(b)
        size += weight(b)
    if held:
        yield pa.Table.from_batches(held)


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy().astype(np.int64)


def _flat(t: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy() for c in t.column(name).chunks]).astype(np.int64)


def extremes(keys: tuple[np.ndarray, ...], *values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row the smallest and the largest of each of the values among the rows with the same keys."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    begin, group = np.flatnonzero(new), np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return [(np.minimum.reduceat(v[order], begin)[group], np.maximum.reduceat(v[order], begin)[group]) for v in values]


REPEATED, RUNS = "doc_id long, digest long, pos int, at int, salts int", "doc_id long, digest long, s int, e int, source long"


def _arrays(schema: str, values: list[np.ndarray]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)).cast(kinds[t]) for v, (_, t) in zip(values, fields)], [n for n, _ in fields])


def runs_of(doc: np.ndarray, digest: np.ndarray, row: np.ndarray, at: np.ndarray, source: np.ndarray) -> pa.RecordBatch:
    """Starts `at` of windows as runs s..e of consecutive ones of one row and source; rows in order."""
    cut = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(at, prepend=-9) != 1) | (np.diff(source, prepend=source[:1]) != 0))
    end = np.append(cut[1:], len(row)) - 1
    return _arrays(RUNS, [doc[row[cut]], digest[row[cut]], at[cut], at[end], source[cut]])


def _read(t: pa.Table) -> tuple[np.ndarray, ...]:
    """Of windows() as a table: each window's row, anchor, hash and beginning; each row's doc_id and digest."""
    n = np.concatenate([np.diff(np.asarray(c.offsets)) for c in t.column("w").chunks])
    row = np.repeat(np.arange(len(n)), n)
    return row, _column(t, "h")[row], _flat(t, "w"), _flat(t, "at"), _column(t, "doc_id"), _column(t, "digest")


def windows_in(b: pa.RecordBatch) -> int:
    return len(b.column("w").flatten())


NONE = np.iinfo(np.int64).max
FOLDED = "h long, w long, grp long, low long, high long, source long"


def _known(rows: DataFrame) -> DataFrame:
    """Of rows dealt by grp, what is known of each window that several texts have, as one more row for each grp it stands in: pos -1, doc_id the smallest.

    The windows of a grp are folded, a row for each different one, and those of all grps meet by their hashes.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "grp", windows_in):
            row, h, w, _, doc, digest = _read(t)
            grp = _column(t, "grp")[row]
            (low, high), (source, _) = extremes((grp, h, w), digest[row], doc[row])
            order = np.lexsort((w, h, grp))
            o = (grp[order], h[order], w[order])
            new = order[np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in o]))] if len(order) else order
            yield _arrays(FOLDED, [x[new] for x in (h, w, grp, low, high, source)])

    of_all = Window.partitionBy("h", "w")
    known = rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(fold, FOLDED)
    known = known.select("h", "w", "grp", F.min("low").over(of_all).alias("low"), F.max("high").over(of_all).alias("high"), F.min("source").over(of_all).alias("source")).where("low < high")
    zero = F.lit(0)
    return known.select("h", F.col("source").alias("doc_id"), zero.cast("long").alias("digest"), F.lit(-1).alias("pos"), zero.alias("salts"), F.array(zero).alias("at"), F.array("w").alias("w"), "grp")


def by_group(rows: DataFrame) -> DataFrame:
    """windows() with grp, by which they are compared: that of one anchor, or of a part of an anchor with many rows, by salts of their
    doc_ids; and for each part what is known of its windows."""
    rows = rows.withColumn("grp", F.xxhash64("h", F.pmod(F.xxhash64("doc_id"), F.col("salts"))))
    return rows.unionByName(_known(rows.where("salts > 1")), allowMissingColumns=True)


def compared(t: pa.Table, last: bool) -> pa.RecordBatch | None:
    """repeated() of whole groups of by_group()."""
    row, h, w, at, doc, digest = _read(t)
    keys, pos, n = (_column(t, "grp")[row], h, w), _column(t, "pos"), _column(t, "salts")
    told, alone = pos[row] < 0, n[row] == 1
    (low, high), (source, _), (known, _) = extremes(keys, digest[row], doc[row], np.where(told, doc[row], NONE))
    source = np.where(alone, source, known)
    hit = np.flatnonzero(~told & ((source < doc[row]) if last else np.where(alone, low < high, source < NONE)))
    if not len(hit):
        return None
    r = row[hit]
    return runs_of(doc, digest, r, at[hit], source[hit]) if last else _arrays(REPEATED, [doc[r], digest[r], pos[r], at[hit], n[r]])


def repeated(rows: DataFrame, last: bool) -> DataFrame:
    """Of windows(): the parts that stand in another text too, (doc_id, digest, pos, at, salts); of the last length (doc_id, digest, s, e, source),
    runs of window starts s..e that stand in the smaller doc_id `source` too."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from filter(None, (compared(t, last) for t in whole_groups(batches, "grp", windows_in)))

    return by_group(rows).repartition("grp").sortWithinPartitions("grp").mapInArrow(compare, RUNS if last else REPEATED)


def by_document(marks: DataFrame) -> DataFrame:
    """marks of windows() from rows of doc_id, digest, pos, at, salts."""
    return marks.groupBy("doc_id").agg(F.collect_set(F.struct("digest", "pos", "at", "salts")).alias("marks"))


def copies(level: DataFrame) -> DataFrame:
    """(doc_id, digest, first): texts of anchors() whose whole word sequence stands in a smaller doc_id, `first`; both halves of their digests are equal."""
    heads = level.where("check is not null").select("doc_id", "digest", "check")
    few = Window.partitionBy("digest", "check")
    salted = heads.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int"))
    folded = salted.groupBy("digest", "check", "salt").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    known = folded.select("digest", "check", "salt", F.min("first").over(few).alias("first"), F.sum("n").over(few).alias("n")).where("n > 1").drop("n")
    return salted.join(known.hint("merge"), ["digest", "check", "salt"]).where("first < doc_id").select("doc_id", "digest", "first")


ALL = 2**31 - 2**16


def whole(found: DataFrame) -> DataFrame:
    """copies() as runs of window starts that cover the whole text."""
    return found.select("doc_id", "digest", F.lit(0).alias("s"), F.lit(ALL).alias("e"), F.col("first").alias("source"))


def covered(spans: list[tuple[int, int]], window: int, n: int) -> list[tuple[int, int]]:
    """Word ranges [from, to) of a text of n words covered by windows that start in the given runs."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], min(n, e + window)))
        else:
            out.append((s, min(n, e + window)))
    return out
