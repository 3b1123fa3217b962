"""Repeated passages by sparse suffix arrays.

Of all suffixes of the texts (each from a word on) only those at content-selected minimiser positions
are kept. Suffixes of equal first PREFIX words are a run; runs of one text alone are dropped. The
suffixes of a run are put in the order of the words on their right, and in that of the words on their
left read backwards; comparing neighbours in both orders gives how far each one's words go on being
those of others. Neighbours on the right alone would lose a pair whenever a suffix with other words on
the left sorts between its two, so every division of a passage of `least` words into a left and a right
part is looked at: suffixes that agree in both parts are one stretch of each order. What a smaller
doc_id has too is a repeat, and overlapping repeats extend to the longest passages. A run over
GROUP_ROWS suffixes isn't sorted in one task: its passages of `least` words are dealt by their hashes.
A passage repeated inside one document alone is not reported.

Defined cases: null, empty and shorter texts have no passages; rows with a null doc_id are neither
judged nor a source; rows that share a doc_id are judged each against smaller ids; of exact copies
all but the smallest doc_id are one passage, the whole text (if it has `least` words). Very long texts
are taken whole. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlow.llm._io import written
from marlow.llm._repeats import ALL, RUNS, WINDOW_KEY, anchors, anchors_of, by_document, by_group, compared, copies, extremes, looked_up, marked, own_marks, runs_of, shared, signed, texts_of, whole, whole_groups
from marlow.llm._words import gram_hashes
from marlow.llm.substring import remove_repeats, texts_by_id

LEAST, PREFIX = 50, 20


def _lists(values: np.ndarray, begin: np.ndarray, n: np.ndarray, step: int, none: np.ndarray, less: np.ndarray | None = None) -> pa.ListArray:
    """Of each row n values from begin on, forwards or backwards, each `less` so much; null where none."""
    off = np.append(0, np.cumsum(n))
    at = np.repeat(begin, n) + step * (np.arange(off[-1]) - np.repeat(off[:-1], n))
    flat = values[at].view(np.int64) - (0 if less is None else np.repeat(less, n))
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat), mask=pa.array(none))


def suffixes(texts: DataFrame, marks: DataFrame, prefix: int, least: int) -> DataFrame:
    """(h, doc_id, digest, pos, salts, fewest, left, right, at, w): the marked suffixes with the words around the prefix that their passages of `least` words can have.

    left: words before the suffix, the nearest first; right: words behind the prefix; fewest: words on
    the left that each of its passages has at least. A suffix of a crowded run (salts over 1) has where
    its passages begin and their hashes, at and w as windows() gives them, in place of left and right.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            for lo, hashes, first, (digests, _) in texts_of(b):
                p, s, e, text, h = anchors_of(hashes, first, prefix, least)
                keys, n = own_marks(b, lo, first, digests, least)
                salts = looked_up(keys // (least + 1), n, p)
                p, s, e, text, h, salts = (x[salts > 0] for x in (p, s, e, text, h, salts))
                crowded = salts > 1
                full = gram_hashes(hashes, least, WINDOW_KEY ^ least)
                none = np.zeros(len(p), np.int64)
                lists = [
                    _lists(hashes, p - 1, np.where(crowded, none, p - s), -1, crowded), _lists(hashes, p + prefix, np.where(crowded, none, e + least - prefix - p), 1, crowded),
                    _lists(np.arange(len(hashes)), s, np.where(crowded, e - s + 1, none), 1, ~crowded, first[text]), _lists(full, s, np.where(crowded, e - s + 1, none), 1, ~crowded),
                ]
                yield pa.RecordBatch.from_arrays([signed(h), pa.array(ids[lo + text]), signed(digests[text]), pa.array((p - first[text]).astype(np.int32)), pa.array(salts.astype(np.int32)), pa.array((p - e).astype(np.int32)), *lists], ["h", "doc_id", "digest", "pos", "salts", "fewest", "left", "right", "at", "w"])

    rows = texts.join(marks.hint("merge"), "doc_id").select("doc_id", "text", "marks")
    return rows.mapInArrow(cut, "h long, doc_id long, digest long, pos int, salts int, fewest int, left array<long>, right array<long>, at array<long>, w array<long>")


def common(run: np.ndarray, lists: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of rows by run and words, each one's place in it, and how many first words it shares with the one before it there (-1: another run)."""
    n = np.concatenate([np.diff(np.asarray(c.offsets)) for c in lists.chunks])
    flat = np.concatenate([c.flatten().to_numpy() for c in lists.chunks])
    words = np.full((len(n), width + 1), np.iinfo(np.int64).max)
    row = np.repeat(np.arange(len(n)), n)
    words[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = flat
    order = np.lexsort((*words.T[-2::-1], run))
    words, n, run = words[order], n[order], run[order]
    shared_ = np.full(len(n), -1)
    same = words[1:] == words[:-1]
    same[:, -1] = False
    shared_[1:] = np.where(run[1:] == run[:-1], np.minimum(same.argmin(1), np.minimum(n[1:], n[:-1])), -1)
    place = np.empty(len(n), np.int64)
    place[order] = np.arange(len(n))
    return order, place, shared_


def neighbours(t: pa.Table, width: int) -> pa.RecordBatch | None:
    """Runs of starts of passages that stand in a smaller doc_id too, of whole runs of suffixes()."""
    run, doc, digest, pos, fewest = (t.column(k).to_numpy().astype(np.int64) for k in ("h", "doc_id", "digest", "pos", "fewest"))
    most = np.concatenate([np.diff(np.asarray(c.offsets)) for c in t.column("left").chunks])
    sides = [common(run, t.column(k), width) for k in ("left", "right")]
    # the neighbour that shares most, before or behind
    best = [np.maximum(shared_, np.append(shared_[1:], -1))[place] for _, place, shared_ in sides]
    open_ = (best[0] + best[1] >= width) & (best[0] >= 0)
    found = []
    for j in range(width + 1):
        own = np.flatnonzero(open_ & (fewest <= j) & (j <= most) & (best[0] >= j) & (best[1] >= width - j))
        if not len(own):
            continue
        # stretches of suffixes that share j words on the left, and the others on the right
        stretch = [np.cumsum(shared_ < d)[place[own]] for (_, place, shared_), d in zip(sides, (j, width - j))]
        ((source, _),) = extremes((stretch[0], stretch[1]), doc[own])
        hit = source < doc[own]
        found.append((own[hit], pos[own[hit]] - j, source[hit]))
    row, at, source = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 3
    order = np.lexsort((at, row))
    return runs_of(doc, digest, row[order], at[order], source[order]) if len(row) else None


def passages_of_runs(rows: DataFrame, prefix: int, least: int) -> DataFrame:
    """(doc_id, digest, s, e, source) of suffixes(), a written table: runs are compared whole, crowded ones dealt out by their passages."""
    rows = by_group(rows)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "grp", lambda b: 16 * b.num_rows):
            small = pa.compute.is_valid(t.column("left"))
            for part, found in ((t.filter(small), lambda x: neighbours(x, least - prefix)), (t.filter(pa.compute.invert(small)), lambda x: compared(x, True))):
                out = found(part.combine_chunks()) if part.num_rows else None
                if out is not None:
                    yield out

    return rows.repartition("grp").sortWithinPartitions("grp", "h").mapInArrow(compare, RUNS)


def repeated_passages(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, digest, s, e, source): runs of starts of passages of `least` words that stand in a smaller doc_id, `source`. texts: as texts_by_id() gives them."""
    prefix = min(PREFIX, max(1, least - 1))
    level = written(anchors(texts, prefix, least), "suffixes")
    same = written(copies(level), "copies")
    runs = written(shared(level), "runs")
    marks = marked(level, runs).join(same.select("doc_id", "digest"), ["doc_id", "digest"], "left_anti")
    rows = written(suffixes(texts, by_document(marks), prefix, least), "runs")
    return whole(same).unionByName(passages_of_runs(rows, prefix, least))


def passages(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, start, end, sources, whole: word ranges [start, end) that repeat passages of the smaller doc_ids `sources`.

    One row per document and longest range that overlapping repeats cover; of a whole copy end is null.
    """
    runs = repeated_passages(texts_by_id(docs.select("doc_id", "text")), least).groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set(F.struct("s", "e", "source"))).alias("runs"))
    none = F.array().cast("array<struct<start:int,end:int,sources:array<bigint>>>")

    def join(done: Column, r: Column) -> Column:
        last, end = F.try_element_at(done, F.lit(-1)), r["e"] + least
        meets = (F.size(done) > 0) & (r["s"] <= last["end"])
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], end).alias("end"), F.array_union(last["sources"], F.array(r["source"])).alias("sources"))
        alone = F.struct(r["s"].alias("start"), end.alias("end"), F.array(r["source"]).alias("sources"))
        return F.when(meets, F.array_append(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), longer)).otherwise(F.array_append(done, alone))

    found = runs.select("doc_id", F.explode(F.aggregate("runs", none, join)).alias("p")).select("doc_id", "p.*")
    whole_ = F.col("end") > ALL
    return found.select("doc_id", F.col("start").cast("long").alias("start"), F.when(~whole_, F.col("end")).cast("long").alias("end"), "sources", whole_.alias("whole")).distinct()


def without_passages(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with repeated passages cut from text, the first document's words stay; documents that lose all their words go.

    n_chars, where there is one, follows the text.
    """
    extra = [c for c in docs.columns if c not in ("doc_id", "text")]
    plain = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(extra)])
    out = remove_repeats(plain, repeated_passages, least).where("n_removed = 0 or n_removed < n_words")
    lengths = [F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col(f"c_{i}")).cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else F.col(f"c_{i}").alias(c) for i, c in enumerate(extra)]
    named = {"doc_id": F.col("doc_id"), "text": F.col("text"), **dict(zip(extra, lengths))}
    return out.select(*[named[c] for c in docs.columns])
