"""Substring deduplication by level-wise doubling of word windows.

Level 1 looks at windows of about a quarter of the final length, one content-selected window for each
final one. Those that stand in two different texts alone go on to the next level, where they are
extended to twice the length, and so on; of what repeats at the final length every document but the
smallest doc_id loses its words. No level starts when no candidate survived the one before. Texts are
dealt by doc_id once and read again at each level. Texts are compared as whole word sequences.

Every row gets a result: null or empty texts have no words, texts shorter than the window lose
nothing, rows with a null doc_id are neither judged nor a source, rows that share a doc_id are
each judged against smaller ids only. A text of any length is taken whole, alone if it is long. Other
columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlow.llm._io import dealt, small_batches, written
from marlow.llm._repeats import anchors, by_document, copies, covered, marked, repeated, shared, whole, windows
from marlow.llm._words import text_digests, utf8, words

LEVELS = 3


def lengths(window: int, levels: int = LEVELS) -> list[int]:
    """Window lengths of the levels, each about twice the one before, the last one `window`."""
    out = [window]
    while len(out) < levels and out[0] > 1:
        out.insert(0, (out[0] + 1) // 2)
    return out


def texts_by_id(docs: DataFrame) -> DataFrame:
    """docs that have a doc_id, as long, dealt by it."""
    small_batches(docs.sparkSession)
    return dealt(docs.where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id", "texts")


def repeated_windows(texts: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, digest, s, e, source): runs of starts of windows that stand in a smaller doc_id too. texts: as texts_by_id() gives them."""
    gram, *longer = lengths(window)
    level = written(anchors(texts, gram, window), "level1")
    # exact copies alone do not make a window go on, they go as a whole
    same = written(copies(level), "copies")
    out = whole(same)
    marks = written(by_document(marked(level, written(shared(level), "repeated")).join(same.select("doc_id", "digest"), ["doc_id", "digest"], "left_anti")), "marks")
    for before, length in zip([gram, *longer], longer or [gram]):
        if marks.isEmpty():
            break
        rows = written(windows(texts, marks, gram, before, length, window), "windows")
        if length == window:
            out = out.unionByName(repeated(rows, True))
        else:
            marks = written(by_document(repeated(rows, False)), "marks")
    return out


def remove_repeats(docs: DataFrame, find: Callable[[DataFrame, int], DataFrame], window: int = 50) -> DataFrame:
    """docs with n_words, n_removed, kept (the words left, by one space) and, as `text`, the text without the removed words.

    find(texts, window) gives spans (doc_id, digest, s, e) as repeated_windows() does; the digest keeps
    rows that share a doc_id apart. Rows without a doc_id have no spans.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    inner = [f"_{i}" for i in range(len(rest))]
    plain = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(x) for c, x in zip(rest, inner)])
    texts = texts_by_id(plain)
    per = find(texts, window).groupBy("doc_id").agg(F.collect_set(F.struct("digest", "s", "e")).alias("spans"))
    rows = texts.join(per.hint("merge"), "doc_id", "left").unionByName(plain.where("doc_id is null").withColumn("doc_id", F.lit(None).cast("long")), allowMissingColumns=True)
    rows = rows.select("doc_id", "text", *inner, "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans_, texts = b.column("spans").to_pylist(), b.column("text")
            n_words, n_removed, kept, left = [], [], [], []
            for k, marks in enumerate(spans_):
                raw = (texts[k].as_py() or "").encode()
                gone: list[tuple[int, int]] = []
                if marks:
                    data, offsets = utf8(texts.slice(k, 1))
                    starts = words(data, offsets)[0]
                    digest = int(text_digests(data, offsets)[0].view("int64")[0])
                    gone = covered([(x["s"], x["e"]) for x in marks if x["digest"] == digest], window, len(starts))
                own = raw.split()
                n_words.append(len(own))
                n_removed.append(sum(t - f for f, t in gone))
                if gone:
                    at, parts, keep = 0, [], []
                    word = 0
                    for f, t in gone:
                        parts.append(raw[at : starts[f]])
                        keep += own[word:f]
                        word, at = t, int(starts[t]) if t < len(own) else len(raw)
                    parts.append(raw[at:])
                    keep += own[word:]
                    left.append(b"".join(parts).decode())
                    kept.append(b" ".join(keep).decode())
                else:
                    left.append(texts[k].as_py())
                    kept.append(b" ".join(own).decode())
            out = {c: b.column(c) for c in ["doc_id", *inner]}
            yield pa.RecordBatch.from_arrays([out["doc_id"], pa.array(left, pa.string()), *[out[c] for c in inner], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "text", *inner, "_n_words", "_n_removed", "_kept"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in ["doc_id", "text", *inner]) + ", _n_words long, _n_removed long, _kept string"
    out = rows.mapInArrow(cut, schema)
    return out.select(F.col("doc_id").cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"), "text", *[F.col(x).alias(c) for c, x in zip(rest, inner)], F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.col("_kept").alias("kept"))


def substring_dedup(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, text without repeats, n_words, n_removed, kept (words left, by one space): one row per input row."""
    return remove_repeats(docs.select("doc_id", "text"), repeated_windows, window)
