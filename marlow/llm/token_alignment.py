"""Alignment of two tokenizers over the same bytes by elementary intervals.

Both tokenizers cut the bytes of space+text. The union of their token ends cuts them into elementary
intervals; each lies in one token of either side, found by searchsorted, and two tokens overlap in one
interval at most, so the intervals are the links. Ends that both sides share close groups, in which every
token of A may stand for every token of B: products() expands them.

A pair of ids counts the documents of the corpus that hold it linked. Texts are aligned once, in chunks of
about CHUNK_BYTES; a chunk is a row with the different pairs of its documents and, for each document, which
of them it holds and how often. Only the different pairs of a chunk are shuffled to be counted, and what
is known of them comes back to the chunk, by salts, so that no task gets a pair of every document. A row is
as large as its chunk, or its one document. The largest count of each id of A is a table of at most the size
of its vocabulary, which is broadcast.

Defined cases: texts that are null, empty, or whose tokens don't join to space+text (a literal U+2581, or
bytes that a tokenizer changes) have no tokens: zeros, and '' for the groups. Strings of special tokens are
ordinary text. Equal texts count as often as they occur, and so do rows that repeat a doc_id or have none,
each of which has a row of its own. No documents give no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlow.llm._graph import spread_join
from marlow.llm._io import drop, small_batches, written
from marlow.llm._words import pieces

CHUNK_BYTES = 1 << 21
# Characters beyond Latin letters, of which libraries may know different Unicode versions.
_BEYOND = re.compile("[^\x00-\u024f]").search
# How byte-level vocabularies split texts before merging, a fixed value of their format.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers with the bytes of their entries."""

    def __init__(self, path_a: str, path_b: str):
        # one task is one core
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        alphabet = _byte_alphabet()
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.latin = _by_rank(path_a, alphabet)
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for piece, i in self.a.get_vocab().items():
            if all(c in alphabet for c in piece):
                self.bytes_a[i] = bytes(alphabet[c] for c in piece)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.b.vocab_size()) for p in (self.b.id_to_piece(i),)]
        self.size_a, self.size_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        # names of ids with what follows them in groups: another of the same side, or the last one
        a, b = ([[f"{i},".encode(), f"{i}{end}".encode()] for i in range(n)] for n, end in ((len(self.bytes_a), "|"), (len(self.bytes_b), ";")))
        self.names = [n for side in (a, b) for pair in side for n in pair]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; none where either side's bytes aren't those of space+text."""
        whole = [k for k, t in enumerate(texts) if self.latin is None or _BEYOND(t)]
        a = [[] for _ in texts]
        for k, e in zip(whole, self.a.encode_batch_fast([" " + texts[k] for k in whole], add_special_tokens=False)):
            a[k] = e.ids
        for k in set(range(len(texts))).difference(whole):
            a[k] = self.latin.encode_ordinary(" " + texts[k])
        b = self.b.encode(texts, num_threads=1)
        for k, t in enumerate(texts):
            whole = b" " + t.encode()
            if not t or b"".join(map(self.bytes_a.__getitem__, a[k])) != whole or b"".join(map(self.bytes_b.__getitem__, b[k])) != whole:
                a[k] = b[k] = []
        return a, b


def _by_rank(path: str, alphabet: dict[str, int]):
    """The same tokenizer in a library that merges by rank, about three times as fast; None unless the file is plain byte-level BPE whose ids
    follow its merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    special = {t["content"] for t in spec.get("added_tokens", ())}
    made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model.get("merges", ())]
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not spec.get("normalizer") and not model.get("ignore_merges")
    ranks = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items() if t not in special and all(c in alphabet for c in t)}
    if not plain or any(x >= y for x, y in zip(made, made[1:])) or len(ranks) != len(made) + 256 or min(made, default=0) < max(ranks[bytes([b])] for b in range(256)):
        return None
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})


_made: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    """One for each Python worker."""
    if (path_a, path_b) not in _made:
        _made[path_a, path_b] = Tokenizers(path_a, path_b)
    return _made[path_a, path_b]


class Aligned(NamedTuple):
    """Of texts one after the other: ids of both sides, the token of either side in each link, for each group the tokens of either side up to
    its end, and for each text where its tokens, links and groups end."""

    a: np.ndarray
    b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    to_a: np.ndarray
    to_b: np.ndarray
    to_link: np.ndarray
    to_group: np.ndarray


def union(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """union1d of two ascending arrays: a stable sort merges them."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return both[np.append(True, both[1:] != both[:-1])] if len(both) else both


def aligned(a: list[list[int]], b: list[list[int]], size_a: np.ndarray, size_b: np.ndarray) -> Aligned:
    to_a, to_b = (np.cumsum([len(x) for x in side], dtype=np.int64) for side in (a, b))
    ids_a, ids_b = (np.fromiter(chain.from_iterable(side), np.int64, int(to[-1]) if len(to) else 0) for side, to in ((a, to_a), (b, to_b)))
    end_a, end_b = np.cumsum(size_a[ids_a]), np.cumsum(size_b[ids_b])
    ends = union(end_a, end_b)
    link_a, link_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
    shared = (end_a[link_a] == ends) & (end_b[link_b] == ends)
    text_end = np.append(0, end_a)[to_a]
    return Aligned(ids_a, ids_b, link_a, link_b, link_a[shared] + 1, link_b[shared] + 1, to_a, to_b, np.searchsorted(ends, text_end, "right"), np.searchsorted(ends[shared], text_end, "right"))


def products(x: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, token of A, token of B): every pair of tokens of each group."""
    n_a, n_b = np.diff(x.group_a, prepend=0), np.diff(x.group_b, prepend=0)
    size = n_a * n_b
    group = np.repeat(np.arange(len(size)), size)
    k = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)
    return group, (x.group_a - n_a)[group] + k // n_b[group], (x.group_b - n_b)[group] + k % n_b[group]


def group_lines(x: Aligned, names: list[bytes], first_b: int) -> list[bytes]:
    """a1,a2|b1;a3|b2,b3 of each text: names in the order of groups, A before B, whose names start at `first_b`."""
    order = np.zeros(len(x.a) + len(x.b), np.int64)
    last_a, last_b = np.zeros(len(x.a), np.int64), np.zeros(len(x.b), np.int64)
    last_a[x.group_a - 1] = last_b[x.group_b - 1] = 1
    before_b = np.append(0, x.group_b)[np.cumsum(last_a) - last_a]
    before_a = x.group_a[np.cumsum(last_b) - last_b] if len(x.b) else last_b
    order[np.arange(len(x.a)) + before_b] = 2 * x.a + last_a
    order[np.arange(len(x.b)) + before_a] = first_b + 2 * x.b + last_b
    ends = x.to_a + x.to_b
    return [b"".join(map(names.__getitem__, order[lo:hi].tolist()))[:-1] for lo, hi in zip(np.append(0, ends[:-1]), ends)]


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(values, kind))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, a, b (ids), links and groups: for each link the place of its tokens on either side, for each group the places after its last ones."""
    small_batches(docs.sparkSession)
    place = pa.struct([("a", pa.int32()), ("b", pa.int32())])

    def pairs(a: np.ndarray, b: np.ndarray, x: Aligned, ends: np.ndarray) -> pa.Array:
        text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        first_a, first_b = (np.append(0, to[:-1])[text] for to in (x.to_a, x.to_b))
        rows = pa.StructArray.from_arrays([pa.array((a - first_a).astype(np.int32)), pa.array((b - first_b).astype(np.int32))], fields=list(place))
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(path_a, path_b)
        for batch in batches:
            texts = [v or "" for v in batch.column(1).to_pylist()]
            for lo, hi in pieces(np.array([len(v) for v in texts]), CHUNK_BYTES):
                x = aligned(*t.encode(texts[lo:hi]), t.size_a, t.size_b)
                columns = [batch.column(0).slice(lo, hi - lo), _lists(x.a, x.to_a, pa.int32()), _lists(x.b, x.to_b, pa.int32()), pairs(x.link_a, x.link_b, x, x.to_link), pairs(x.group_a, x.group_b, x, x.to_group)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "a", "b", "links", "groups"])

    places = "array<struct<a: int, b: int>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, a array<int>, b array<int>, links {places}, groups {places}")


CHUNKS = (
    "chunk long, doc_id array<long>, n_a array<int>, n_b array<int>, n_groups array<int>, n_links array<int>, digest array<string>, "
    "size array<int>, entry array<int>, times array<int>, a array<int>, b array<int>, docs array<int>"
)
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _chunks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each chunk: its documents one after the other, its different pairs with the documents that hold them, and for each document its entries among these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, number = tokenizers(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = [v or "" for v in batch.column(1).to_pylist()]
            for lo, hi in pieces(np.array([len(v) for v in texts]), CHUNK_BYTES):
                x = aligned(*t.encode(texts[lo:hi]), t.size_a, t.size_b)
                text = np.repeat(np.arange(hi - lo), np.diff(x.to_link, prepend=0))
                keys, entry = np.unique(x.a[x.link_a] << 32 | x.b[x.link_b], return_inverse=True)
                held, times = np.unique(text * max(1, len(keys)) + entry, return_counts=True)
                text, entry = held // max(1, len(keys)), held % max(1, len(keys))
                digests = [hashlib.sha256(line).hexdigest() if line else "" for line in group_lines(x, t.names, 2 * len(t.bytes_a))]
                counts = (np.diff(e, prepend=0) for e in (x.to_a, x.to_b, x.to_group, x.to_link))
                of_docs = [batch.column(0).slice(lo, hi - lo), *counts, digests, np.bincount(text, minlength=hi - lo)]
                of_keys = [entry, times, keys >> 32, keys & 0xFFFFFFFF, np.bincount(entry, minlength=len(keys))]
                kinds = [pa.int64(), *[pa.int32()] * 4, pa.string(), *[pa.int32()] * 6]
                columns = [pa.ListArray.from_arrays([0, len(v)], v if isinstance(v, pa.Array) else pa.array(v, k)) for v, k in zip([*of_docs, *of_keys], kinds)]
                yield pa.RecordBatch.from_arrays([pa.array([number]), *columns], [f.split()[0] for f in CHUNKS.split(", ")])
                number += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, CHUNKS)


def _summed(chunks: DataFrame) -> DataFrame:
    """Documents from chunks with `told`: count and best of each of its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                get = {n: batch.column(n)[k].values for n in batch.schema.names if n != "chunk"}
                told = get["told"]
                order = np.argsort(told.field("pos").to_numpy()) if told is not None else np.zeros(0, np.int64)
                count, best = (told.field(n).to_numpy(zero_copy_only=False)[order] if told is not None else order for n in ("count", "best"))
                entry, times, ends = get["entry"].to_numpy(), get["times"].to_numpy().astype(np.int64), np.cumsum(get["size"].to_numpy())
                sums = []
                for v in (times * best[entry], times * count[entry]):
                    run_ = np.append(0, np.cumsum(v))[np.append(0, ends)]
                    sums.append(np.diff(run_))
                columns = [get["doc_id"], *(get[n].cast(pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")), *map(pa.array, sums), get["digest"]]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in RESULT.split(", ")])

    return chunks.mapInArrow(run, RESULT)


def digests(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per input row."""
    small_batches(docs.sparkSession)
    chunks = written(_chunks(docs, path_a, path_b), "chunks")
    pairs = chunks.select("chunk", F.posexplode(F.arrays_zip("a", "b", "docs")).alias("pos", "of")).select("chunk", "pos", F.shiftleft(F.col("of.a").cast("long"), 32).bitwiseOR(F.col("of.b").cast("long")).alias("pair"), "of.docs")
    counts = written(pairs.groupBy("pair").agg(F.sum("docs").alias("count")), "pairs")
    a = F.shiftright("pair", 32).alias("a")
    # one row for each id of A: its vocabulary bounds it
    most = counts.groupBy(a).agg(F.max("count").alias("most"))
    known = counts.withColumn("a", a).join(F.broadcast(most), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    told = spread_join(pairs.drop("docs"), known, "pair", "chunk").groupBy("chunk").agg(F.collect_list(F.struct("pos", "count", "best")).alias("told"))
    out = written(_summed(chunks.drop("a", "b", "docs").join(told.hint("merge"), "chunk", "left")), "aligned")
    for t in (chunks, counts):
        drop(t)
    return out
