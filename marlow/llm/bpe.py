"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string the encoding of that prefix ends in one token, and that token
alone is stored: `last[i]` is the only token t that ends at i and may follow last[i - len(t)],
that is, the pair of both encodes to itself. Walking back over `last` gives the encoding of any
prefix. Appending bytes only adds entries; an edit recomputes entries until they agree with the
old ones for as long as the longest token reaches back.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from marlow.llm._io import small_batches
from marlow.llm._words import pieces as parts
from marlow.llm._words import utf8, word_hashes

CACHE_PIECES, CACHE_BYTES = 300_000, 1 << 25
KNOWN_PAIRS = 1_000_000
LONG_PIECE = 256


class Vocabulary:
    """Token ranks with, for each token, the two tokens it is merged from."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self._valid: dict[int, bool] = {}
        # all endings of tokens, -1 for those that are none themselves: a walk back over bytes stops where none is left
        self.endings = {t[-k:]: -1 for t in self.ranks for k in range(1, len(t))}
        self.endings.update(self.ranks)
        self.parts: dict[int, tuple[int, int]] = {}
        for t, rank in self.ranks.items():
            if len(t) > 1:
                self.parts[rank] = self._halves(t, rank)

    def _halves(self, token: bytes, rank: int) -> tuple[int, int]:
        """The pair whose merge makes the token: merge by rank as long as ranks stay under its own."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            pairs = [(self.ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1)]
            low, i = min(pairs)
            if low >= rank:
                raise ValueError(f"token {rank} is not made of two others")
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def follows(self, left: int, right: int) -> bool:
        """Whether left and right, side by side, encode to themselves.

        Looked at from the border: undo the later of the two merges beside it, again and again.
        If a pair met on the way would have been merged before one of its tokens was finished,
        the border would not exist.
        """
        key = left << 32 | right
        known = self._valid.get(key)
        if known is None:
            if len(self._valid) >= KNOWN_PAIRS:
                self._valid.clear()
            known = self._valid[key] = self._follows(left, right)
        return known

    def _follows(self, left: int, right: int) -> bool:
        ranks, of, parts = self.ranks, self.bytes_of, self.parts
        bound = len(ranks) + 1  # merges of this rank and later come after the border was settled
        while True:
            joined = ranks.get(of[left] + of[right])
            if joined is not None and joined < bound:
                return False
            if left > right:
                if left not in parts:
                    return True
                bound, left = left, parts[left][1]
            else:
                if right not in parts:
                    return True
                # on equal ranks the left merge is done first, so the right one may still be overtaken
                bound, right = right + 1, parts[right][0]


class PrefixTable:
    """last[i]: the last token of the encoding of the first i + 1 bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _token_at(self, end: int) -> int:
        endings, data, last, valid, follows = self.v.endings, self.data, self.last, self.v._valid, self.v.follows
        for k in range(end - 1, -1, -1):
            t = endings.get(data[k:end])
            if t is None:
                break
            if t >= 0 and (not k or ((known := valid.get(last[k - 1] << 32 | t)) is None and follows(last[k - 1], t)) or known):
                return t
        raise ValueError("bytes that the vocabulary cannot encode")

    def append(self, more: bytes) -> None:
        at = len(self.data)
        self.data += more
        for end in range(at + 1, len(self.data) + 1):
            self.last.append(self._token_at(end))

    def become(self, data: bytes) -> None:
        """Another string: entries of the common prefix stay, the rest is appended."""
        old, n = self.data, min(len(self.data), len(data))
        at = 0
        while at < n and old[at] == data[at]:
            at += 1
        del self.last[at:]
        self.data = data[:at]
        self.append(data[at:])

    def splice(self, start: int, stop: int, new: bytes) -> int:
        """Replace bytes start..stop; returns how many entries were computed anew."""
        old = self.last[stop:]
        tail = self.data[stop:]
        self.data, self.last = self.data[:start], self.last[:start]
        self.append(new)
        done, same = len(new), 0
        self.data += tail
        for k in range(len(tail)):
            self.last.append(self._token_at(start + len(new) + k + 1))
            done += 1
            same = same + 1 if self.last[-1] == old[k] else 0
            if same >= self.v.longest:
                self.last += old[k + 1 :]
                break
        return done

    def ids(self, end: int | None = None) -> list[int]:
        at, out = len(self.data) if end is None else end, []
        while at:
            out.append(self.last[at - 1])
            at -= len(self.v.bytes_of[out[-1]])
        return out[::-1]


class Encoder:
    """Pieces of a text by the tokenizer's pattern, each by its own prefix table; frequent pieces are kept."""

    def __init__(self, path: str, pattern: str):
        self.v = Vocabulary(path)
        self.pieces = regex.compile(pattern).findall
        self.kept: dict[str, tuple[int, ...]] = {}

    def piece(self, p: str) -> tuple[int, ...]:
        ids = tuple(PrefixTable(self.v, p.encode()).ids())
        if len(p) <= LONG_PIECE:
            if len(self.kept) >= CACHE_PIECES:
                self.kept.clear()
            self.kept[p] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        kept, piece, out = self.kept, self.piece, []
        for p in self.pieces(text):
            out += kept.get(p) or piece(p)
        return out

    def many(self, pieces: list[bytes]) -> list[list[int]]:
        """Encodings of pieces in ascending order: each table starts from its common prefix with the one before."""
        ranks, p, out = self.v.ranks, PrefixTable(self.v), []
        for b in pieces:
            t = ranks.get(b)
            if t is not None:
                out.append([t])
            else:
                p.become(b)
                out.append(p.ids())
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.v.bytes_of.__getitem__, ids))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One for each Python worker."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids: one row per input row, in any order; a null text is empty and has no ids. Other columns are not looked at."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            ids = [e.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, bytes for rows of doc_id, ids; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            out = [e.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, bytes binary")


# Byte classes of the splitter for texts of ASCII and common Latin characters; 0: left to the pattern itself.
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
_CLASS = np.zeros(256, np.int8)
_CLASS[:128] = OTHER
_CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
_CLASS[48:58] = NUMBER
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
# Second byte after C2: punctuation and signs; no-break space, C1 controls, letters and numbers there are not taken here.
_SIGNS = np.zeros(256, bool)
_SIGNS[0xA1:0xC0] = True
_SIGNS[[0xAA, 0xB2, 0xB3, 0xB5, 0xB9, 0xBA, 0xBC, 0xBD, 0xBE]] = False


def splits(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of UTF-8 texts start, by the classes of neighbouring bytes instead of a pattern; and which texts it holds for.

    It stands for the pattern of public_tokenizers: contractions, runs of letters, numbers or other
    signs with a space before, white space. Texts with characters beyond Latin letters and signs are
    not covered; their starts are to be ignored.
    """
    n = len(data)
    kind = np.append(_CLASS[data], np.int8(0))
    lead = np.flatnonzero(data >= 0xC2)
    lead = lead[lead < n - 1]
    a, b = data[lead], data[lead + 1]
    two = np.where(a == 0xC3, np.where((b == 0x97) | (b == 0xB7), OTHER, LETTER), np.where((a == 0xC4) | (a == 0xC5), LETTER, np.where((a == 0xC2) & _SIGNS[b], OTHER, 0))).astype(np.int8)
    kind[lead] = two
    kind[lead + 1] = np.where(two > 0, two, kind[lead + 1])
    begin = np.zeros(n + 1, bool)
    begin[offsets] = True
    run = begin.copy()
    run[1:n] |= kind[1:n] != kind[: n - 1]
    cut = run.copy()
    # the last white space before a run: a blank joins it, any other stands alone, and those before it are a piece
    last = np.flatnonzero((kind[: n - 1] == SPACE) & (kind[1:n] != SPACE) & ~begin[1:n])
    cut[last] = True
    cut[last[data[last] == 32] + 1] = False
    # contractions: a single apostrophe that no blank has joined, then one of the endings
    q = np.flatnonzero((data == 39) & run[:n])
    q = q[(q + 1 < n)]
    q = q[(kind[q + 1] == LETTER) & ~begin[q + 1] & cut[q]]
    pad = np.append(data, np.zeros(3, np.uint8))
    x, y = pad[q + 1], pad[q + 2]
    y = np.where(begin[np.minimum(q + 2, n)], 0, y)
    one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
    two_ = ((x == 114) & (y == 101)) | ((x == 118) & (y == 101)) | ((x == 108) & (y == 108))
    for hit, size in ((one, 2), (two_, 3)):
        at = q[hit]
        cut[at + 1] = False
        after = at + size
        after = after[after < n]
        cut[after] |= True
    good = np.diff(offsets) == 0
    bad = np.concatenate([[0], np.cumsum(kind[:n] == 0)])
    good |= bad[offsets[1:]] == bad[offsets[:-1]]
    return np.flatnonzero(cut[:n]), good


def unlike(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which pieces have other bytes than the piece that stands for them."""
    n = ends - starts
    same = n == n[other]
    row = np.flatnonzero(same)
    edge = np.cumsum(n[row]) - n[row]
    step = np.arange(int(n[row].sum())) - np.repeat(edge, n[row])
    off = data[np.repeat(starts[row], n[row]) + step] != data[np.repeat(starts[other[row]], n[row]) + step]
    if len(row):
        same[row] = ~np.logical_or.reduceat(off, edge)
    return np.flatnonzero(~same)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, then decode the ids, without moving the ids between processes.

    Pieces of many texts are grouped by a hash, then compared byte by byte; each different one is encoded
    and its ids decoded once for a part of the texts, or as long as it is kept. A text with a piece that
    only shares its hash with another is encoded by itself.
    """
    import hashlib

    import public_tokenizers

    small_batches(docs.sparkSession)
    by_class = pattern == public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        names, bytes_of = [str(i) for i in range(len(e.v.ranks))], e.v.bytes_of
        known: dict[bytes, tuple[bytes, bytes, int]] = {}
        sha = lambda b: hashlib.sha256(b).hexdigest()

        def line(ids: list[int]) -> tuple[bytes, bytes, int]:
            return " ".join([names[i] for i in ids]).encode(), b"".join([bytes_of[i] for i in ids]), len(ids)

        def by_pattern(text: str) -> tuple[int, str, str]:
            x = line(e.encode(text))
            return x[2], sha(x[0]), sha(x[1])

        for b in batches:
            rows: list[tuple[int, str, str]] = []
            data, offsets = utf8(b.column(1))
            for lo, hi in parts(np.diff(offsets)) if by_class else ():
                own, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, good = splits(own, at) if len(own) else (np.zeros(0, np.int64), np.ones(hi - lo, bool))
                ends = np.append(starts[1:], len(own))
                _, first, inverse = np.unique(word_hashes(own, starts, ends), return_index=True, return_inverse=True)
                if len(known) > CACHE_PIECES or sum(map(len, known)) > CACHE_BYTES:
                    known.clear()
                raw = own.tobytes()
                keys = [raw[a:z] for a, z in zip(starts[first].tolist(), ends[first].tolist())]
                good = good & ~np.isin(np.arange(hi - lo), np.searchsorted(at, starts[unlike(own, starts, ends, first[inverse])], "right") - 1)
                new = sorted(k for k in keys if k not in known)
                for key, ids in zip(new, e.many(new)):
                    known[key] = line(ids)
                texts_, back, size = zip(*[known[key] for key in keys]) if keys else ((), (), ())
                n = np.concatenate([[0], np.cumsum(np.array(size, np.int64)[inverse])]) if keys else np.zeros(1, np.int64)
                edge = np.searchsorted(starts, at)
                places = inverse.tolist()
                for k in range(hi - lo):
                    if good[k]:
                        p = places[edge[k] : edge[k + 1]]
                        rows.append((int(n[edge[k + 1]] - n[edge[k]]), sha(b" ".join(map(texts_.__getitem__, p))), sha(b"".join(map(back.__getitem__, p)))))
                    else:
                        rows.append(by_pattern(raw[at[k] : at[k + 1]].decode()))
            if not by_class:
                rows = [by_pattern(x or "") for x in b.column(1).to_pylist()]
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
