"""Words and word n-grams of a batch of texts as numpy arrays.

A word is a run of bytes outside 0x20 and 0x09-0x0D of the UTF-8 text. Its hash is the sum of random
values drawn for each pair of place and byte; n-grams are hashed by doubling, two halves mixed into
one, so no hash is a polynomial and no regular text makes it collide. Whole texts are told apart by
BLAKE2b over their words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
# Random values of the first PLACES places of a word; those of later places are mixed from place and byte.
PLACES = 64
_VALUES = np.random.default_rng(0x5EED).integers(0, 2**64, PLACES * 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(n_bytes: np.ndarray, most: int = 1 << 21):
    """Ranges of rows with about `most` bytes together; a longer text stands alone."""
    ends = np.cumsum(n_bytes)
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and for each text its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | cut[1:-1]
    last[:-1] &= ~solid[1:] | cut[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each word from starts to ends, which ascend and do not overlap; other bytes are not looked at."""
    out = np.zeros(len(starts), np.uint64)
    for at in range(0, len(data), _CHUNK):
        to = min(len(data), at + _CHUNK)
        # words that touch these bytes, cut to them
        lo, hi = int(np.searchsorted(ends, at, "right")), int(np.searchsorted(starts, to))
        if lo >= hi:
            continue
        a, z = np.maximum(starts[lo:hi], at), np.minimum(ends[lo:hi], to)
        n = z - a
        edge = np.cumsum(n) - n
        byte = np.repeat(a - edge, n) + np.arange(int(n.sum()))
        place = byte - np.repeat(starts[lo:hi], n)
        code = place * 256 + data[byte]
        value = _VALUES[np.minimum(code, PLACES * 256 - 1)]
        far = np.flatnonzero(place >= PLACES)
        if len(far):
            value[far] = mix(code[far].astype(np.uint64) * _ODD)
        out[lo:hi] += np.add.reduceat(value, edge)
    return mix(out + (ends - starts).astype(np.uint64) * _ODD)


def _pair(a: np.ndarray, b: np.ndarray, key: int) -> np.ndarray:
    """A hash of two hashes in order."""
    return mix(a + mix(b ^ np.uint64(key)))


def gram_hashes(hashes: np.ndarray, n: int, key: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """At each word the hash of the n words from it on, by doubling; shorter by n - 1 than the input."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out, have, power, size = None, 0, hashes, 1
    while True:
        if n & size:
            m = len(hashes) - have - size + 1
            out, have = (power if out is None else _pair(out[:m], power[have : have + m], key)), have + size
        if size * 2 > n:
            return out
        power, size = _pair(power[:-size], power[size:], key ^ size), size * 2


def text_digests(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of a 128-bit digest of each text's word sequence (0 for none)."""
    out = np.zeros((len(offsets) - 1, 2), np.uint64)
    raw, at = data.tobytes(), offsets.tolist()
    for k in range(len(out)):
        own = raw[at[k] : at[k + 1]].split()  # at the same bytes as words()
        if own:
            out[k] = np.frombuffer(hashlib.blake2b(b" ".join(own), digest_size=16).digest(), np.uint64)
    return out[:, 0], out[:, 1]


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each start the position of the leftmost smallest of `width` values from it on."""
    n = len(values) - width + 1
    if n < 1:
        return np.zeros(0, np.int64)
    best, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(values[b] < values[a], b, a)
        have += step
    return best[:n]
