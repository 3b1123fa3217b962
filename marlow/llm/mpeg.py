"""MPEG audio as a media column: writing, resynchronising, tags, rate tables, checksums, durations, seeks.

Layout written here: an ID3v2.3 tag, an information frame with the "Xing" table (frames, bytes, 100
seek entries), then MPEG-2 Layer III frames at 144 kbit/s, 16 kHz, mono, with a checksum: 648 bytes
and 576 samples each. The side information says that a frame has no main data, so a player plays
silence; the first 576 bytes behind it are ancillary data and hold one payload unit.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marlow.llm._io import small_batches

UNIT = 576

# Fixed values of ISO 11172-3 and 13818-3: bit rates (kbit/s), sampling rates (Hz) and the checksum's polynomial.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
CRC16_POLYNOMIAL = 0x8005


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        out = ((out << 1) ^ np.where(out & 0x8000, CRC16_POLYNOMIAL, 0)) & 0xFFFF
    return out


_CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """Of each row of bytes, starting from 0xFFFF."""
    crc = np.full(len(rows), 0xFFFF, np.uint32)
    for column in rows.T:
        crc = ((crc << 8) & 0xFFFF) ^ _CRC[(crc >> 8) ^ column]
    return crc


def frame(head: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of rows of four header bytes: length (0: no valid header), samples, rate, side information bytes, layer, protected."""
    h = head.astype(np.int64)
    version, layer = h[:, 1] >> 3 & 3, 4 - (h[:, 1] >> 1 & 3)
    rate_at, bit_at, padding = h[:, 2] >> 2 & 3, h[:, 2] >> 4, h[:, 2] >> 1 & 1
    good = (h[:, 0] == 255) & (h[:, 1] >= 0xE0) & (version != 1) & (layer != 4) & (rate_at != 3) & (bit_at != 15) & (bit_at != 0) & (h[:, 3] & 3 != 2)
    rates, bits = np.zeros((4, 4), np.int64), np.zeros((2, 5, 16), np.int64)
    for v, x in RATES.items():
        rates[v, :3] = x
    for (v, k), x in BITRATES.items():
        bits[v - 1, k, :15] = x
    rate, bit = rates[version, rate_at], bits[(version != 3).astype(int), layer, bit_at] * 1000
    samples = np.select([layer == 1, (layer == 3) & (version != 3)], [384, 576], 1152)
    safe = np.maximum(rate, 1)
    length = np.where(layer == 1, (12 * bit // safe + padding) * 4, samples // 8 * bit // safe + padding)
    mono = h[:, 3] >> 6 == 3
    side = np.where(layer == 3, np.where(version == 3, np.where(mono, 17, 32), np.where(mono, 9, 17)), 0)
    return np.where(good, length, 0), samples, rate, side, layer, (h[:, 1] & 1) == 0


HEAD = np.array([0xFF, 0xF2, 0xD8, 0xC0], np.uint8)  # MPEG-2, Layer III, checksum; 144 kbit/s, 16 kHz; mono
LENGTH, SAMPLES, RATE, SIDE = (int(x[0]) for x in frame(HEAD[None])[:4])
BODY = 4 + 2 + SIDE


def _blank(n: int) -> np.ndarray:
    out = np.zeros((n, LENGTH), np.uint8)
    out[:, :4] = HEAD
    out[:, 4:6] = np.array(divmod(int(crc16(np.concatenate([HEAD[2:], np.zeros(SIDE, np.uint8)])[None])[0]), 256), np.uint8)
    return out


def pad(raw: bytes) -> bytes:
    """raw with bytes 255 up to a positive multiple of the unit."""
    n = max(1, -(-len(raw) // UNIT)) * UNIT
    return raw + b"\xff" * (n - len(raw))


def write(payload: bytes) -> bytes:
    """The file for a payload of whole units."""
    frames = _blank(len(payload) // UNIT + 1)
    frames[1:, BODY : BODY + UNIT] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    n = len(frames) - 1
    size = len(frames) * LENGTH
    toc = bytes(min(255, (k * n // 100 + 1) * LENGTH * 256 // size) for k in range(100))
    info = b"Xing" + struct.pack(">III", 7, n, size) + toc
    frames[0, BODY : BODY + len(info)] = np.frombuffer(info, np.uint8)
    text = b"\x00" + f"{n} units".encode()
    tag = b"TSSE" + struct.pack(">IH", len(text), 0) + text
    return b"ID3\x03\x00\x00" + bytes(len(tag) >> s & 127 for s in (21, 14, 7, 0)) + tag + frames.tobytes()


def _skip_tags(data: bytes) -> tuple[int, int, list[str]]:
    """Where the audio begins and ends, and the tag frames found around it."""
    at, end, names = 0, len(data), []
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        size = sum((data[at + 6 + i] & 127) << s for i, s in enumerate((21, 14, 7, 0)))
        p, stop = at + 10, min(end, at + 10 + size)
        while p + 10 <= stop and data[p : p + 4].isalnum():
            names.append(data[p : p + 4].decode("latin-1"))
            p += 10 + struct.unpack(">I", data[p + 4 : p + 8])[0]
        at = stop + (10 if data[at + 5] & 16 else 0)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        names.append("ID3v1")
        end -= 128
    return min(at, end), end, names


def _chain(data: np.ndarray, at: int, end: int) -> list[int]:
    """Frame starts from `at` on; after damage the next place where two headers of one kind follow each other."""
    out: list[np.ndarray] = []
    while at + 4 <= end:
        n = int(frame(data[at : at + 4][None])[0][0])
        if n and at + n <= end:
            # frames of equal length that follow are taken at once
            k = (end - at) // n
            heads = np.lib.stride_tricks.as_strided(data[at:], (k, 4), (n, 1))
            same = (heads[:, :2] == heads[0, :2]).all(1) & ((heads[:, 2] & 0xFE) == (heads[0, 2] & 0xFE))
            run = k if same.all() else int(np.argmin(same))
            out.append(at + n * np.arange(run))
            at += n * run
            continue
        step = 1 << 16
        while at + 4 <= end:
            part = data[at + 1 : min(end, at + 1 + step)]
            near = at + 1 + np.flatnonzero((part[:-1] == 255) & (part[1:] >= 0xE0))
            near = near[near + 4 <= end]
            sizes = frame(data[near[:, None] + np.arange(4)])[0] if len(near) else near
            near, sizes = near[sizes > 0], sizes[sizes > 0]
            ok = near + sizes + 4 <= end
            after = np.where(ok, near + sizes, 0)
            ok &= (data[after] == 255) & ((data[after + 1] if len(after) else after) == data[near + 1]) if len(near) else ok
            ok |= near + sizes == end
            if ok.any():
                at = int(near[ok][0])
                break
            at += max(1, len(part) - 1)
        else:
            break
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _number(data: bytes, at: int, n: int = 4) -> int | None:
    """A big-endian number, None where the bytes end before it does."""
    return int.from_bytes(data[at : at + n], "big") if at + n <= len(data) else None


def rate_table(data: bytes, start: int, body: int, stop: int) -> dict | None:
    """The variable-bitrate table in the frame start..stop: kind, frames, bytes and seek points (byte offsets from the frame on); None if there is none.

    Xing or Info stands behind the side information: flags say which of frames, bytes and 100 seek
    entries (in 256ths of the bytes) follow. VBRI stands at 36: bytes, frames, then the sizes of equally
    many frames each. What the frame is too short for is None or left out.
    """
    part = data[:stop]
    kind = part[body : body + 4]
    if kind in (b"Xing", b"Info"):
        flags, at, out = _number(part, body + 4) or 0, body + 8, {"kind": kind.decode(), "frames": None, "bytes": None, "points": []}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], at = _number(part, at), at + 4
        if flags & 4 and at + 100 <= len(part) and out["bytes"] is not None:
            out["points"] = [x * out["bytes"] // 256 for x in part[at : at + 100]]
        return out
    at = start + 36
    if part[at : at + 4] != b"VBRI":
        return None
    out = {"kind": "VBRI", "frames": _number(part, at + 14), "bytes": _number(part, at + 10), "points": []}
    count, scale, width = (_number(part, at + k, 2) or 0 for k in (18, 20, 22))
    total = 0
    for k in range(count if 0 < width <= 4 else 0):
        size = _number(part, at + 26 + k * width, width)
        if size is None:
            break
        total += size * scale
        out["points"].append(total)
    return out


def probe(data: bytes) -> dict:
    """Facts of an MPEG audio file; of bytes without any frame, zeros. Any bytes will do: what a cut file lacks is left out.

    samples and rate give the exact duration; seeks are byte offsets of every frame that holds audio.
    """
    begin, end, tags = _skip_tags(data)
    raw = np.frombuffer(data, np.uint8)
    starts = _chain(raw, begin, end)
    if tags[-1:] == ["ID3v1"]:
        # bytes "TAG" inside a frame that ends with the file are that frame's
        whole = _chain(raw, begin, len(data))
        if len(whole) and whole[-1] < end and whole[-1] + int(frame(raw[whole[-1] : whole[-1] + 4][None])[0][0]) == len(data):
            starts, end, tags = whole, len(data), tags[:-1]
    out = {"tags": tags, "frames": 0, "samples": 0, "rate": 0, "checked": 0, "damaged": 0, "table_kind": None, "table_frames": None, "table_bytes": None, "table_points": [], "skipped": int(end - begin), "seeks": np.zeros(0, np.int64), "body": np.zeros(0, np.int64)}
    if not len(starts):
        return out
    heads = raw[starts[:, None] + np.arange(4)]
    length, samples, rate, side, layer, protected = frame(heads)
    body = starts + 4 + 2 * protected + side
    table = rate_table(data, int(starts[0]), int(body[0]), int(starts[0] + length[0]))
    audio = np.ones(len(starts), bool)
    audio[0] = table is None
    table = table or {"kind": None, "frames": None, "bytes": None, "points": []}
    bad = checked = 0
    guard = np.flatnonzero(protected & (layer == 3) & (body <= starts + length))
    for n in np.unique(side[guard]):
        own = starts[guard[side[guard] == n]]
        kept = raw[own + 4].astype(np.uint32) << 8 | raw[own + 5]
        bad += int((crc16(raw[own[:, None] + np.concatenate([[2, 3], np.arange(6, 6 + n)])]) != kept).sum())
        checked += len(own)
    return out | {
        "frames": int(audio.sum()), "samples": int(samples[audio].sum()), "rate": int(rate[0]), "checked": checked, "damaged": bad, "table_kind": table["kind"], "table_frames": table["frames"],
        "table_bytes": table["bytes"], "table_points": table["points"], "skipped": int(end - begin - length.sum()), "seeks": starts[audio], "body": body[audio],
    }


def read(data: bytes, facts: dict | None = None) -> bytes:
    """The payload units that write() stored."""
    body = (facts or probe(data))["body"]
    body = body[body + UNIT <= len(data)]
    return np.frombuffer(data, np.uint8)[body[:, None] + np.arange(UNIT)].tobytes() if len(body) else b""


def feature(facts: dict) -> str:
    """Values of a file as one line: exact duration in samples at a rate, frames, checksums, table, tags, seek offsets' checksum."""
    seeks = zlib.crc32(facts["seeks"].astype("<i8").tobytes())
    return f"samples={facts['samples']}/{facts['rate']};frames={facts['frames']};table={facts['table_frames']};crc={facts['checked']}-{facts['damaged']};points={len(facts['table_points'])};bytes={facts['table_bytes']};skipped={facts['skipped']};tags={'+'.join(facts['tags'])};seeks={seeks:08x}"


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a file; a null text is empty."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(t or "").encode() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, raw), pa.int64()), pa.array((write(pad(x)) for x in raw), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, media binary")


FACTS = "tags array<string>, frames long, samples long, rate int, duration_s double, checked long, damaged long, table_kind string, table_frames long, table_bytes long, table_points array<long>, skipped long, seeks array<long>"


def probe_column(files: DataFrame, column: str = "media", key: str = "doc_id") -> DataFrame:
    """key and the facts of each file in a binary column; null, empty and foreign bytes have no frames."""
    small_batches(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [probe(m or b"") for m in b.column(1).to_pylist()]
            take = lambda k, t: pa.array([f[k] for f in x], t)
            seconds = pa.array([f["samples"] / f["rate"] if f["rate"] else 0.0 for f in x], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), take("tags", pa.list_(pa.string())), *[take(k, pa.int64()) for k in ("frames", "samples")], take("rate", pa.int32()), seconds, *[take(k, pa.int64()) for k in ("checked", "damaged")], take("table_kind", pa.string()), *[take(k, pa.int64()) for k in ("table_frames", "table_bytes")], take("table_points", pa.list_(pa.int64())), take("skipped", pa.int64()), take("seeks", pa.list_(pa.int64()))], ["key", *[f.split()[0] for f in FACTS.split(", ")]])

    return files.select(key, column).mapInArrow(run, f"`{key}` {dict(files.dtypes)[key]}, {FACTS}")


def digests(docs: DataFrame) -> DataFrame:
    """Each text stored as a file, the file's bytes read back and probed, in one pass so that files are not shuffled."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1):
                raw = (t.as_py() or "").encode()
                media = write(pad(raw))
                facts = probe(media)
                back = read(media, facts)
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(facts)))
            columns = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
