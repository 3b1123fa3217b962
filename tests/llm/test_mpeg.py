import hashlib
import random
import struct
import zlib

from marlow.llm import mpeg, queries


def test_round_trip():
    r = random.Random(1)
    for n in (0, 1, 575, 576, 577, 5000, 200_000):
        for raw in (bytes(r.randrange(256) for _ in range(n)), b"\xff\xfb\x90\x64" * (n // 4), b"\xff" * n):
            payload = mpeg.pad(raw)
            media = mpeg.write(payload)
            f = mpeg.probe(media)
            assert mpeg.read(media, f) == payload and len(payload) % 576 == 0 and payload[: len(raw)] == raw
            assert f["frames"] == f["table_frames"] == len(payload) // 576 and f["samples"] == 576 * f["frames"] and f["rate"] == 16000
            assert f["damaged"] == 0 and f["checked"] == f["frames"] + 1 and f["skipped"] == 0 and f["tags"] == ["TSSE"]


def crc_by_bit(data):
    crc = 0xFFFF
    for byte in data:
        for k in range(7, -1, -1):
            top = crc >> 15 ^ byte >> k & 1
            crc = crc << 1 & 0xFFFF ^ (0x8005 if top else 0)
    return crc


def test_checksum_by_bit():
    media = mpeg.write(b"x" * 576)
    at = int(mpeg.probe(media)["seeks"][0])
    assert struct.unpack(">H", media[at + 4 : at + 6])[0] == crc_by_bit(media[at + 2 : at + 4] + media[at + 6 : at + 6 + mpeg.SIDE])


def test_headers():
    length, samples, rate, side, layer, guard = (int(x[0]) for x in mpeg.frame(mpeg.np.array([[0xFF, 0xFB, 0x90, 0x64]], mpeg.np.uint8)))
    assert (length, samples, rate, side, layer, guard) == (417, 1152, 44100, 32, 3, 0)
    assert int(mpeg.frame(mpeg.np.array([[0xFF, 0xFD, 0xC4, 0x00]], mpeg.np.uint8))[0][0]) == 144 * 256000 // 48000
    assert int(mpeg.frame(mpeg.np.array([[0xFF, 0xFF, 0xFF, 0xFF]], mpeg.np.uint8))[0][0]) == 0


def test_damage_and_junk():
    media = mpeg.write(mpeg.pad(b"hello " * 2000))
    f = mpeg.probe(media)
    at = f["seeks"]
    hurt = bytearray(media)
    hurt[at[3] + 8] ^= 1
    assert mpeg.probe(bytes(hurt))["damaged"] == 1
    cut = media[: at[5] + 100] + media[at[6] :]
    g = mpeg.probe(cut)
    assert g["frames"] >= f["frames"] - 2 and g["skipped"] > 0
    junk = media[: at[4]] + b"\xff\xe0junk\xff" * 30 + media[at[4] :] + b"TAG" + bytes(125)
    g = mpeg.probe(junk)
    assert g["frames"] == f["frames"] and g["skipped"] == 210 and g["tags"] == ["TSSE", "ID3v1"] and mpeg.read(junk, g) == mpeg.read(media)
    for raw in (b"", b"ID3", b"not audio at all", b"\xff" * 5000, b"ID3\x03\x00\x00\x7f\x7f\x7f\x7f"):
        assert mpeg.probe(raw)["frames"] == 0 and mpeg.read(raw) == b""


def test_tag_bytes_inside_the_last_frame():
    for units in (1, 2, 5):
        payload = mpeg.pad(b"x" * (576 * units - 71) + b"TAG" + b"y" * 68)
        media = mpeg.write(payload)
        assert media[-128:-125] == b"TAG"
        f = mpeg.probe(media)
        assert f["frames"] == units and f["skipped"] == 0 and f["tags"] == ["TSSE"] and mpeg.read(media, f) == payload
        g = mpeg.probe(media + b"TAG" + bytes(125))
        assert g["frames"] == units and g["skipped"] == 0 and g["tags"] == ["TSSE", "ID3v1"] and mpeg.read(media + b"TAG" + bytes(125), g) == payload


def tabled(kind):
    """A file whose first frame holds a table of the given kind: MPEG-1, 128 kbit/s, 44.1 kHz, stereo, then three frames of sound."""
    head, n = b"\xff\xfb\x90\x64", 417
    if kind == "VBRI":
        info = bytes(32) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 4 * n, 3, 3, 1, 2, 1) + struct.pack(">HHH", n, n, n)
    else:
        info = bytes(32) + kind.encode() + struct.pack(">III", 7, 3, 4 * n) + bytes(k * 256 // 100 for k in range(100))
    return b"".join(head + x.ljust(n - 4, b"\0") for x in (info, b"", b"", b""))


def test_rate_tables():
    f = mpeg.probe(tabled("Xing"))
    assert (f["table_kind"], f["table_frames"], f["table_bytes"], f["frames"], f["samples"]) == ("Xing", 3, 1668, 3, 3 * 1152) and f["table_points"] == [k * 256 // 100 * 1668 // 256 for k in range(100)]
    f = mpeg.probe(tabled("VBRI"))
    assert (f["table_kind"], f["table_frames"], f["table_bytes"], f["frames"], f["table_points"]) == ("VBRI", 3, 1668, 3, [417, 834, 1251])
    assert mpeg.probe(tabled("Info"))["table_kind"] == "Info" and mpeg.probe(mpeg.write(b"x" * 576))["table_bytes"] == 1296


def test_cut_and_broken_files_are_read_as_far_as_they_go():
    short = b"\xff\xf3\x14\xc0" + bytes(9)
    for raw in (short + b"Xing" + struct.pack(">I", 7) + b"\0\0\0", short + b"Xing", (b"\xff\xf3\x14\xc0" + bytes(32) + b"VBRI").ljust(48, b"\0")):
        for n in range(len(raw) + 1):
            mpeg.probe(raw[:n])
    assert mpeg.probe((short + b"Xing" + struct.pack(">I", 7)).ljust(24, b"\0")[:24])["table_frames"] is None
    r = random.Random(7)
    files = [tabled(k) for k in ("Xing", "VBRI", "Info")] + [mpeg.write(mpeg.pad(b"hello" * 300)) + b"TAG" + bytes(125)]
    for data in files:
        for n in range(0, len(data), 1 if len(data) < 1700 else 7):
            f = mpeg.probe(data[:n])
            assert f["frames"] * (f["rate"] > 0) == len(f["seeks"]) and mpeg.read(data[:n], f) is not None
        for _ in range(300):
            hurt = bytearray(data)
            for _ in range(r.choice([1, 3, 40])):
                hurt[r.randrange(len(hurt))] = r.choice([0, 255, 0xFB, r.randrange(256)])
            mpeg.feature(mpeg.probe(bytes(hurt)))


def plain_feature(media):
    """The feature of a file of write(), read frame by frame."""
    at = 10 + (media[8] << 7 | media[9])
    count = struct.unpack(">I", media[at + 4 + 2 + 9 + 8 : at + 4 + 2 + 9 + 12])[0]
    seeks = list(range(at + 648, len(media), 648))
    good = all(struct.unpack(">H", media[a + 4 : a + 6])[0] == crc_by_bit(media[a + 2 : a + 4] + media[a + 6 : a + 15]) for a in [at, *seeks])
    code = zlib.crc32(b"".join(struct.pack("<q", a) for a in seeks))
    return f"samples={576 * len(seeks)}/16000;frames={len(seeks)};table={count};crc={len(seeks) + 1}-{0 if good else 'x'};points=100;bytes={len(media) - at};skipped=0;tags=TSSE;seeks={code:08x}"


def test_columns(spark):
    df = spark.createDataFrame([(1, "abc", 1), (2, None, 2), (3, "é" * 2000, 3), (3, "abc", 3)], "doc_id long, text string, media int")
    files = mpeg.store(df)
    rows = mpeg.probe_column(files).collect()
    assert sorted((r.doc_id, r.frames, round(r.duration_s, 3)) for r in rows) == [(1, 1, 0.036), (2, 1, 0.036), (3, 1, 0.036), (3, 7, 0.252)]
    assert mpeg.digests(df.limit(0)).count() == 0 and mpeg.probe_column(spark.createDataFrame([(1, None)], "doc_id long, media binary")).first().frames == 0


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op8_mpeg(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_sha256 == hashlib.sha256(mpeg.write(payload)).hexdigest()
        media = mpeg.write(payload)
        assert r.media_bytes == len(media) and (len(raw) > 20_000 or r.feature == plain_feature(media))
