import hashlib
import itertools
import os
import random
import struct
import zlib

import pytest

from tessella.llm import op7_mpeg as m


@pytest.mark.parametrize("text", [b"", b"x", b"a" * 576, os.urandom(5000), b"\xff\xfb\x90\x00" * 900, "ünï".encode() * 1000])
def test_round_trip(text):
    payload = m.to_payload(text)
    got = m.parse(m.encode(payload))
    assert got["payload"] == payload and got["crc_bad"] == 0 and got["skipped"] == 0
    assert got["frames"] == len(payload) // 576 == got["vbr"]["frames"] and len(got["vbr"]["toc"]) == 100
    assert got["samples"] == 1152 * got["frames"] and got["duration_us"] == got["samples"] * 1_000_000 // 48000


def test_damage_is_found_and_skipped():
    media = bytearray(m.encode(m.to_payload(bytes(range(256)) * 9)))
    clean = m.parse(bytes(media))
    media[clean["offsets"][1] + 10] ^= 1
    hurt = m.parse(bytes(media))
    assert hurt["crc_bad"] == 1 and hurt["frames"] == clean["frames"]
    cut = clean["offsets"][2]
    torn = bytes(media[:cut]) + b"garbage\xff\xfagarbage" + bytes(media[cut:])
    assert m.parse(torn)["frames"] == clean["frames"] and m.parse(torn)["skipped"] == 16


def test_nothing_to_parse():
    assert m.parse(b"")["frames"] == 0 and m.parse(b"hello" * 100)["payload"] == b""


def test_crc_matches_rows():
    import numpy as np

    rows = np.frombuffer(os.urandom(340), np.uint8).reshape(10, 34)
    assert [m.crc16(r.tobytes()) for r in rows] == m.crc16_rows(rows).tolist()


def bitwise_crc(bits):
    """The standard's shift register, a bit at a time."""
    crc = 0xFFFF
    for b in bits:
        top = crc >> 15 & 1
        crc = crc << 1 & 0xFFFF
        if top ^ b:
            crc ^= 0x8005
    return crc


def bits_of(data):
    return [x >> k & 1 for x in data for k in range(7, -1, -1)]


WORDS = [
    (version, layer, rate, hz, mode, ext)
    for version, layer, rate, hz in itertools.product((3, 2, 0), (1, 2, 3), (2, 9), (0, 1, 2))
    for mode, ext in ((0, 0), (1, 0), (1, 2), (3, 0))
]


@pytest.mark.parametrize("version, layer, rate, hz, mode, ext", random.Random(7).sample(WORDS, 60))
def test_checksums_of_every_version_layer_and_mode(version, layer, rate, hz, mode, ext):
    """Frames built bit by bit; a flipped bit in the protected part is a wrong checksum, one behind it is not."""
    word = 0x7FF << 21 | version << 19 | layer << 17 | rate << 12 | hz << 10 | mode << 6 | ext << 4
    head = m.header(word)
    rng = random.Random(word)
    channels, body = 1 if mode == 3 else 2, []
    if head[1] == 3:
        side = {(True, False): 32, (True, True): 17, (False, False): 17, (False, True): 9}[version == 3, mode == 3]
        body = [rng.randrange(2) for _ in range(8 * side)]
    else:
        bound = 4 * (ext + 1) if mode == 1 else 32
        if head[1] == 1:
            widths = [4] * 32
        else:
            each = head[3] // channels
            low, high = (each <= 48 and version == 3), version == 3 and head[4] != 48000 and each >= 96
            widths = [4] * 4 + [3] * 7 + [2] * 19 if version != 3 else [4] * 2 + [3] * (10 if head[4] == 32000 else 6) if low else [4] * 11 + [3] * 12 + [2] * (7 if high else 4)
        used = 0
        for band, width in enumerate(widths):
            for _ in range(channels if band < bound else 1):
                value = rng.randrange(1 << width) * rng.randrange(2)
                body += [value >> k & 1 for k in range(width - 1, -1, -1)]
                used += (1 if band < bound else channels) * (value > 0)
        if head[1] == 2:
            body += [rng.randrange(2) for _ in range(2 * used)]
    start = struct.pack(">I", word)
    crc = bitwise_crc(bits_of(start[2:]) + body)
    rest = 8 * (head[7] - 6) - len(body)
    if rest < 8:
        pytest.skip("the frame is too short for its fields")
    tail = body + [0] * rest
    data = start + crc.to_bytes(2, "big") + bytes(sum(b << 7 - k for k, b in enumerate(tail[i : i + 8])) for i in range(0, len(tail), 8))
    assert len(data) == head[7] and m.protected_bits(data, head) == len(body)
    got = m.parse(data * 4)
    assert (got["frames"], got["crc_bad"], got["skipped"]) == (4, 0, 0) and got["samples"] == 4 * head[8]
    hurt = bytearray(data)
    hurt[6] ^= 128
    assert m.parse(data + bytes(hurt) + data * 2)["crc_bad"] == 1
    at = 6 + len(body) // 8 + 1
    after = bytearray(data)
    after[at] ^= 1
    assert m.parse(data + bytes(after) + data * 2)["crc_bad"] == 0


def test_protected_mono_frames_are_verified():
    word = m._FRAME_WORD | 3 << 6
    frame = struct.pack(">I", word) + b"\x12\x34" + bytes(m.header(word)[7] - 6)
    assert m.parse(frame * 4)["crc_bad"] == 4


def test_free_format_and_tags():
    word = 0xFFFB0400  # MPEG-1 Layer III, no checksum, bitrate 0, 48 kHz
    frames = b"".join(struct.pack(">I", word | pad << 9) + bytes(700 - 4 + pad) for pad in (0, 1, 0, 0, 1))
    item = struct.pack("<II", 5, 0) + b"Artist\0Smith"
    footer = lambda flags: b"APETAGEX" + struct.pack("<IIII", 2000, len(item) + 32, 1, flags) + bytes(8)
    id3v1 = b"TAG" + bytes(125)
    got = m.parse(frames + footer(1 << 31 | 1 << 29) + item + footer(1 << 31) + id3v1)
    assert got["frames"] == 5 and got["tags"]["Artist"] == "Smith" and got["skipped"] == 0 and got["offsets"].tolist() == [0, 700, 1401, 2101, 2801]


def test_query(spark):
    rows = [(1, "hello", "x"), (2, None, "x"), (3, "", "x"), (1, "hello", "y"), (None, "ü" * 30000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, feature string")
    media = m.stored_media(docs)
    assert {r.doc_id: m.parse(bytes(r.media))["payload"] for r in media.collect()}[None] == m.to_payload(("ü" * 30000).encode())
    out = m.features(media).collect()
    assert len(out) == 5
    one = [r for r in out if r.doc_id == 1]
    assert one[0] == one[1] and one[0].payload_sha256 == hashlib.sha256(b"hello" + b"\xff" * 571).hexdigest()
    assert one[0].tail_crc32 == zlib.crc32(b"\xff" * 32) and len(one[0].offsets) == one[0].frames
    empty = [r for r in out if r.doc_id in (2, 3)]
    assert {r.payload_bytes for r in empty} == {576} and {r.n_bytes for r in empty} == {0}
    assert m.media_features(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    named = m.media_features(spark.createDataFrame([("a", "x")], "doc_id string, text string")).first()
    assert named.doc_id == "a" and named.n_bytes == 1
    none = m.features(spark.createDataFrame([(1, 0, None)], "doc_id long, n_bytes long, media binary")).first()
    assert (none.frames, none.payload_bytes, none.offsets) == (0, 0, [])
