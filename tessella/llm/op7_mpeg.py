"""MPEG audio columns: write, resynchronise, verify and index frame streams.

``encode`` stores bytes losslessly as the main data of MPEG-1 Layer III frames
(48 kHz, stereo, CRC protected, 576 payload bytes a frame) behind an ID3v2 tag
and a Xing table. ``stored_media`` writes such streams into a media column of a
table in the shared folder; ``features`` reads media back from there. ``parse``
makes no use of what the encoder knows: it skips ID3v1, ID3v2 and APE tags,
looks for a frame header whose successor also has one, follows the frame
lengths (of free format by the distance to the next like header) and looks again
after damage, reads the Xing or VBRI table, verifies the CRC-16 of every
protected frame over the bits that its version, layer and mode protect, and
returns exact durations and frame seek offsets.

Defined cases: null text is empty and an empty payload is one frame of bytes
255; a null stream is an empty one; a stream without any frame has no frames,
duration 0 and no payload; frames with a wrong checksum are counted in crc_bad
and give no payload; equal inputs give equal outputs, repeated rows one row
each; other columns are not read and may have any name; ids may be of any type.
Every row is handled on its own, in batches, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

UNIT = 576
# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by index, Hz by index.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {1.0: (44100, 48000, 32000), 2.0: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
VERSIONS = {0: 2.5, 2: 2.0, 3: 1.0}
LAYERS = {1: 3, 2: 2, 3: 1}


def _crc_table() -> list[int]:
    table_ = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = ((c << 1) ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        table_.append(c)
    return table_


CRC_TABLE = _crc_table()
_CRC_NP = np.array(CRC_TABLE, np.uint16)


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    for b in data:
        crc = ((crc << 8) ^ CRC_TABLE[(crc >> 8) ^ b]) & 0xFFFF
    return crc


def crc16_rows(rows: np.ndarray) -> np.ndarray:
    """crc16 of each row of a matrix of bytes."""
    crc = np.full(len(rows), 0xFFFF, np.uint16)
    for column in rows.T:
        crc = (crc << np.uint16(8)) ^ _CRC_NP[(crc >> np.uint16(8)) ^ column]
    return crc


def header(word: int):
    """(version, layer, crc?, bitrate, sample rate, padding, channel mode, length, samples), or None if it is no header.

    A free-format frame has bitrate 0 and length 0: its length is not in its header.
    """
    if word >> 21 != 0x7FF:
        return None
    version, layer = VERSIONS.get(word >> 19 & 3), LAYERS.get(word >> 17 & 3)
    rate_index, hz_index = word >> 12 & 15, word >> 10 & 3
    if version is None or layer is None or rate_index == 15 or hz_index == 3:
        return None
    kbps = BITRATES[(1 if version == 1.0 else 2, layer)][rate_index]
    hz, pad = SAMPLE_RATES[version][hz_index], word >> 9 & 1
    if kbps == 0:
        length, samples = 0, 384 if layer == 1 else 576 if layer == 3 and version != 1.0 else 1152
    elif layer == 1:
        length, samples = (12000 * kbps // hz + pad) * 4, 384
    else:
        samples = 576 if layer == 3 and version != 1.0 else 1152
        length = samples * 125 * kbps // hz + pad
    return version, layer, not word >> 16 & 1, kbps, hz, pad, word >> 6 & 3, length, samples


def side_bytes(version: float, mode: int) -> int:
    """Bytes of a Layer III frame's side information."""
    return (32 if mode != 3 else 17) if version == 1.0 else (17 if mode != 3 else 9)


#: Fixed values of the standards: bits of allocation by subband in Layer II, as (subbands, bits); last the one of MPEG-2.
ALLOCATION = {
    "a": ((11, 4), (12, 3), (4, 2)),
    "b": ((11, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "lsf": ((4, 4), (7, 3), (19, 2)),
}


def allocation_bits(version: float, kbps: int, hz: int, channels: int) -> list[int]:
    """Bits of allocation of each subband of a Layer II frame."""
    if version != 1.0:
        name = "lsf"
    else:
        each = kbps // channels
        if each <= 48:
            name = "d" if hz == 32000 else "c"
        else:
            name = "a" if hz == 48000 or 56 <= each <= 80 else "b"
    return [bits for n, bits in ALLOCATION[name] for _ in range(n)]


def protected_bits(frame: bytes, head) -> int:
    """Bits after the checksum that it covers, besides the second half of the header."""
    version, layer, _, kbps, hz, _, mode = head[:7]
    channels = 1 if mode == 3 else 2
    if layer == 3:
        return 8 * side_bytes(version, mode)
    # In joint stereo the channels share one allocation from this subband on.
    bound = 4 * ((frame[3] >> 4 & 3) + 1) if mode == 1 else 32
    if layer == 1:
        return 4 * (min(bound, 32) * channels + (32 - min(bound, 32)))
    widths = allocation_bits(version, kbps, hz, channels)
    at, scales = 48, 0
    bits = int.from_bytes(frame[: 6 + 64], "big")
    size = 8 * len(frame[: 6 + 64])
    for band, width in enumerate(widths):
        each = channels if band < bound else 1
        for _ in range(each):
            used = bits >> max(0, size - at - width) & ((1 << width) - 1)
            # Two bits of scale factor selection for each channel of a subband in use.
            scales += (2 if each == channels else 2 * channels) * (used > 0)
            at += width
    return at - 48 + scales


def crc16_bits(data: bytes, bits: int, crc: int = 0xFFFF) -> int:
    """crc16 of the first bits of data."""
    crc = crc16(data[: bits // 8], crc)
    for k in range(bits % 8):
        one = (data[bits // 8] >> 7 - k & 1) if bits // 8 < len(data) else 0
        crc = ((crc << 1) ^ 0x8005 if (crc >> 15) ^ one else crc << 1) & 0xFFFF
    return crc


def frame_crc(frame: bytes, head) -> int:
    """The checksum that a protected frame should have."""
    return crc16_bits(frame[6:], protected_bits(frame, head), crc16(frame[2:4]))


_SIDE = 32
_DATA_AT = 4 + 2 + _SIDE
#: 0xFFFA: MPEG-1 Layer III with CRC; bitrate index 12 (224 kbit/s), 48 kHz, stereo: 672 bytes.
_FRAME_WORD = 0xFFFAC400
_FRAME_LEN = header(_FRAME_WORD)[7]
_HZ = 48000


def encode(payload: bytes) -> bytes:
    """payload, whose length is a positive multiple of UNIT, as a tagged MPEG stream."""
    n = len(payload) // UNIT
    frames = np.zeros((n, _FRAME_LEN), np.uint8)
    frames[:, :4] = np.frombuffer(struct.pack(">I", _FRAME_WORD), np.uint8)
    frames[:, _DATA_AT : _DATA_AT + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    # main_data_begin 0, part2_3_length of both granules and channels: the payload's bits in equal shares.
    share = UNIT * 8 // 4
    side = 0
    for at in (20, 79, 138, 197):
        side |= share << (256 - at - 12)
    frames[:, 6:_DATA_AT] = np.frombuffer(side.to_bytes(_SIDE, "big"), np.uint8)
    crc = crc16_rows(frames[:, [2, 3, *range(6, _DATA_AT)]])
    frames[:, 4], frames[:, 5] = crc >> 8, crc & 0xFF

    first = bytearray(_FRAME_LEN)
    first[:4] = struct.pack(">I", _FRAME_WORD | 1 << 16)
    body = (n + 1) * _FRAME_LEN
    toc = bytes(min(255, (i * (n + 1) // 100) * _FRAME_LEN * 256 // body) for i in range(100))
    xing = b"Xing" + struct.pack(">III", 7, n, body) + toc
    first[4 + _SIDE : 4 + _SIDE + len(xing)] = xing
    title = b"TIT2" + struct.pack(">IH", 8, 0) + b"\x00payload"
    size = len(title)
    tag = b"ID3\x03\x00\x00" + bytes((size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127)) + title
    return b"".join((tag, bytes(first), frames.tobytes()))


def _tags(data: bytes) -> tuple[int, int, dict]:
    """Where audio begins and ends, and the text frames of the ID3v2 tag."""
    lo, hi, found = 0, len(data), {}
    while data[lo : lo + 3] == b"ID3" and lo + 10 <= hi:
        size = 0
        for b in data[lo + 6 : lo + 10]:
            size = size << 7 | b & 127
        at, end = lo + 10, min(lo + 10 + size, hi)
        while at + 10 <= end and data[at] != 0:
            n = struct.unpack(">I", data[at + 4 : at + 8])[0]
            if data[at : at + 1] == b"T" and n:
                code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(data[at + 10], "latin-1")
                found[data[at : at + 4].decode("latin-1")] = data[at + 11 : at + 10 + n].decode(code, "replace").rstrip("\0")
            at += 10 + n
        lo = end + (10 if data[lo + 5] & 16 else 0)
    if data[hi - 128 : hi - 125] == b"TAG" and hi - 128 >= lo:
        hi -= 128
    if hi - 32 >= lo and data[hi - 32 : hi - 24] == b"APETAGEX":
        size, count, flags = struct.unpack("<III", data[hi - 20 : hi - 8])
        first = max(lo, hi - size)
        at = first
        for _ in range(count):
            end = data.find(b"\0", at + 8, hi - 32)
            if end < 0:
                break
            n = struct.unpack("<I", data[at : at + 4])[0]
            found[data[at + 8 : end].decode("latin-1")] = data[end + 1 : min(end + 1 + n, hi - 32)].decode("utf-8", "replace")
            at = end + 1 + n
        hi = max(lo, first - (32 if flags >> 31 else 0))
    return lo, hi, found


def _vbr(data: bytes, at: int, head) -> dict | None:
    """The Xing, Info or VBRI table of the frame at this offset."""
    side = side_bytes(head[0], head[6])
    for skip in (4 + side, 6 + side):
        x = at + skip
        if data[x : x + 4] in (b"Xing", b"Info"):
            flags, y, out = struct.unpack(">I", data[x + 4 : x + 8])[0], x + 8, {"kind": data[x : x + 4].decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name], y = struct.unpack(">I", data[y : y + 4])[0], y + 4
            if flags & 4:
                out["toc"] = list(data[y : y + 100])
            return out
    x = at + 36
    if data[x : x + 4] == b"VBRI" and x + 18 <= len(data):
        size, frames = struct.unpack(">II", data[x + 10 : x + 18])
        return {"kind": "VBRI", "frames": frames, "bytes": size}
    return None


def _free_length(data: bytes, at: int, hi: int, word: int) -> int:
    """Length of a free-format frame without its padding: the distance to the next header of its kind, which is within 16 KB; 0 if there is none."""
    hi = min(hi, at + (1 << 14))
    kind, head = word & 0xFFFFFC00 | word & 0xC0, header(word)
    slot = 4 if head[1] == 1 else 1
    found = data.find(b"\xff", at + 24, hi)
    while 0 <= found <= hi - 4:
        other = int.from_bytes(data[found : found + 4], "big")
        if other & 0xFFFFFC00 | other & 0xC0 == kind:
            return found - at - slot * head[5]
        found = data.find(b"\xff", found + 1, hi)
    return 0


def parse(data: bytes) -> dict:
    """Frames of a stream: offsets, samples, duration, tags, VBR table, CRC results and the payload of layout ``encode``."""
    lo, hi, tags = _tags(data)
    at, offsets, samples, hz, skipped, vbr = lo, [], 0, 0, 0, None
    ours: list[int] = []  # frames of the layout of encode are verified and read together
    bad_other = 0
    heads: dict[int, tuple | None] = {}
    free: dict[int, int] = {}
    synced = False

    def head_at(place: int):
        word = int.from_bytes(data[place : place + 4], "big")
        if word not in heads:
            heads[word] = header(word)
        head = heads[word]
        if head is None or head[3]:
            return head
        kind = word & 0xFFFFFC00
        if not free.get(kind):
            free[kind] = _free_length(data, place, hi, word)
        n = free[kind]
        return (*head[:7], n + (4 if head[1] == 1 else 1) * head[5] if n else hi - place, head[8])

    while at + 4 <= hi:
        head = head_at(at)
        good = head is not None and at + head[7] <= hi
        if good and not synced:
            # Out of sync: the next frame must begin where this one ends, or the stream end there.
            after = at + head[7]
            nxt = header(int.from_bytes(data[after : after + 4], "big")) if after + 4 <= hi else None
            good = after >= hi - 3 and head[3] > 0 or nxt is not None and (nxt[0], nxt[1], nxt[4]) == (head[0], head[1], head[4])
        if not good:
            synced = False
            found = data.find(b"\xff", at + 1, hi)
            step = (found if found >= 0 else hi) - at
            skipped += step
            at += step
            continue
        table_ = _vbr(data, at, head) if not synced and not offsets and vbr is None else None
        synced, hz = True, head[4]
        if table_ is not None:
            vbr = table_
        else:
            if head[2]:
                if (head[0], head[1]) == (1.0, 3) and head[6] != 3 and head[7] >= _DATA_AT + UNIT:
                    ours.append(len(offsets))
                else:
                    frame = data[at : at + head[7]]
                    bad_other += len(frame) < 6 or frame_crc(frame, head) != int.from_bytes(frame[4:6], "big")
            offsets.append(at)
            samples += head[8]
        at += head[7]
    where = np.array(offsets, np.int64)
    bad = np.zeros(len(where), bool)
    payload = b""
    if ours:
        raw = np.frombuffer(data, np.uint8)
        k = np.array(ours)
        of = [2, 3, *range(6, _DATA_AT)]
        rows = raw[where[k][:, None] + np.array(of)]
        stored = raw[where[k] + 4].astype(np.uint16) << np.uint16(8) | raw[where[k] + 5]
        bad[k] = crc16_rows(rows) != stored
        keep = k[~bad[k]]
        payload = raw[where[keep][:, None] + np.arange(_DATA_AT, _DATA_AT + UNIT)].tobytes()
    return {
        "frames": len(where), "samples": samples, "sample_rate": hz, "crc_bad": int(bad.sum()) + bad_other, "skipped": skipped,
        "duration_us": samples * 1_000_000 // hz if hz else 0, "offsets": where, "vbr": vbr, "tags": tags, "payload": payload,
    }


def to_payload(text: bytes) -> bytes:
    """text with bytes 255 up to a positive multiple of UNIT."""
    return text + b"\xff" * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def _by_row(rows: DataFrame, value: str, make, fields: str) -> DataFrame:
    """rows (doc_id, n_bytes where there is one, value) -> doc_id and the fields that make gives of the bytes of value."""
    kept = [c for c in rows.columns if c != value]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.large_binary(), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*(f.split() for f in fields.split(", ")), strict=True)

    def run(batches):
        for batch in batches:
            values = batch.column(len(kept)).cast(pa.large_binary())
            lo, size = 0, 0
            # Streams of a few megabytes at a time, one at least.
            for hi in range(1, len(values) + 1):
                v = values[hi - 1]
                size += len(v.as_buffer()) if v.is_valid else 0
                if size >= 4 << 20 or hi - lo >= 512 or hi == len(values):
                    made = [make(v.as_buffer().to_pybytes() if v.is_valid else b"") for v in values.slice(lo, hi - lo)]
                    columns = [pa.array(list(c), kinds[t]) for c, t in zip(zip(*made, strict=True), types, strict=True)]
                    columns = [c.cast(pa.binary()) if pa.types.is_large_binary(c.type) else c for c in columns]
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(len(kept))), *columns], names=[*kept, *names])
                    lo, size = hi, 0

    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.select(*kept).dtypes), fields])
    return rows.select(*kept, value).mapInArrow(run, schema)


def stored_media(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, media: the texts' streams, written to the shared folder as a binary column."""
    streams = _by_row(docs.select("doc_id", "text"), "text", lambda text: (len(text), encode(to_payload(text))), "n_bytes long, media binary")
    return materialise(streams, "media")


def _described(media: bytes) -> tuple:
    got = parse(media)
    back, offsets = got["payload"], got["offsets"]
    seek = hashlib.sha256(offsets.astype(">i8").tobytes()).hexdigest()
    vbr = f" {got['vbr']['kind']}={got['vbr'].get('frames')}" if got["vbr"] else ""
    feature = f"mpeg1-l3 {got['sample_rate']}Hz frames={got['frames']} samples={got['samples']} us={got['duration_us']}{vbr} tag={got['tags'].get('TIT2', '')} seek={seek[:16]}"
    return (
        len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(),
        feature, got["duration_us"], got["frames"], got["crc_bad"], got["skipped"], offsets.tolist(),
    )


def features(media: DataFrame) -> DataFrame:
    """media (doc_id, n_bytes, media) -> sizes, digests, duration and the seek offsets of all frames, from the stored bytes alone."""
    return _by_row(
        media.select("doc_id", "n_bytes", "media"), "media", _described,
        "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string,"
        " duration_us long, frames long, crc_bad long, skipped long, offsets array<long>",
    )


def media_features(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> features of the texts' stored streams, one row each."""
    return features(stored_media(docs))


def op7_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media_features(table(spark, sf_dir, "documents"))
    return out.select("*", F.get("offsets", F.lit(0)).alias("first_offset"), F.element_at("offsets", -1).alias("last_offset")).drop("offsets")
