"""Helpers shared by the training-data operators.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, by
``materialise``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import materialise, shared_dir  # noqa: F401 - the operators take them from here

#: Bytes that separate words: space and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Two columns that tell rows apart by id and text; equal rows get equal keys and equal results."""
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("k1"),
        F.xxhash64(F.col(id_col).isNull(), F.coalesce(F.col(text_col), F.lit(""))).alias("k2"),
    ]


def text_buffers(column: pa.Array, max_bytes: int = CHUNK_BYTES):
    """Yield (first row, last row, bytes, offsets) for runs of rows of about max_bytes; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return
    _, offs_buf, data = column.buffers()
    offs = np.frombuffer(offs_buf, dtype=np.int64, count=n + 1, offset=column.offset * 8)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


_U = np.uint64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class PowerTable:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.size = 0
        self.up = np.ones(1, _U)
        self.down = np.ones(1, _U)

    def need(self, n: int) -> None:
        if n <= self.size:
            return
        n = -(-n // (1 << 18)) << 18
        self.up = np.ones(n + 1, _U)
        self.down = np.ones(n + 1, _U)
        self.up[1:] = self.base
        self.down[1:] = self.inverse
        np.multiply.accumulate(self.up, out=self.up)
        np.multiply.accumulate(self.down, out=self.down)
        self.size = n


_TABLES: dict[int, PowerTable] = {}
BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def prefix_hash(data: np.ndarray, base: int = BASE_A):
    """Prefix sums S so that (S[e]-S[s]) * base**-s is a hash of data[s:e]; returns (S, powers)."""
    powers = _TABLES.setdefault(base, PowerTable(base))
    powers.need(len(data))
    s = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * powers.up[: len(data)], out=s[1:])
    return s, powers


def span_hash(s: np.ndarray, powers: PowerTable, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix64((s[end] - s[start]) * powers.down[start] + end.astype(_U) - start.astype(_U))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_spans(buf: np.ndarray, offs: np.ndarray):
    """Start, end and row of each word of the rows in buf; words never cross rows."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~_IS_SPACE[buf]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = ~inside[:-1]
    cut = offs[:-1]
    first[cut[cut < n]] = True
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = ~inside[1:]
    cut = offs[1:]
    last[cut[cut > 0] - 1] = True
    starts = np.flatnonzero(inside & first)
    ends = np.flatnonzero(inside & last) + 1
    rows = np.searchsorted(offs, starts, "right") - 1
    return starts, ends, rows


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def word_hashes(buf: np.ndarray, offs: np.ndarray):
    """64-bit hash and row of every word, letters A to Z lowered."""
    starts, ends, rows = word_spans(buf, offs)
    s, powers = prefix_hash(lower_ascii(buf))
    return span_hash(s, powers, starts, ends), rows
