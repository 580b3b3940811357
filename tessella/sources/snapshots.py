"""Binary snapshot files: a big-endian count, then path length, SHA-256, kind and path of each file."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("regular", "symlink")


def encode(files: list[tuple[str, str, str]]) -> bytes:
    """(path, hash in hex, kind) of each file as a snapshot."""
    parts = [struct.pack(">I", len(files))]
    for path, digest, kind in files:
        raw = path.encode()
        parts += [struct.pack(">H", len(raw)), bytes.fromhex(digest), bytes([KINDS.index(kind)]), raw]
    return b"".join(parts)


def decode(data: bytes) -> list[tuple[str, str, str]]:
    """Files of a snapshot; one that is cut short ends with its last whole record."""
    if len(data) < 4:
        return []
    out, at = [], 4
    for _ in range(struct.unpack(">I", data[:4])[0]):
        if at + 35 > len(data):
            break
        size = struct.unpack(">H", data[at : at + 2])[0]
        if at + 35 + size > len(data):
            break
        out.append((data[at + 35 : at + 35 + size].decode("utf-8", "replace"), data[at + 2 : at + 34].hex(), KINDS[min(data[at + 34], 1)]))
        at += 35 + size
    return out


def read_snapshots(spark: SparkSession, pattern: str) -> DataFrame:
    """Snapshot files -> commit_id (the file's name without suffix), rel_path, hash, type."""
    files = spark.read.format("binaryFile").load(pattern)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")

    def run(frames):
        for frame in frames:
            yield pd.DataFrame([(c, *f) for c, data in zip(frame["commit_id"], frame["content"], strict=True) for f in decode(data)], columns=["commit_id", "rel_path", "hash", "type"])

    return files.select(name.alias("commit_id"), "content").mapInPandas(run, "commit_id string, rel_path string, hash string, type string")


def to_binary(snapshots: DataFrame) -> DataFrame:
    """(commit_id, rel_path, hash, type) -> commit_id, content: a snapshot for each commit, files by path."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("rel_path")[["rel_path", "hash", "type"]].itertuples(index=False, name=None)
        return pd.DataFrame([(key[0], encode(list(rows)))], columns=["commit_id", "content"])

    return snapshots.groupBy("commit_id").applyInPandas(run, "commit_id string, content binary")
