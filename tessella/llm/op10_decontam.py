"""Benchmark decontamination by the q-gram lemma over overlapping diagonal bands.

Texts are compared with letters lowered and each run of ASCII white space as
one space. An item of n bytes that occurs in a text with at most k edits shares
at least n + 1 - q(k + 1) of its q-grams with it, on diagonals that differ by
at most k. So the shared q-grams of a text and an item are counted in bands of
2k + 1 diagonals that overlap by k + 1: any k + 1 neighbouring diagonals lie
within one band. Bands whose count meets the bound are verified by banded
semi-global alignment, and regions with at most k edits are hits.

k is EDIT_SHARE of the item's length. q is Q, or less for short items, so that
the bound is MIN_SHARED or more; items too short for that even with grams of
MIN_Q bytes (12 bytes or less, by the defaults) are hits where they stand
unchanged, as whole tokens: "yes" is none in "eyesight".

Items are compared in blocks of ITEMS_PER_BLOCK, each one broadcast to the
executors (a block's bytes are checked against BLOCK_BYTES first), so the
benchmark may grow: every document meets every block, documents are never
shuffled. Pairs of equal grams are made in slices of PAIRS, and a band is judged
and let go when the text has passed it, so memory does not grow with the text,
however repetitive text and items are.

Defined cases: null and empty texts, and null and empty items, have no hits;
equal items each have their own hit; very long texts are processed in whole
(windows of positions overlap by the longest item); repeated rows give equal
rows; no documents give no rows and no items no hits; of both tables only id
and text are read, so other columns may have any name. item_id must be a whole
number or null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, table, text_buffers

Q, MIN_Q, EDIT_SHARE, MIN_SHARED = 8, 3, 0.1, 8
ITEMS_PER_BLOCK, BLOCK_BYTES = 4096, 16 << 20
PAIRS, BANDS = 1 << 20, 512
_U = np.uint64
_BITS = 22


def normal(text: bytes) -> bytes:
    lowered = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()
    return b" ".join(lowered.split())


def budget(n: int, share: float = EDIT_SHARE) -> int:
    """Edits allowed for an item of n bytes."""
    return int(n * share)


def gram_size(n: int, q: int = Q, share: float = EDIT_SHARE) -> int | None:
    """The largest gram of at most q bytes with which the lemma asks for MIN_SHARED grams or more; None for items too short for any."""
    return next((g for g in range(q, MIN_Q - 1, -1) if n + 1 - g * (budget(n, share) + 1) >= MIN_SHARED), None)


def _grams(data: np.ndarray, q: int) -> np.ndarray:
    """The q bytes from each position as one integer (q is 8 at most)."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, _U)
    # Eight bytes from every place at once, by a view whose items overlap.
    padded = data.tobytes() + bytes(8 - q)
    out = np.ndarray((n,), "<u8", padded, strides=(1,)).copy()
    return out if q == 8 else out & _U((1 << 8 * q) - 1)


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams * _U(0x9E3779B97F4A7C15)) >> _U(64 - _BITS)


def banded_distances(item: bytes, text: bytes, shifts: np.ndarray, width: int, k: int) -> list[tuple[int, int] | None]:
    """Of each shift: least edits and end of item against any part of text, in the band of diagonals shift..shift+width; None if over k.

    All bands are advanced together, one byte of the item at a step.
    """
    m, n, inf = len(item), len(text), k + 1
    out: list[tuple[int, int] | None] = [None] * len(shifts)
    ahead = np.arange(width + 1, dtype=np.int32)
    pad = np.frombuffer(text, np.uint8)
    for first in range(0, len(shifts), BANDS):
        live = np.arange(first, min(first + BANDS, len(shifts)))
        at = shifts[live]
        column = at[:, None] + np.arange(m + width + 1)
        seg = pad[np.clip(column, 0, max(0, n - 1))] if n else np.zeros(column.shape, np.uint8)
        ok = (column >= 0) & (column <= n)
        row = np.where(ok[:, : width + 1], 0, inf).astype(np.int32)
        for i in range(1, m + 1):
            # Column i + shift + d: from the cell before on the same diagonal, from above (one diagonal on), or from the left.
            new = row + (seg[:, i - 1 : i + width] != item[i - 1])
            new[~((column[:, i - 1 : i + width] >= 0) & (column[:, i - 1 : i + width] < n))] = inf
            np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
            new[~ok[:, i : i + width + 1]] = inf
            new = np.minimum.accumulate(new - ahead, axis=1) + ahead
            new[~ok[:, i : i + width + 1]] = inf
            row = np.minimum(new, inf)
            if i % 8 == 0 and not (good := row.min(1) <= k).all():
                live, row, seg, ok, column = live[good], row[good], seg[good], ok[good], column[good]
                if not len(live):
                    break
        for x, r in zip(live.tolist(), row, strict=True):
            cost = int(r.min())
            if cost <= k:
                out[x] = (cost, m + int(shifts[x]) + int(r.argmin()))
    return out


class Grams:
    """Positions of the q-grams of items that share a gram size."""

    def __init__(self, items: list[bytes], owners: list[int], q: int, share: float):
        self.q, self.items = q, items
        self.owners = np.array(owners, np.int64)
        self.n = np.array([len(t) for t in items], np.int64)
        self.k = np.array([budget(len(t), share) for t in items], np.int64)
        self.bound = self.n + 1 - q * (self.k + 1)
        self.longest, self.least = int(self.n.max()), int(self.bound.min())
        parts = [_grams(np.frombuffer(t, np.uint8), q) for t in items]
        grams = np.concatenate(parts)
        at = np.concatenate([np.arange(len(g)) for g in parts])
        owner = np.repeat(np.arange(len(parts)), [len(g) for g in parts])
        order = np.argsort(grams, kind="stable")
        self.grams, self.at, self.owner = grams[order], at[order], owner[order]
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[_slot(self.grams)] = True

    def bands(self, text: np.ndarray):
        """(items, lowest diagonals) of the bands of a text that meet their bound, as the text passes them."""
        if len(text) < self.least + self.q - 1:
            return
        grams = _grams(text, self.q)
        pos = np.flatnonzero(self.seen[_slot(grams)])
        if len(pos) == 0:
            return
        g = grams[pos]
        lo, hi = np.searchsorted(self.grams, g, "left"), np.searchsorted(self.grams, g, "right")
        real = hi > lo
        pos, lo, hi = pos[real], lo[real], hi[real]
        # Positions that no region can hold enough shared grams around are left out before pairs are made.
        span = self.longest + int(self.k.max()) + 1
        right = np.searchsorted(pos, pos + span, "left")
        dense = right - np.arange(len(pos)) >= self.least
        if not dense.any():
            return
        cover = np.zeros(len(pos) + 1, np.int64)
        np.add.at(cover, np.flatnonzero(dense), 1)
        np.add.at(cover, right[dense], -1)
        keep = np.cumsum(cover[:-1]) > 0
        pos, lo, count = pos[keep], lo[keep], (hi - lo)[keep]
        wide = len(text) + self.longest + 2
        upto = np.cumsum(count)
        held = np.zeros(0, np.int64)
        a = 0
        while a < len(pos):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
            c = count[a:b]
            which = np.repeat(np.arange(b - a), c)
            into = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) + lo[a:b][which]
            owner = self.owner[into]
            # Cells of k + 1 diagonals; a band is a cell and the next, so bands overlap by a cell.
            cell = (pos[a:b][which] - self.at[into] + self.longest) // (self.k[owner] + 1)
            # The lemma speaks of the item's q-grams: one that meets the text twice in a cell counts once.
            held = np.unique(np.concatenate([held, (owner * wide + cell) * self.longest + self.at[into]]))
            keys, shared = np.unique(held // self.longest, return_counts=True)
            o, cell = keys // wide, keys % wide
            # A cell is done when the text has passed the cell after it too.
            done = np.full(len(keys), True) if b == len(pos) else (cell + 2) * (self.k[o] + 1) - self.longest + self.n[o] <= pos[b]
            both = shared.copy()
            both[:-1] += np.where(keys[1:] == keys[:-1] + 1, shared[1:], 0)
            good = done & (both >= self.bound[o])
            if good.any():
                yield o[good], cell[good] * (self.k[o[good]] + 1) - self.longest
            held = held[~np.repeat(done, shared)]
            a = b

    def hits(self, text: np.ndarray, raw: bytes, exact: set[int]):
        """(item, start, end, edits) of each verified region; of items that stand unchanged only the first."""
        for o, low in self.bands(text):
            for x in np.unique(o).tolist():
                owner, item, k = int(self.owners[x]), self.items[x], int(self.k[x])
                if owner in exact:
                    continue
                lows = low[o == x]
                found = next((at for l in lows.tolist() if (at := raw.find(item, max(0, l), max(0, l + 2 * k + 2 + len(item)))) >= 0), -1)
                if found >= 0:
                    exact.add(owner)
                    yield owner, found, found + len(item), 0
                    continue
                for got in banded_distances(item, raw, lows - k, 4 * k + 2, k):
                    if got:
                        yield owner, max(0, got[1] - len(item)), got[1], got[0]


class Index:
    """The items of a block: by gram size, and those that are too short for grams."""

    def __init__(self, items: list[tuple[int, bytes]], q: int = Q, share: float = EDIT_SHARE):
        self.items = [(i, t) for i, t in items if t]
        sizes = [gram_size(len(t), q, share) for _, t in self.items]
        self.short = [x for x, g in enumerate(sizes) if g is None]
        self.parts = []
        for g in sorted(set(sizes) - {None}):
            owners = [x for x, s in enumerate(sizes) if s == g]
            self.parts.append(Grams([self.items[x][1] for x in owners], owners, g, share))
        self.longest = max((len(t) for _, t in self.items), default=0)

    def short_hits(self, raw: bytes):
        """Items that stand in the text as whole tokens."""
        for o in self.short:
            item = self.items[o][1]
            at = raw.find(item)
            while at >= 0:
                end = at + len(item)
                if not (_INNER[item[0]] and at and _INNER[raw[at - 1]]) and not (_INNER[item[-1]] and end < len(raw) and _INNER[raw[end]]):
                    yield o, at, end, 0
                    break
                at = raw.find(item, at + 1)


#: Bytes of tokens: letters, digits, _ and all beyond ASCII.
_INNER = np.zeros(256, bool)
_INNER[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True


_HITS = "array<struct<item_id:long,start:long,end:long,edits:long>>"
_HIT_TYPE = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "start", "end", "edits")]))
HITS = "benchmark_hits"


def _text_hits(index: Index, raw: bytes) -> list[dict]:
    """Best region of each item of the block in one normalised text."""
    text = np.frombuffer(raw, np.uint8)
    margin = 2 * index.longest + 64
    best: dict[int, tuple] = {}
    exact: set[int] = set()
    for a in range(0, max(1, len(text)), CHUNK_BYTES):
        lo, hi = max(0, a - margin), a + CHUNK_BYTES
        part = raw if lo == 0 and hi >= len(raw) else raw[lo:hi]
        for grams in index.parts:
            for o, s, e, d in grams.hits(text[lo:hi], part, exact):
                if o not in best or (d, s + lo) < (best[o][2], best[o][0]):
                    best[o] = (s + lo, e + lo, d)
    for o, s, e, d in index.short_hits(raw):
        best[o] = (s, e, d)
    return [{"item_id": index.items[o][0], "start": s, "end": e, "edits": d} for o, (s, e, d) in sorted(best.items())]


def _search(items: list[tuple[int, bytes]], text_at: int, q: int, share: float):
    """mapInArrow function that adds a block's hits to the last column."""

    def run(batches):
        index = Index(items, q, share)
        for batch in batches:
            old = batch.column(batch.num_columns - 1)
            new = []
            for lo, hi, buf, offs in text_buffers(batch.column(text_at)):
                for r in range(lo, hi):
                    new.append(old[r].as_py() + _text_hits(index, normal(buf[offs[r - lo] : offs[r - lo + 1]].tobytes())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(new, _HIT_TYPE)], names=batch.schema.names)

    return run


def find(docs: DataFrame, benchmark: DataFrame, q: int = Q, share: float = EDIT_SHARE, block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """docs with a column text, benchmark (item_id, text) -> docs and benchmark_hits, one entry for each item found.

    An entry has the item's id, the best region in bytes of the normalised text and its edits.
    A column benchmark_hits of docs is replaced.
    """
    if q > 8:
        raise ValueError("q is 8 at most")
    out = docs.drop(HITS).withColumn(HITS, F.from_json(F.lit("[]"), _HITS))
    at = out.columns.index("text")

    def add(items: list[tuple[int, bytes]]) -> DataFrame:
        return out.mapInArrow(_search(items, at, q, share), out.schema)

    items, size = [], 0
    # The stated query set is read in order, a block at a time; the driver holds one block.
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    for item_id, text in rows.orderBy("item_id", "text").toLocalIterator():
        text = normal(text.encode())
        if not text:
            continue
        if items and (len(items) >= block or size + len(text) > BLOCK_BYTES):
            out, items, size = add(items), [], 0
        items.append((item_id, text))
        size += len(text)
    return add(items) if items else out


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that hold no benchmark item, columns as they were."""
    return find(docs, benchmark, **options).where(F.size(HITS) == 0).drop(HITS)


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform(HITS, lambda h: h["item_id"]))
    return found.select("doc_id", (F.size(HITS) > 0).alias("contaminated"), F.size(HITS).cast("long").alias("n_items"), F.array_join(ids, ",").alias("item_ids"), F.array_min(F.transform(HITS, lambda h: h["edits"])).alias("min_edits"))
