"""Exact repeats by a common-prefix interval tree over a sampled suffix array.

Sampling. Of all GRAM-byte strings in a window of LENGTH bytes the one with the
least hash (of equals the last) is the window's anchor. The choice depends on
the window's bytes alone, so equal windows have equal anchors at equal places,
and repeats are found among suffixes that begin at anchors. An anchor stands
for a run of windows; the bytes of that run are its context.

Only anchors whose gram occurs again go on. A context that occurs twice or more
(by hash) is a repeat as a whole. Of the other contexts of such grams the bytes are sorted:
a suffix array of the text right of the anchors with its common-prefix lengths.
A stack scan gives the interval tree; from the leaves up each interval merges
its children's occurrences in the order of the text left of the anchor, read
backwards. Where a new neighbour extends to the left by l bytes and the interval
is r bytes deep, l + r >= LENGTH means a repeat of l + r bytes that can be
extended neither way. Every occurrence of an interval is merged, so all
occurrences are found, not only neighbours in the suffix array.

Two units are searched in one pass over the texts: strings of 400 bytes, which
are removed, and passages of 51 words (as sequences of 32-bit hashes, letters A
to Z lowered), which are counted: 51 words may have fewer than 400 bytes.

Grams with more than HOT distinct contexts are not sorted in one task: the
windows of their contexts are hashed one by one and counted by gram and hash
(128 bits together), which map-side sums spread over all tasks.

Defined cases: null text is empty; shorter texts than LENGTH never match as
windows; texts of any length are processed whole; repeated rows are each
other's repeats; rows keep their number; no documents give no rows; of documents
only doc_id and text are read. doc_id must be a number or null.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, mix64, prefix_hash, row_key, span_hash, table, text_buffers, word_hashes

LENGTH, GRAM, HOT = 400, 128, 20_000
PASSAGE, PASSAGE_GRAM = 51, 16
_U = np.uint64
_WORD_BYTES = 4


@dataclass(frozen=True)
class Unit:
    """What is compared: strings of ``length`` bytes, or of as many words; ``gram`` is the length of an anchor."""

    length: int = LENGTH
    gram: int = GRAM
    words: bool = False

    @property
    def bytes(self) -> tuple[int, int]:
        """Length and gram in bytes of the sequence that is searched."""
        size = _WORD_BYTES if self.words else 1
        return self.length * size, self.gram * size

    def sequence(self, buf: np.ndarray, offs: np.ndarray):
        """The texts' bytes, or four bytes of each word's hash."""
        if not self.words:
            return buf, offs
        hashes, rows = word_hashes(buf, offs)
        at = np.searchsorted(rows, np.arange(len(offs))) * _WORD_BYTES
        return np.ascontiguousarray((hashes >> _U(32)).astype(">u4")).view(np.uint8), at


UNITS = (Unit(), Unit(PASSAGE, PASSAGE_GRAM, True))


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of each window of this width."""
    n = len(keys) - width + 1
    if n <= 0:
        return keys[:0]
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, _U)
    padded[: len(keys)] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Of each anchor: row, place p, first and last window s and e (from the row's start), gram hash, context hash."""
    none = np.zeros(0, np.int64)
    size = np.diff(offs)
    long = np.flatnonzero(size >= length)
    if not len(long):
        return none, none, none, none, none.astype(_U), none.astype(_U)
    sums, powers = prefix_hash(buf)
    n = len(buf) - gram + 1
    grams = (sums[gram:] - sums[:n]) * powers.down[:n]
    grams ^= grams >> _U(31)
    grams *= _U(0xBF58476D1CE4E5B9)
    keys = (grams & _U(0xFFFFFFFF00000000)) | (_U(0xFFFFFFFF) - np.arange(n, dtype=_U))
    least = window_minima(keys, length - gram + 1)
    windows = size[long] - length + 1
    start = np.repeat(offs[long] - np.r_[0, np.cumsum(windows)[:-1]], windows) + np.arange(windows.sum())
    row = np.repeat(long, windows)
    place = (_U(0xFFFFFFFF) - (least[start] & _U(0xFFFFFFFF))).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(start)] - 1
    p, s, e, r = place[first], start[first], start[last], row[first]
    context = span_hash(sums, powers, s, e + length)
    context = mix64(context ^ mix64(((p - s) * 1024 + (e - s)).astype(_U)))
    base = offs[r]
    return r, p - base, s - base, e - base, mix64(grams[p]), context


_ANCHOR = "u int, gram long, context long, k1 long, k2 long, p int, s int, e int"


def _anchors(units: tuple[Unit, ...], whole: bool):
    def run(batches):
        for batch in batches:
            for lo, _, raw, ends in text_buffers(batch.column(2)):
                for u, unit in enumerate(units):
                    buf, offs = unit.sequence(raw, ends)
                    r, p, s, e, g, c = anchors(buf, offs, *unit.bytes)
                    g = mix64(g + _U(u))
                    columns = [pa.array(np.full(len(g), u, np.int32)), pa.array(g.view(np.int64))]
                    if whole:
                        take = pa.array(r + lo)
                        columns += [pa.array(c.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), *(pa.array(x.astype(np.int32)) for x in (p, s, e))]
                    yield pa.RecordBatch.from_arrays(columns, names=["u", "gram", "context", "k1", "k2", "p", "s", "e"][: len(columns)])

    return run


_NEED = "array<struct<u:int,gram:long,context:long,n:long,hot:boolean,p:int,s:int,e:int>>"
_BYTES = "u int, gram long, context long, hot boolean, n long, k1 long, k2 long, p int, before binary, after binary"


def _contexts(units: tuple[Unit, ...]):
    """(k1, k2, text, need) -> the bytes before each anchor (backwards) and from it on."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(10)]
            for k1, k2, text, need in zip(batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), batch.column(3), strict=True):
                raw, k1, k2, data = text.as_buffer(), k1.as_py(), k2.as_py(), {}
                for x in need.as_py():
                    u, p = x["u"], x["p"]
                    if u not in data:
                        data[u] = units[u].sequence(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tobytes() if units[u].words else raw
                    d = data[u]
                    values = (u, x["gram"], x["context"], x["hot"], x["n"], k1, k2, p, bytes(d[x["s"] : p])[::-1], bytes(d[p : x["e"] + units[u].bytes[0]]))
                    for c, v in zip(out, values, strict=True):
                        c.append(v)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[f.split()[0] for f in _BYTES.split(", ")])

    return run


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] == b[:lo], a[:hi] != b[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def interval_tree(lcp: list[int]):
    """(depth, children) of each interval from the leaves up, by a stack scan of common-prefix lengths.

    lcp[i] is that of suffixes i and i + 1. A child is an int (a suffix) or the number of an
    earlier interval as a negative number minus one. The last interval holds all suffixes.
    """
    stack: list[tuple[int, list[int]]] = []
    child, made = 0, 0
    for i, depth in enumerate([*lcp, -1]):
        while stack and stack[-1][0] > depth:
            d, children = stack.pop()
            children.append(child)
            yield d, children
            made += 1
            child = -made
        if depth < 0:
            return
        if stack and stack[-1][0] == depth:
            stack[-1][1].append(child)
        else:
            stack.append((depth, [child]))
        child = i + 1


def intervals(before: list[bytes], after: list[bytes], length: int):
    """(depth, members, pairs) of each interval with a repeat of ``length`` or more that ends at its depth.

    after is sorted, before read backwards. Members are (before, occurrence) in order; pairs (occurrence, occurrence, l)
    are neighbours of different children whose left texts part after l, which is the left extension of a maximal repeat.
    """
    lcp = [common_prefix(a, b) for a, b in zip(after, after[1:])]
    groups: list[list[tuple[bytes, int]]] = []
    for depth, children in interval_tree(lcp):
        parts = [[(before[c], c)] if c >= 0 else groups[-c - 1] for c in children]
        parts.sort(key=len)
        merged, pairs = parts.pop(), []
        for part in parts:
            for item in part:
                at = bisect_left(merged, item)
                for other in merged[max(0, at - 1) : at + 1]:
                    l = common_prefix(item[0], other[0])
                    # Left diversity: neighbours whose left texts part here give a repeat that ends here.
                    if l + depth >= length:
                        pairs.append((item[1], other[1], l))
                merged.insert(at, item)
        groups.append(merged)
        if pairs:
            yield depth, merged, pairs


def repeats(before: list[bytes], after: list[bytes], length: int):
    """(occurrence, occurrence, l, r) of maximal repeats; every occurrence of a maximal repeat is in a pair of it or of a longer one."""
    for depth, _, pairs in intervals(before, after, length):
        for i, j, l in pairs:
            yield i, j, l, depth


def repeat_sets(before: list[bytes], after: list[bytes], length: int):
    """(occurrences, l, r) of each maximal repeat: all members of its interval that share l bytes to the left."""
    for depth, members, pairs in intervals(before, after, length):
        seen = set()
        for i, _, l in pairs:
            at = bisect_left(members, (before[i], i))
            lo = hi = at
            while lo and common_prefix(members[lo - 1][0], before[i]) >= l:
                lo -= 1
            while hi + 1 < len(members) and common_prefix(members[hi + 1][0], before[i]) >= l:
                hi += 1
            if (lo, l) not in seen:
                seen.add((lo, l))
                yield [c for _, c in members[lo : hi + 1]], l, depth


_SPAN = "u int, k1 long, k2 long, start int, end int"
_GROUP = "gram long, context long, repeat long, length int, offset int"


def _groups(units: tuple[Unit, ...], groups: bool):
    """Contexts sorted by gram and after -> removed spans of those that occur once, or the occurrences of all maximal repeats.

    An occurrence is an offset from its context's anchor; repeat is a hash of the repeated bytes.
    """

    def solve(gram, rows):
        length, before, after = units[rows[0][0]].bytes[0], [x[6] for x in rows], [x[7] for x in rows]
        if groups:
            for members, l, r in repeat_sets(before, after, length):
                content = before[members[0]][:l][::-1] + after[members[0]][:r]
                name = int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "big", signed=True)
                for i in members:
                    yield (gram, rows[i][1], name, l + r, -l)
            return
        for i, j, l, r in repeats(before, after, length):
            for x in (rows[i], rows[j]):
                if x[2] == 1:
                    yield (x[0], x[3], x[4], x[5] - l, x[5] + r)

    fields = (_GROUP if groups else _SPAN).split(", ")
    names = [f.split()[0] for f in fields]
    kinds = [pa.int32() if f.endswith(" int") else pa.int64() for f in fields]

    def pack(found):
        columns = [list(c) for c in zip(*found, strict=True)] if found else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches):
        current, rows, found = None, [], []
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("gram", "u", "context", "n", "k1", "k2", "p", "before", "after")]
            for gram, *row in zip(*columns, strict=True):
                if gram != current:
                    found += solve(current, rows) if len(rows) > 1 else ()
                    current, rows = gram, []
                    if len(found) > 20000:
                        yield pack(list(dict.fromkeys(found)))
                        found = []
                rows.append(row)
        found += solve(current, rows) if len(rows) > 1 else ()
        yield pack(list(dict.fromkeys(found)))

    return run


_WINDOW = "u int, gram long, window long, n long, k1 long, k2 long, start int"


def _windows(units: tuple[Unit, ...]):
    """Contexts -> the hash of each of their windows."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                u, gram, n, k1, k2, p, before, after = (batch.column(batch.schema.get_field_index(c))[i].as_py() for c in ("u", "gram", "n", "k1", "k2", "p", "before", "after"))
                length = units[u].bytes[0]
                data = np.frombuffer(before[::-1] + after, np.uint8)
                sums, powers = prefix_hash(data)
                start = np.arange(len(data) - length + 1)
                hashes = span_hash(sums, powers, start, start + length)
                m = len(start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([u] * m, pa.int32()), pa.array([gram] * m, pa.int64()), pa.array(hashes.view(np.int64)), pa.array([n] * m, pa.int64()), pa.array([k1] * m, pa.int64()), pa.array([k2] * m, pa.int64()), pa.array((start + p - len(before)).astype(np.int32))],
                    names=[f.split()[0] for f in _WINDOW.split(", ")],
                )

    return run


def _repeated(docs: DataFrame, units: tuple[Unit, ...]) -> tuple[DataFrame, DataFrame]:
    """The rows with their keys, and the anchors whose grams occur again."""
    source = docs.select(*row_key(), F.coalesce("text", F.lit("")).alias("text"))
    # A text with that many words has that many bytes and as many less one between them.
    least = min(2 * u.length - 1 if u.words else u.length for u in units)
    long = source.where(F.octet_length("text") >= least)
    # Written out, so that a gram with very many anchors is a skewed side of a plain join, which adaptive execution splits.
    often = materialise(long.mapInArrow(_anchors(units, False), "u int, gram long").groupBy("gram").count().where("count > 1").select("gram"), "grams")
    again = materialise(long.mapInArrow(_anchors(units, True), _ANCHOR).join(often, "gram", "left_semi"), "anchors")
    return source, again


def _distinct(source: DataFrame, again: DataFrame, units: tuple[Unit, ...], hot: int, wanted: str) -> tuple[DataFrame, DataFrame]:
    """The distinct contexts, and the bytes of those whose gram meets a condition on kinds (of its contexts) and least (times one occurs)."""
    counted = materialise(again.groupBy("u", "gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "p", "s", "e")).alias("x")), "contexts")
    mixed = materialise(counted.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where(wanted).select("gram", (F.col("kinds") > hot).alias("hot")), "mixed")
    needs = counted.join(mixed, "gram").groupBy(F.col("x.k1").alias("k1"), F.col("x.k2").alias("k2")).agg(
        F.collect_list(F.struct("u", "gram", "context", "n", "hot", "x.p", "x.s", "x.e")).cast(_NEED).alias("need")
    )
    return counted, source.join(needs, ["k1", "k2"]).select("k1", "k2", "text", "need").mapInArrow(_contexts(units), _BYTES)


def _placed(found: DataFrame, units: tuple[Unit, ...]) -> DataFrame:
    """Spans of the searched sequence as spans of the unit: those of words are drawn in to whole words."""
    out = None
    for u, unit in enumerate(units):
        part = found.where(F.col("u") == u)
        if unit.words:
            size = _WORD_BYTES
            first, last = F.ceil(F.col("start") / size), F.floor((F.col("end") - unit.bytes[0]) / size)
            part = part.where(first <= last).select("u", "k1", "k2", first.cast("int").alias("start"), (last + unit.length).cast("int").alias("end"))
        out = part if out is None else out.unionByName(part)
    return out


def spans(docs: DataFrame, units: tuple[Unit, ...] = UNITS, hot: int = HOT) -> DataFrame:
    """docs (doc_id, text) -> u, k1, k2, start, end: parts (in bytes or words) in strings of unit u that start anywhere else too; they may overlap."""
    source, again = _repeated(docs, units)
    counted, contexts = _distinct(source, again, units, hot, "kinds > 1 and least = 1")
    twice = materialise(counted.where("n > 1").select("gram", "context"), "twice")
    end = F.element_at(F.array(*[F.lit(u.bytes[0]) for u in units]), F.col("u") + 1) + F.col("e")
    whole = again.join(twice, ["gram", "context"], "left_semi").select("u", "k1", "k2", F.col("s").alias("start"), end.cast("int").alias("end"))
    contexts = materialise(contexts, "context-bytes")
    order = contexts.where("not hot").repartition("gram").sortWithinPartitions("gram", "after")
    part = order.mapInArrow(_groups(units, False), _SPAN)
    windows = contexts.where("hot").mapInArrow(_windows(units), _WINDOW)
    same = windows.groupBy("gram", "window").agg(F.sum("n").alias("all")).where("all > 1").select("gram", "window")
    width = F.element_at(F.array(*[F.lit(u.bytes[0]) for u in units]), F.col("u") + 1)
    split = windows.where("n = 1").join(same, ["gram", "window"], "left_semi").select("u", "k1", "k2", "start", (F.col("start") + width).cast("int").alias("end"))
    return _placed(whole.unionByName(part).unionByName(split), units)


def repeat_groups(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs (doc_id, text) -> repeat, length, k1, k2, start, rows: every maximal repeat with all its occurrences, one row each.

    repeat names the group (a hash of its bytes); a repeat is maximal within the context of its anchor, so a longer one
    is a chain of groups that overlap. rows counts equal rows of documents; a group of one row of output has rows > 1.
    The output has the size of all groups together, which no method that names every occurrence of every group can avoid.
    """
    units = (Unit(length, gram),)
    source, again = _repeated(docs, units)
    counted, contexts = _distinct(source.dropDuplicates(["k1", "k2"]), again, units, 2**62, "kinds > 1")
    order = contexts.repartition("gram").sortWithinPartitions("gram", "after")
    part = materialise(order.mapInArrow(_groups(units, True), _GROUP).distinct(), "repeat-parts")
    whole = counted.where("n > 1").select("gram", "context", F.col("context").alias("repeat"), (F.col("x.e") + length - F.col("x.s")).cast("int").alias("length"), (F.col("x.s") - F.col("x.p")).cast("int").alias("offset"))
    placed = again.groupBy("gram", "context", "k1", "k2", "p").agg(F.count(F.lit(1)).alias("rows"))
    named = part.unionByName(whole).join(placed, ["gram", "context"])
    return named.select("repeat", "length", "k1", "k2", (F.col("p") + F.col("offset")).alias("start"), "rows").distinct()


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of spans that overlap or touch."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return start[first], reach[np.r_[first[1:], len(start)] - 1]


def _cut(batches):
    """(doc_id, text, spans, passages) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, kept."""
    for batch in batches:
        rows = [[], [], [], [], [], []]
        for text, found, passages in zip(batch.column(1).cast(pa.binary()), batch.column(2), batch.column(3), strict=True):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            runs, counts = [], []
            for x in (found, passages):
                full = x.is_valid and len(x)
                counts.append(merged(x.values.field(0).to_numpy(), x.values.field(1).to_numpy()) if full else ((), ()))
            kept, at = [], 0
            for s, e in zip(*(np.asarray(c).tolist() for c in counts[0]), strict=True):
                kept.append(data[at:s])
                runs.append(s)
                at = e
            kept.append(data[at:])
            rest = b"".join(kept)
            for c, v in zip(rows, (len(data), len(data) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), len(counts[1][0]), rest), strict=True):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "kept"])


def remove(docs: DataFrame, units: tuple[Unit, ...] = UNITS, hot: int = HOT) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, kept (the remaining bytes).

    The first unit's strings are removed; n_passages counts the maximal runs of words in strings of the second.
    """
    both = spans(docs.select("doc_id", "text"), units, hot).groupBy("k1", "k2")
    found = both.agg(*[F.collect_list(F.when(F.col("u") == u, F.struct("start", "end"))).alias(name) for u, name in enumerate(("spans", "passages"))])
    kind = dict(docs.dtypes)["doc_id"]
    joined = docs.select("doc_id", "text", *row_key()).join(found, ["k1", "k2"], "left").select("doc_id", "text", "spans", "passages")
    return joined.mapInArrow(_cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, kept binary")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")
